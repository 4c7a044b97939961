"""SimHash, source divergence and importance resampling against plain code, on small and on odd inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, odd_rows, prose
from veilscan.llm import divergence, importance, simhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_linked(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    low = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, x in prints:
            for j, y in prints:
                if None not in (i, j) and (x ^ y).bit_count() <= 2 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return collections.Counter((i, f"{x:016x}", low.get(i)) for i, x in prints)


def close_texts():
    """Long texts with a changed word or none, so that fingerprints are a few bits apart."""
    rows = []
    for group in range(8):
        words = prose(group, 300).split()
        for k in range(12):
            edited = list(words)
            edited[(7 * k) % len(edited)] = f"x{k}"
            rows.append(" ".join(edited if k else words))
    return rows


@pytest.mark.parametrize("tree", [4096, 8])
def test_simhash_equals_brute_force(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "SHARD", 16)
    rows = [*enumerate(close_texts()), (900, None), (901, " \n"), (902, "a b"), (5, "a b c d")]
    got = collections.Counter(tuple(r) for r in simhash.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    want = brute_linked(rows)
    assert len({c for _, _, c in want}) < len(rows) - 20  # the texts do link
    assert got == want


def test_simhash_of_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert collections.Counter(tuple(r) for r in simhash.linked(odd).collect()) == brute_linked(rows)
    assert simhash.linked(none).count() == 0


@pytest.mark.parametrize("segment", [1, 10, 1 << 20])
def test_fingerprint_of_segments(monkeypatch, segment):
    monkeypatch.setattr(simhash, "SEGMENT", segment)
    for text in ["", "one", "One two", "one two three", "  a\tb \n c d ", prose(3, 500), "é中 " * 40, "x" * 3000 + " y"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_blocks_cover_free_bits():
    for mask in (0, 0xFFFF, 0xF0F0_0000_0000_000F):
        cuts = [b & ~mask for b in simhash.blocks(mask)]
        assert sum(cuts) == (1 << 64) - 1 - mask and all(b & mask == mask for b in simhash.blocks(mask))


def test_trees_find_all_within_radius():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centres]))
    key = np.sort(rng.integers(0, 3, len(prints)))
    _, key = np.unique(key, return_inverse=True)
    roots, codes, children = simhash.grown(prints, key)
    query, node = simhash.within(prints, roots[key], prints, codes, children)
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if key[i] == key[j] and int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert set(zip(query.tolist(), node.tolist(), strict=True)) == want


# ---- divergence


def brute_audit(rows, least=3, top=200):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)), lang or "", source or "") for t, lang, source in rows]
    out = collections.Counter()
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        seen = collections.Counter(t for words, _, _ in own for t in set(words))
        kept = [t for t, n in seen.items() if n >= least]
        counts = {s: collections.Counter(t for words, _, x in own if x == s for t in words if seen[t] >= least) for s in {d[2] for d in own}}
        whole = sum(counts.values(), collections.Counter())
        v = len(kept)

        def p(c, t, v=v):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        def f(x, y):
            return (x - y) ** 2 // y

        for s, c in counts.items():
            pair = sorted((-sum(f(p(c, t), p(d, t)) for t in kept), r.encode()) for r, d in counts.items() if r != s)
            term = sorted((-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t))[:top]
            for part, found in (("pair", pair), ("term", term)):
                out.update((lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found))
    return out


def sourced_rows():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        lang = ["en", "de", None, "xx"][k % 4] if k < 290 else "few"
        words = [f"w{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26)}" for x in rng.zipf(1.4, 30) % 600]
        rows.append((" ".join(words) + " Äpfel ÄPFEL Zig-zag3zag", lang, f"s{k % 7 * (k % 3)}"))
    return [*rows, ("", "en", "blank"), (None, "void", "a"), ("once", "void", None)]


@pytest.mark.parametrize(("vocabulary", "at_once"), [(1 << 19, 1 << 20), (40, 8)])
def test_divergence_equals_brute_force(spark, monkeypatch, vocabulary, at_once):
    monkeypatch.setattr(divergence, "VOCABULARY", vocabulary)
    monkeypatch.setattr(divergence, "AT_ONCE", at_once)
    monkeypatch.setattr(divergence, "HELD", at_once)
    rows = sourced_rows()
    got = divergence.audited(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_audit(rows)


def test_divergence_of_odd_rows(odd, none):
    assert collections.Counter(tuple(r) for r in divergence.audited(odd).collect()) == brute_audit([(r[1], r[2], r[3]) for r in odd_rows()])
    assert divergence.audited(none).count() == 0


def test_probabilities_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(int(c), int(c + d)) for c, d in rng.integers(1, 2**52, (300, 2))] + [(0, 1), (2**52, 2**52 + 1)]
    frame = spark.createDataFrame(rows, "c long, whole long").select("c", "whole", divergence.probability(F.col("c"), F.col("whole")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.whole for r in frame.collect())


# ---- importance


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute_resampled(rows, target):
    corpus, wanted = (collections.Counter(b for t in texts for b in brute_features(t)[1]) for texts in ([t for _, t in rows], target))
    s, t = sum(corpus.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * t_ / ((corpus[b] + 1.0) * u))) for b, (t_, u) in enumerate([(float(s), float(t))] * 10_000)]
    out = []
    for i, text in rows:
        words, found = brute_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(best[: 5 * len(best) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("joined", [40, 1 << 20])
def test_importance_equals_brute_force(spark, odd, none, monkeypatch, joined):
    monkeypatch.setattr(importance, "JOINED", joined)
    rows = [(k, prose(k, 5 + k % 60) + (" Ünder_score 42nd\x00x" if k % 3 else "")) for k in range(200)] + [(r[0] and r[0] + 1000, r[1]) for r in odd_rows()]
    target = [prose(7, 60), None, "", prose(8, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = collections.Counter(tuple(r) for r in importance.resampled(docs, wanted).collect())
    assert got == brute_resampled(rows, target)
    assert any(r[4] for r in got)


def test_importance_of_empty_tables(odd, none):
    assert importance.resampled(none, odd).count() == 0
    assert collections.Counter(tuple(r) for r in importance.resampled(odd, none).collect()) == brute_resampled([(r[0], r[1]) for r in odd_rows()], [])
