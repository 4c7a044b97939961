"""Toxicity against plain loops over clauses, shards of uneven records and versions of their map, blocks and random access of token files."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import prose
from veilscan.llm import sharding, token_files, toxicity as X

# ---- toxicity


def plain_hit(model, low, at):
    """The heaviest stem that the word at a place begins with."""
    best = ("", 0.0)
    stems = [(s, X.THREAT, 1.0) for s in X.THREATS] + [(s, X.INSULT, w) for s, w in model.insults.items()]
    for stem, kind, weight in sorted(stems, key=lambda s: len(s[0].rstrip("$"))):
        end = at + len(stem.rstrip("$"))
        whole = not stem.endswith("$") or end >= len(low) or not low[end].isalpha()
        if low.startswith(stem.rstrip("$"), at) and whole and weight > best[1]:
            best = kind, weight
    return best


def plain_clauses(model, text):
    low, total = text.lower(), Counter()
    for clause in re.finditer(r"[^.!?;:\n]+", low):
        negated, said, someone, best = 0, False, False, (0.0, 0, "")
        for word in X.WORD.finditer(low, *clause.span()):
            begins = word.start() == 0 or not (low[word.start() - 1].isalpha() or low[word.start() - 1] == "'")
            kind, weight = plain_hit(model, low, word.start()) if begins else ("", 0.0)
            if kind:
                name = "negated " + kind if negated else "reported " + kind if said else kind
                best = max(best, (weight, name == kind, name))
            negated = max(0, negated - 1)
            if not kind and word.group() in X.NEGATIONS:
                negated = X.REACH
            elif not kind and word.group() in X.REPORTS:
                said = True
            elif not kind and word.group() in X.TARGETS:
                someone = True
        if best[2]:
            total[best[2] + (" at target" if someone else "")] += best[0]
    return total


def texts(n):
    rng = random.Random(11)
    words = [*X.INSULTS, *X.THREATS, *list(X.TARGETS)[:12], *list(X.NEGATIONS)[:9], *list(X.REPORTS)[:9], "plain", "word", "killing", "idiots", "quorbel", "quorb",
             "anti-idiot", "l'idiot", "x", "42kill"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n", "; "]) for _ in range(rng.randint(0, 40))).title()
            if k % 3 == 0 else "".join(rng.choice(words) + rng.choice([" ", " ", ". "]) for _ in range(rng.randint(0, 40))) for k in range(n)]


def test_clauses_and_scores_equal_plain_loops(spark):
    kinds = {k: 1.0 + 0.25 * n for n, k in enumerate(X.KINDS)}
    model = X.Model({"idiot": 1.0, "moron": 0.7, "quorb$": 1.5, "quorbel": 1.2, "clown": 0.3}, kinds, -2.0)
    rows = [*enumerate(texts(800)), (900, ""), (901, None), (902, "..!"), (903, "kill " * 20_000)]
    for _, text in rows:
        assert model.clauses(text or "") == plain_clauses(model, text or ""), text
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in X.scored(frame, model).collect()}
    for i, text in rows:
        z = -2.0 + sum(kinds[k] * math.log1p(w) for k, w in plain_clauses(model, text or "").items())
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-max(-50, min(50, z)))), rel_tol=1e-9)
        assert got[i].predicted == (got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


# ---- shards


def test_shards_of_uneven_records_are_near_equal(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "x" * int(rng.paretovariate(1.2) * 20)) for k in range(4000)]
    path = str(tmp_path / "map")
    placed = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), map_path=path).collect()
    loads = Counter()
    for r in placed:
        loads[r.shard] += r.size
    largest = max(r.size for r in placed)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= max(largest, sum(loads.values()) // 100)
    versions = [{r.virtual_slot: r.shard for r in sharding.load(spark, path, v).collect()} for v in (1, 2)]
    assert all(len(v) == sharding.SLOTS for v in versions) and versions[0] != versions[1]
    assert all(versions[1][r.virtual_slot] == r.shard for r in placed)


def test_a_record_larger_than_a_shard(spark):
    rows = [(k, "y" * 50) for k in range(300)] + [(999, "z" * 100_000)]
    placed = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    loads = Counter()
    for r in placed:
        loads[r.shard] += r.size
    giant = next(r.shard for r in placed if r.doc_id == 999)
    rest = [n for s, n in loads.items() if s != giant]
    assert len(rest) == 3 and max(rest) - min(rest) <= 20 * 51


# ---- token files


@pytest.mark.parametrize("block", [64, 100, 1 << 16])
def test_blocks_and_random_access(tmp_path, block):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rows = [(k, prose(k, 1 + 7 * (k % 40))) for k in range(60)] + [(61, None), (62, "")]
    whole = [np.array([*library.encode(t or "", add_special_tokens=False).ids, token_files.END], np.uint32) for _, t in rows]
    name = str(tmp_path / "one.ids")
    with fs.LocalFileSystem().open_output_stream(name) as stream:
        writer = token_files.Writer(stream, token_files.bits_for(library.get_vocab_size()), block)
        for (doc_id, _), ids in zip(rows, whole, strict=True):
            writer.add(doc_id, ids)
        writer.close()
    flat = np.concatenate(whole)
    with fs.LocalFileSystem().open_input_file(name) as file:
        reader = token_files.Reader(file)
        assert len(reader.places) - 1 == -(-len(flat) // block)
        for k, ids in enumerate(whole):
            assert (reader.document(k) == ids).all() and reader.docs[k] == rows[k][0]
        rng = np.random.default_rng(block)
        for a, b in np.sort(rng.integers(0, len(flat) + 1, (200, 2))).tolist() + [[0, len(flat)], [block - 1, block + 1], [5, 5]]:
            assert (reader.ids(a, min(b, len(flat))) == flat[a : min(b, len(flat))]).all()


def test_token_files_of_several_parts(spark, tmp_path):
    rows = [(k, prose(k, 5 + k % 50)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    manifest = token_files.write(docs, str(tmp_path / "ids"))
    assert manifest.agg(F.sum("n_docs")).first()[0] == 400
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read(manifest, str(tmp_path / "ids")).collect())
    assert [r[1] for r in found] == list(range(400)) and all(a[0] + a[2] == b[0] for a, b in zip(found, found[1:], strict=False))


# ---- mixing


def test_documents_whose_share_reaches_one_are_certain(spark):
    from veilscan.llm import mixing

    rng = random.Random(4)
    rows = [(k, ["a", "b", None][k % 3], int(rng.paretovariate(0.7) * 5)) for k in range(300)] + [(900, "a", 0), (901, "c", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    parts = {"a": 0.97, "b": 0.5, None: 0.999, "c": 0.0}
    plan, want = [], {}
    for source, part in parts.items():
        sizes = [n for _, s, n in rows if s == source]
        roots = [math.floor(math.sqrt(n) * 16) for n in sizes]
        rest, root_sum = part * sum(sizes), sum(n * r for n, r in zip(sizes, roots, strict=True))
        plan.append((source, sum(sizes), root_sum, rest, 0, rest))
        sure, free, left = math.inf, rest, root_sum
        while free > 0 and left / free < sure and any(r >= left / free and n for n, r in zip(sizes, roots, strict=True)):
            new = left / free
            taken = [(n, r) for n, r in zip(sizes, roots, strict=True) if r >= new and n]
            if len(taken) == len([r for n, r in zip(sizes, roots, strict=True) if r >= sure and n]):
                break
            sure, free, left = new, rest - sum(n for n, _ in taken), root_sum - sum(n * r for n, r in taken)
        want[source] = sure, free, left
    plan = spark.createDataFrame(plan, "source string, source_size long, root_size long, target double, whole long, rest double")
    got = {r.source: (r.sure, r.free, r.roots) for r in mixing.with_certain(frame, plan).collect()}
    assert got.keys() == want.keys() and want["a"][0] < math.inf and want["b"][0] == math.inf
    for source in want:
        assert np.allclose(got[source], want[source], rtol=1e-12)
    cut = mixing.cuts(frame, mixing.with_certain(frame, plan))
    drawn = mixing.keyed(frame, cut).where(mixing.copies() > 0).select("doc_id").collect()
    certain = {k for k, s, n in rows if n and math.floor(math.sqrt(n) * 16) >= want[s][0]}
    assert certain and certain <= {r.doc_id for r in drawn}
