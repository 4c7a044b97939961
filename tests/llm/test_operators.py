"""The training-data operators against plain code, on small and on odd inputs."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veilscan.llm import bpe, counts, mixing, ngram_join, quality, sharding, token_files, topk, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, label string, row int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    base = prose(1, 60)
    near = base.rsplit(" ", 2)[0] + " changed words"
    texts = [None, "", "   \n\t ", base, base, near, base.upper(), "one two", "One TWO", prose(2, 4000), prose(3, 12) + "\n" + prose(3, 12), "a  b \n\n c ",
             "you are an idiot and a moron", "<|endoftext|> <s> é中𝔘", "x" * 5000, prose(4, 40) + " " + prose(4, 40)]
    rows = [(k, t, "en", ["s1", "s2", None][k % 3], 0, "z", None, 7) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, None, None, None, None, None, None), (3, prose(5, 30), None, "s1", None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(size=6).round(1)]) for k in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (320, [0.0] * 6), (340, []), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<double>, id string")
    got = {tuple(r) for r in topk.top_k(frame, F.col("id") % 20 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect()}
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = set()
    for q in good:
        if q % 20 == 0:
            best = sorted((-dot(good[q], v), i) for i, v in good.items() if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def brute_top(rows, k):
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    out = set()
    for q in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:k]
            out |= {(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("largest", [1e3, 3e6, 1e12, 4e16])
def test_top_k_of_large_components_over_small_blocks(spark, monkeypatch, largest):
    """Scores of 64 bits and beyond are exact, in whatever type; ties reach over the borders of blocks."""
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 4) * largest / 3 + rng.integers(0, 2, 4)]) for k in range(200)]
    rows += [(k, [0.5, -0.25, 0.0, 1.0]) for k in range(200, 260)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(frame, F.col("id") % 20 == 0, k=7).select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, 7)


def brute_components(rows):
    def shingle_set(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = sorted((top(i), top(j)))
                parent[b_] = a_
    return collections.Counter((i, len(x), None if i is None else top(i)) for i, x in sets)


def near_copies():
    """Groups of edited copies around the threshold, a passage that many share, and frequent shingles."""
    rng = random.Random(9)
    rows, passage = [], prose(50, 25)
    for group in range(6):
        words = prose(100 + group, 40 + 10 * group).split()
        for _ in range(25):
            edited = list(words)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = f"w{rng.random()}"
            rows.append(" ".join(edited[: rng.randint(int(0.7 * len(edited)), len(edited))]))
    rows += [prose(300 + k, rng.randint(5, 60)) + " " + passage for k in range(60)]
    return list(enumerate(rows))


@pytest.mark.parametrize("frequent", [256, 8])
def test_join_equals_brute_force(spark, odd, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "_FREQUENT_POWER", frequent.bit_length() - 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = near_copies()
    got = collections.Counter(tuple(r) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("square", [0, 256])
def test_join_under_one_shared_passage(spark, monkeypatch, square):
    """All documents share a passage, so its shingles lead to all of them; groups are worked out by square and by class."""
    monkeypatch.setattr(ngram_join, "SQUARE", square)
    rng = random.Random(square)
    passage = prose(77, 30)
    rows = []
    for k in range(400):
        own = prose(k // 4, 6 + k % 9).split()
        if k % 4:
            own[rng.randrange(len(own))] = f"w{k}"
        rows.append((k, " ".join(own) + " " + passage))
    got = collections.Counter(tuple(r) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_components(rows)


def test_feasible_rows_by_class_equal_the_square(monkeypatch):
    rng = np.random.default_rng(3)
    for trial in range(40):
        count = int(rng.integers(2, 120))
        n = rng.integers(2, 60, count)
        group = np.column_stack([np.full(count, 5), np.arange(count), rng.integers(0, int(rng.integers(1, 12)), count), n, np.minimum(n, rng.integers(1, 20, count))])
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in group.T], ["combination", "node", "label", "n", "most"])
        found = []
        for square in (0, 1000):
            monkeypatch.setattr(ngram_join, "SQUARE", square)
            found.append([np.array(b.to_pandas()) for b in ngram_join._feasible([batch])][0])
        by_class, by_square = ({(int(a), int(b)) for a, b, _ in f} for f in found)
        assert by_class == by_square, trial
        # what the square joins, the classes join too
        top = {int(x): int(x) for f in found for x in f[:, 1:].ravel()}

        def root(x, top=top):
            return x if top[x] == x else root(top[x])

        for _, x, y in found[0]:
            top[root(int(x))] = root(int(y))
        assert all(root(int(x)) == root(int(y)) for _, x, y in found[1])


def test_a_large_group_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    count = 50_000
    n = rng.integers(20, 400, count)
    group = np.column_stack([np.full(count, 1), np.arange(count), np.arange(count), n, np.minimum(n, rng.integers(5, 60, count))])
    tracemalloc.start()
    found = ngram_join._feasible_by_class(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == count and peak < 100e6


def test_join_of_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert collections.Counter(tuple(r) for r in ngram_join.joined(odd).collect()) == brute_components(rows)
    assert ngram_join.joined(none).count() == 0
    kept = ngram_join.kept(odd)
    assert kept.columns == odd.columns
    firsts = {c for (i, _, c), _ in brute_components(rows).items() if i is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(firsts)
    assert kept.where("doc_id is null").count() == 1


def test_prefixes_of_frequent_shingles_meet():
    rng = np.random.default_rng(4)
    for n in (2, 3, 4, 9, 30, 200):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        listed = ngram_join.Counts([(int(v), 10_000) for v in x.view(np.int64)])
        y = np.sort(x[: ngram_join.needed(len(x))])
        a, b = (ngram_join.combinations(s, listed) for s in (x, y))
        assert len(y) < 2 or set(a[0]) & set(b[0]) or set(a[1]) & set(b[1])


def test_quality_measures(odd, none):
    def measures(text):
        text = text or ""
        words = WORD.findall(text)
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.judged(odd)
    got = collections.Counter((r.doc_id, *[r[n] for n in names], r.base_failed) for r in judged.collect())
    want = collections.Counter((r[0], *(m := measures(r[1])), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in odd_rows())
    assert got == want
    assert judged.where("base_failed and kept").count() == 0
    assert quality.kept(odd).columns == odd.columns
    assert quality.kept(odd).count() == judged.where("kept").count()
    assert quality.kept(none).count() == 0


def test_cascade_order_does_not_change_the_verdict(odd):
    verdicts = [odd.where(quality.cascade(F.col("text"), rules).isNull()).count() for rules in (quality.RULES, quality.RULES[::-1])]
    assert verdicts[0] == verdicts[1]


def test_sharding(odd, none):
    rows = sharding.sharded(odd, shards=3).collect()
    assert len(rows) == len(odd_rows())
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()}
    for shard in range(3):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.sharded(none).count() == 0


def test_a_new_shard_takes_slots_only_into_itself(spark):
    slots = spark.createDataFrame([(k, 100 + k % 7, 1) for k in range(64)], "virtual_slot long, bytes long, rows long")
    before = sharding.rebalanced(sharding.initial_map(slots, 4), 4)
    after = sharding.rebalanced(before, 5)
    moved = before.join(after.select("virtual_slot", F.col("shard").alias("new")), "virtual_slot").where("shard <> new")
    assert moved.count() > 0 and after.select("shard").distinct().count() == 5
    loads = [r[0] for r in after.groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert max(loads) - min(loads) <= 220


TEXTS = [r[1] or "" for r in odd_rows()]
ALPHABET = "ab  \n\t' sAé𝔘中\x1c\x85 1２3_-!<|endoftext|>'ll'S▁"


def fuzz(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_tiktoken_and_decodes(odd, none):
    path = public_tokenizers.path(bpe.VOCABULARY)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = TEXTS + fuzz(3000)
    coder = bpe.coder(path)
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.encoded(odd).collect()}
    assert got == {(r[0], len(library.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows()}
    assert bpe.encoded(none, with_ids=True).count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_counts_equal_sentencepiece(odd, none, monkeypatch, chunk):
    monkeypatch.setattr(counts, "CHUNK", chunk)
    path = public_tokenizers.path(counts.MODEL)
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), counts.counter(path)
    texts = TEXTS + fuzz(3000) + [" " * 70 + "the " * 40]
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    assert {(r.doc_id, r.n_tokens) for r in counts.counted(odd).collect()} == {(r[0], len(library.encode(r[1] or ""))) for r in odd_rows()}
    assert counts.counted(none).count() == 0


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    rows = [(k, prose(k, 30) + (f" {rng.choice(['quorbel', 'quorbas'])} " if k % 5 == 0 else " ") + prose(k + 999, 10)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, labels)
    scored = toxicity.scored(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    held = [(r.doc_id % 5 == 0, r.predicted) for r in scored if r.held_out]
    assert all(bool(p) == t for t, p in held)
    plain = toxicity.fitted(none.select("doc_id", "text"), labels.limit(0))
    by_id = {r.doc_id: r for r in toxicity.scored(odd, plain).collect()}
    assert by_id[12].predicted == 1 and all(0 <= r.score <= 1 for r in by_id.values())
    assert by_id[0].score == by_id[1].score == by_id[7].score
    assert toxicity.accepted(odd, plain).columns == odd.columns and toxicity.accepted(none, plain).count() == 0


def test_grammar_marks_clauses():
    model = toxicity.Model({"idiot": 1.0})
    kinds = lambda text: set(model.clauses(text))
    assert kinds("You are an idiot.") == {"insult at target"}
    assert kinds("what an idiot") == {"insult"}
    assert kinds("not an idiot") == {"negated insult"}
    assert kinds("someone said idiot") == {"reported insult"}
    assert kinds("nice. i will kill you! idiotic") == {"threat at target", "insult"}
    assert not kinds("antidiotic") and not kinds("")


def test_mixing(odd, none):
    rows = mixing.mixed(odd).collect()
    sizes = [len(WORD.findall(r[1] or "")) for r in odd_rows()]
    assert sorted(r.size for r in rows) == sorted(sizes)
    assert all(0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0) for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - 1.5 * sum(sizes)) < 1e-6
    again = mixing.mixed(odd.repartition(5)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    repeated = mixing.repeated(odd)
    assert repeated.columns == odd.columns
    assert sum(len(WORD.findall(r.text or "")) for r in repeated.collect()) == sum(r.taken for r in rows)
    assert mixing.mixed(none).count() == 0 and mixing.repeated(none).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing(bits):
    for n in (0, 1, 63, 64, 65, 700):
        ids = np.random.default_rng(n).integers(0, 2**bits, n).astype("<u4")
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and (token_files.unpack(data, n, bits) == ids).all()


def test_token_files(odd, none):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.written_and_read(odd).collect())
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in odd_rows()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END]
        want.append((start, doc_id, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.written_and_read(none).count() == 0


def test_url_filters(spark):
    page = lambda link: f"<html><LINK href='{link}' rel=canonical></html>"
    rows = [
        (1, "http://a.net/x?y", None), (2, "https://m.EXAMPLE.net/en/1#top", ""), (3, "http://q.com/1", page("http://a.net/zz")),
        (4, "http://q.com/2", page("/1#frag")), (5, "http://r.com/1", "<meta http-equiv='refresh' content='0; URL=//www.org/fr/x'>"),
        (6, "http://r.com/2", page("http://r.com/1") + "<meta http-equiv=refresh content=\"0;url=http://b.net/\">"),
        (7, None, page("http://a.net/")), (8, "nothing", None), (None, "http://anet/", None), (9, "http://x.net", None), (9, "http://x.net", None)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = collections.Counter(tuple(r) for r in url_filter.judged(pages).collect())
    assert got == collections.Counter([
        (1, "a.net", "/x", "net/", "block"), (2, "m.example.net", "/en/1", "example.net/en/", "allow"), (3, "q.com", "/1", None, "block"),
        (4, "q.com", "/2", None, "block"), (5, "r.com", "/1", None, "allow"), (6, "r.com", "/2", None, "allow"), (7, "", "", None, "allow"),
        (8, "", "", None, "allow"), (None, "anet", "/", None, "allow"), (9, "x.net", "", None, "allow"), (9, "x.net", "", None, "allow")])
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_decide(spark, odd, tmp_path):
    folder = str(tmp_path)
    odd.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    docs = spark.read.parquet(folder + "/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        after.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == docs.count()
    expected = {hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert {r.decoded_sha256 for r in out.collect()} == expected
