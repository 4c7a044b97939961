"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

Terms of a language are those that CountVectorizer keeps with minDF = MIN_DOCS and the greatest vocabulary size; it makes
exact sparse count vectors. Where texts are cut into terms, those of JOINED bytes are put together first, so that CountVectorizer reads
a term a few times for all of them instead of at each occurrence:

* it is fitted to MIN_DOCS term sets of each language, the k-th with the terms of k documents or more. A term is in MIN_DOCS sets
  of all groups of texts just if it is in MIN_DOCS documents: no group counts more than MIN_DOCS, and one that counts them all is enough.
* it makes vectors of term sets of each source, one set for the terms of each count. The sum of these vectors, times the count, is the sum
  of the documents' count vectors.

Sets are cut into rows of SET terms. A vocabulary goes through the driver, so a language whose terms would be more than
VOCABULARY is fitted in several parts, each with the terms of one hash class; parts are dealt out once, so all work stays in
proportion to the input. Vectors are summed per source as sparse entries (index, count).

A source's probability of a term is ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, so terms that it lacks all have one value p0. The
divergence ``f(p, q) = floor((p - q)^2 / q)`` of two sources, summed over the V terms, is made of three sparse parts: f over the terms
of each source alone against the other's p0, by counts of equal counts; a constant for terms of neither; and, for terms of both, what they
differ by from the first. The last one is summed in the tasks, term by term, so that pairs of sources are rows only as partial sums.

* Null text, lang and source count as ''. Rows need no id; repeated rows count as often as they occur.
* Groups without terms, and languages without kept terms, have their pairs (value 0 if V = 0). An empty table gives an empty result.
* Ties in value are ordered by item. A very long text is cut into terms at once, in one task. Other columns are not read.
* Languages are listed on the driver and fitted one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import filled, new_path, settle

#: For each byte of UTF-8 what it is in a term, A-Z in lower case, or 0 where it is in none.
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = 0
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
MIN_DOCS = 3
MAX_VOCABULARY = (1 << 31) - 1
#: Distinct terms that are fitted together, about.
VOCABULARY = 1 << 21
SCALE = 1000
SCALES = 3
TOP = 200
#: A term that each fit gets in addition, in MIN_DOCS documents: a vocabulary must not be empty. No text has it.
GUARD = "\x00"
#: Groups up to which their table is broadcast; more are joined by shuffles.
SMALL = 1 << 16
#: Distinct terms are counted among one in so many kinds of them, to tell how many fits a language needs.
SAMPLED = 16
FIT, VECTOR, SAMPLE = "fit", "vector", "sample"
#: Bytes of text that are cut into terms together.
JOINED = 1 << 24
#: Terms of a row of a term set.
SET = 512
#: Entries of vectors that a task holds before it sums them.
HELD = 1 << 21
#: Pairs of sources that are worked out in one step.
AT_ONCE = 1 << 20


def _groups(batches) -> Iterator[tuple[list[bytes], list[str], list[int]]]:
    """Texts that are cut into terms together, with their source and the number of their language; a longer one ends its group."""
    group, size = ([], [], []), 0
    for batch in batches:
        for text, source, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = text.as_py() or b""
            for part, value in zip(group, (text, source, lang), strict=True):
                part.append(value)
            size += len(text) + 1
            if size >= JOINED:
                yield group
                group, size = ([], [], []), 0
    if group[0]:
        yield group


def term_lists(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Of each occurrence of a term the text that it is in and which term it is; and the terms, in lower case."""
    joined = _LETTER[np.frombuffer(b" ".join(texts), np.uint8)]
    inside = joined != 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined[inside])).dictionary_encode()
    starts = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return np.repeat(np.arange(len(texts)), np.diff(starts)), found.indices.to_numpy().astype(np.int64), found.dictionary


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    differ = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        differ |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], differ])[: len(columns[0])])


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def _sets(kind: str, of: np.ndarray, weights: np.ndarray, terms: pa.StringArray, sources: list[str], langs: list[int]) -> pa.RecordBatch:
    """Rows of at most SET terms of one weight. of: of each term the place of its source and language, in order, and by weight."""
    runs = _first(of, weights)
    place = np.arange(len(of)) - np.repeat(runs, _lengths(runs, len(of)))
    cuts = np.flatnonzero(place % SET == 0)
    which = pa.array(of[cuts])
    rows = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(of)), pa.int32()), terms)
    return pa.RecordBatch.from_arrays(
        [rows, pa.array(weights[cuts], pa.int64()), pa.array(sources, pa.string()).take(which), pa.array([kind] * len(cuts), pa.string()), pa.array(langs, pa.int32()).take(which)],
        ["terms", "weight", "source", "kind", "lang_no"])


def _combined(batches):
    """Term sets of groups of texts: what CountVectorizer is fitted to (kind FIT), what it makes vectors of (VECTOR), and one in SAMPLED
    kinds of terms, told by the sum of their bytes (SAMPLE)."""
    for texts, sources, langs in _groups(batches):
        doc, term, terms = term_lists(texts)
        n = max(1, len(terms))
        key = doc * n + term
        key.sort()
        first = _first(key)
        times = _lengths(first, len(key))
        doc, term = np.divmod(key[first], n)
        if not len(term):
            continue

        every = sorted(set(zip(langs, sources, strict=True)))
        number = {x: k for k, x in enumerate(every)}
        key = np.array([number[x] for x in zip(langs, sources, strict=True)])[doc] * n + term
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = _first(key)
        docs, counts = _lengths(first, len(key)), np.add.reduceat(times, first)
        group, term = np.divmod(key[first], n)
        order = np.lexsort((counts, group))
        yield _sets(VECTOR, group[order], counts[order], terms.take(pa.array(term[order])), [s for _, s in every], [k for k, _ in every])

        of_lang = sorted(set(langs))
        key = np.searchsorted(of_lang, [k for k, _ in every])[group] * n + term
        order = np.argsort(key, kind="stable")
        key, docs = key[order], docs[order]
        first = _first(key)
        docs = np.add.reduceat(docs, first)
        lang, term = np.divmod(key[first], n)
        none, once = [""] * len(of_lang), np.ones(len(lang), np.int64)
        for k in range(MIN_DOCS):
            has = docs > k
            if has.any():
                yield _sets(FIT, lang[has], once[has], terms.take(pa.array(term[has])), none, of_lang)
        ends = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, 4 * terms.offset)
        sums = np.add.reduceat(np.frombuffer(terms.buffers()[2], np.uint8, ends[-1]), ends[:-1], dtype=np.int64)
        has = sums[term] % SAMPLED == 0
        if has.any():
            yield _sets(SAMPLE, lang[has], once[has], terms.take(pa.array(term[has])), none, of_lang)


def probability(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE ** SCALES * (count + 1) / whole) by long division, exact while SCALE * whole fits 64 bits."""
    left, found = count + 1, F.lit(0).cast("long")
    for _ in range(SCALES):
        found = found * SCALE + _div(left * SCALE, whole)
        left = left * SCALE % whole
    return found + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts above 0 of kept terms: lang, source, term, count. And how many each language keeps: lang, v."""
    spark = docs.sparkSession
    langs = [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])[F.col("lang")] if langs else F.lit(0)
    path = new_path(spark, "terms")
    schema = "terms array<string>, weight long, source string, kind string, lang_no int"
    docs.select("text", "source", number.alias("lang_no")).mapInArrow(_combined, schema).write.partitionBy("lang_no", "kind").parquet(path)
    own = spark.read.schema(schema).parquet(path)
    sizes = own.where(F.col("kind") == SAMPLE).select("lang_no", F.explode("terms").alias("term")).groupBy("lang_no").agg(F.approx_count_distinct("term").alias("n"))
    distinct = {r.lang_no: r.n * SAMPLED for r in sizes.collect()}
    counts, kept = spark.createDataFrame([], "lang string, source string, term string, count long"), []
    for k, lang in enumerate(langs):
        parts = [_fitted(x) for x in _parts(own.where((F.col("lang_no") == k) & (F.col("kind") != SAMPLE)), -(-distinct.get(k, 0) // VOCABULARY))]
        counts = reduce(DataFrame.unionByName, [c.withColumn("lang", F.lit(lang)) for c, _ in parts], counts)
        kept.append((lang, sum(v for _, v in parts)))
    return counts, spark.createDataFrame(kept, "lang string, v long")


def _dealt(parts: int):
    """Of each term set its terms of each hash class."""

    def deal(batches):
        for batch in batches:
            for k, of in enumerate(batch.column(0).to_pylist()):
                by_part: dict[int, list[str]] = {}
                for term in of:
                    by_part.setdefault(crc32(term.encode()) % parts, []).append(term)
                same = pa.array([k] * len(by_part), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(by_part.values()), pa.list_(pa.string())), *[c.take(same) for c in batch.columns[1:]], pa.array(list(by_part), pa.int32())],
                    ["terms", "weight", "source", "kind", "part"])

    return deal


def _parts(sets: DataFrame, parts: int) -> list[DataFrame]:
    """The term sets; if more parts than one, with the terms of each hash class, written once dealt by class."""
    if parts <= 1:
        return [sets]
    path, schema = new_path(sets.sparkSession, "parts"), "terms array<string>, weight long, source string, kind string, part int"
    sets.select("terms", "weight", "source", "kind").mapInArrow(_dealt(parts), schema).write.partitionBy("part", "kind").parquet(path)
    every = sets.sparkSession.read.schema(schema).parquet(path)
    return [every.where(F.col("part") == k).drop("part") for k in range(parts)]


def _summed(batches):
    """Of rows (source, indices, values, weight) the sum of each source's vectors, as entries; more than one for an entry if there are many."""
    sources: dict[str, int] = {}
    keys, counts, held = [], [], 0

    def joined():
        every, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        first = _first(every)
        return every[first], np.add.reduceat(n, first)

    def entries():
        key, n = joined()
        source = pa.DictionaryArray.from_arrays(pa.array(key >> 32, pa.int32()), pa.array(list(sources), pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([source, pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["source", "index", "count"])

    for batch in batches:
        own = np.array([sources.setdefault(s, len(sources)) for s in batch.column(0).to_pylist()], np.int64)
        of = batch.column(1)
        lengths = of.value_lengths().to_numpy()
        keys.append(np.repeat(own, lengths) << 32 | of.flatten().to_numpy())
        counts.append(batch.column(2).flatten().to_numpy().astype(np.int64) * np.repeat(batch.column(3).to_numpy(), lengths))
        held += len(keys[-1])
        if held > HELD:
            key, n = joined()
            keys, counts, held = [key], [n], len(key)
            if held > HELD // 2:
                yield entries()
                sources, keys, counts, held = {}, [], [], 0
    if held:
        yield entries()


def _fitted(sets: DataFrame) -> tuple[DataFrame, int]:
    """source, term, count over the sparse vectors of CountVectorizer, and how many terms it keeps."""
    spark = sets.sparkSession
    guard = spark.range(MIN_DOCS).select(F.array(F.lit(GUARD)).alias("terms"))
    fitted_to = sets.where(F.col("kind") == FIT).select("terms").unionByName(guard)
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(MIN_DOCS), vocabSize=MAX_VOCABULARY).fit(fitted_to)
    path = new_path(spark, "vocabulary")
    model.write().save(path)
    vocabulary = spark.read.schema("vocabulary array<string>").parquet(f"{path}/data")
    words = vocabulary.select(F.posexplode("vocabulary").alias("index", "term"))
    vector = F.unwrap_udt(F.col("vector"))
    vectors = model.transform(sets.where(F.col("kind") == VECTOR)).select("source", vector["indices"].alias("indices"), vector["values"].alias("values"), "weight")
    parts = vectors.mapInArrow(_summed, "source string, index int, count long").repartition("index")
    sums = parts.groupBy("source", "index").agg(F.sum("count").alias("count"))
    return settle(sums.join(words, "index").select("source", "term", "count"), "sums"), vocabulary.select(F.size("vocabulary")).first()[0] - 1


def _of_both(batches):
    """Of terms with their groups' (id, count, p, p0): for each two groups, what f over terms of both differs by from f over terms of one."""

    def f(p, q):
        return (p - q) ** 2 // q

    def worked(ids, p, p0):
        """ids, p, p0: a row for each term, as many columns as it has groups. Sums by pair, row blocks of groups at a time."""
        width = ids.shape[1]
        high = max(1, min(width, AT_ONCE // width))
        tall = max(1, AT_ONCE // (width * high))
        for k in range(0, len(ids), tall):
            for g in range(0, width, high):
                mine, other = (slice(k, k + tall), slice(g, g + high), None), (slice(k, k + tall), None)
                a, b = np.broadcast_arrays(ids[mine], ids[other])
                value = f(p[mine], p[other]) - f(p[mine], p0[other]) - f(p0[mine], p[other]) + f(p0[mine], p0[other])
                differ = a != b
                yield summed(a[differ], b[differ], value[differ])

    def summed(a, b, value):
        order = np.lexsort((b, a))
        a, b, value = a[order], b[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
        return a[first], b[first], np.add.reduceat(value, first) if len(first) else value

    for batch in batches:
        of = batch.column(0)
        sizes = of.value_lengths().to_numpy()
        start = np.concatenate([[0], np.cumsum(sizes)])
        ids, _, p, p0 = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in of.flatten().flatten()]
        found = []
        for width in np.unique(sizes[sizes > 1]):
            at = start[:-1][sizes == width][:, None] + np.arange(width)
            found += worked(ids[at], p[at], p0[at])
        a, b, value = summed(*map(np.concatenate, zip(*found, strict=True))) if found else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(value)], ["a", "b", "value"])


def _pairs(groups: DataFrame, few: Callable[[DataFrame], DataFrame], entries: DataFrame, terms: DataFrame) -> DataFrame:
    """a, b, value: divergence of group a from group b of its language."""
    other = few(groups.select("lang", F.col("id").alias("b"), F.col("p0").alias("q0")))  # languages are few and of uneven size: a shuffle by language would be a few large tasks
    two = groups.withColumnRenamed("id", "a").join(other, "lang").where("a <> b")
    neither = two.select("a", "b", (F.col("v") * distance(F.col("p0"), F.col("q0"))).alias("value"))
    equal = entries.groupBy("lang", F.col("id").alias("a"), "p", "p0").agg(F.count("*").alias("n")).join(other, "lang").where("a <> b")
    p, p0, q0, n = (F.col(c) for c in ("p", "p0", "q0", "n"))
    one = equal.groupBy("a", "b").agg(F.sum(n * (distance(p, q0) - distance(p0, q0))).alias("forth"), F.sum(n * (distance(q0, p) - distance(q0, p0))).alias("back"))
    one = settle(one, "one")
    forth, back = one.select("a", "b", F.col("forth").alias("value")), one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value"))
    both = terms.where(F.size("of") > 1).select("of").mapInArrow(_of_both, "a long, b long, value long")
    return neither.unionByName(forth).unionByName(back).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: of each group its divergence from the others, and the TOP terms it has more often than its language."""
    own = docs.select(*[filled(F.col(c)).alias(c) for c in ("text", "lang", "source")])
    counts, kept = _counted(own)
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(F.broadcast(kept), "lang")
    whole = (F.coalesce("n", F.lit(0)) + F.col("v")).alias("whole")
    groups = groups.select(F.monotonically_increasing_id().alias("id"), "lang", "source", "v", whole)
    groups = settle(groups.withColumn("p0", probability(F.lit(0).cast("long"), F.greatest("whole", F.lit(1)))), "groups")
    few = F.broadcast if groups.count() <= SMALL else (lambda frame: frame)
    entries = counts.join(few(groups), ["lang", "source"]).withColumn("p", probability(F.col("count"), F.col("whole")))
    terms = settle(entries.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "count", "p", "p0")).alias("of")), "entries")

    names = few(groups.select(F.col("id").alias("a"), "lang", "source"))
    items = few(groups.select(F.col("id").alias("b"), F.col("source").alias("item")))
    pair = _pairs(groups, few, entries, terms).join(names, "a").join(items, "b").select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    # a group's whole is its count of terms and v; its language's, the groups' counts and v once
    of_all = groups.groupBy("lang").agg((F.sum(F.col("whole") - F.col("v")) + F.first("v")).alias("all"))
    n = F.aggregate("of", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["count"])
    usual = terms.join(F.broadcast(of_all), "lang").select("term", "of", n.alias("n"), "all").select("term", "of", probability(F.col("n"), F.col("all")).alias("q"))
    more = usual.select("term", "q", F.explode("of").alias("x")).select(F.col("x.id").alias("a"), F.col("term").alias("item"), F.col("x.p").alias("p"), "q").where("p > q")
    more = more.select("a", "item", distance(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("a").orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= TOP)
    term = best.join(names, "a").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pair.withColumn("rank", F.row_number().over(place)).unionByName(term)
