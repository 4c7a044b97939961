"""Importance resampling towards a target distribution, by hashed n-gram features.

Texts of an Arrow batch are joined with a separator byte that UTF-8 never holds, and one regex pass finds all words and separators. Features are
runs of 1 to ORDERS words; a feature's checksum continues that of the run without its last word. The separators' places are the
documents' offsets, in which each word is looked up (searchsorted), so that runs across two documents are masked before features are counted
(bincount) by bucket or by document.

The first pass counts buckets over all documents and over the target; the BUCKETS gains go through the driver, of fixed size. The second one
sums gains by document. The draw adds Gumbel noise from a hash of the id and takes the highest scores; ranks are places in a range
sort, numbered by partition, so no task sees all rows.

* Null, empty and wordless texts have no features and weight 0. Longer texts are read in pieces, so a very long one needs no more memory.
* Rows that share an id are drawn on their own, by the same noise. A row without an id has the noise of an empty one, and is last in ties.
* Rows equal in score and id are ranked in any order. Empty tables are allowed, for documents and for the target. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import settle

BUCKETS = 10_000
ORDERS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SCALE = 1000
#: Bytes of text that are joined.
JOINED = 1 << 20

_BREAK = b"\xff"
_TOKEN = re.compile(rb"[0-9a-z\x80-\xfe]+|" + _BREAK)
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The number of a text and a piece of it, cut between words."""
    for number, text in enumerate(texts):
        start = 0
        while start < len(text):
            cut = _GAP.search(text, start + JOINED) if start + JOINED < len(text) else None
            end = cut.start() if cut else len(text)
            yield number, text[start:end]
            start = end


def _joined(texts: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
    """Groups of pieces: the numbers of their texts, and the pieces joined."""
    numbers, pieces, size = [], [], 0
    for number, piece in _pieces(texts):
        numbers.append(number)
        pieces.append(piece)
        size += len(piece)
        if size >= JOINED:
            yield numbers, _BREAK.join(pieces)
            numbers, pieces, size = [], [], 0
    if pieces:
        yield numbers, _BREAK.join(pieces)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For groups of words: the number of each word's text, and for each order the buckets of the runs that end at the words, -1 where there is none.

    A group begins with the last words of the one before, so that runs in a text of several pieces are whole; those words come with no run."""
    carried, owner = [], np.zeros(0, np.int64)
    for numbers, joined in _joined(texts):
        tokens = _TOKEN.findall(joined.lower())
        breaks = np.flatnonzero(np.fromiter(map(_BREAK.__eq__, tokens), bool, len(tokens)))
        words = carried + ([t for t in tokens if t != _BREAK] if len(breaks) else tokens)
        offsets = breaks - np.arange(len(breaks))
        place = np.searchsorted(offsets, np.arange(len(words) - len(carried)), "right")
        owner = np.concatenate([owner, np.array(numbers, np.int64)[place]])
        spaced = [b" " + w for w in words]
        sums, found = list(map(crc32, words)), []
        for order in range(ORDERS):
            if order:
                sums = list(map(crc32, spaced[order:], sums))
            bucket = np.full(len(words), -1, np.int64)
            bucket[order:] = np.array(sums, np.int64) % BUCKETS
            bucket[order:][owner[order:] != owner[: len(words) - order]] = -1
            bucket[: len(carried)] = -1
            found.append(bucket)
        yield owner, found
        carried, owner = words[1 - ORDERS :], owner[1 - ORDERS :]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _bucket_counts(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, found in features(_texts(batch.column(0))):
            for bucket in found:
                counts += np.bincount(bucket[bucket >= 0], minlength=BUCKETS)
    met = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the column ``text`` are in each bucket."""
    rows = texts.select("text").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    counts[[r.bucket for r in rows]] = [r.n for r in rows]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight."""
    of_corpus, of_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = ((target + 1.0) * of_corpus) / ((corpus + 1.0) * of_target)
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], np.int64)


def _weights(gain: np.ndarray):
    def weigh(batches):
        for batch in batches:
            n = batch.num_rows
            words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
            for owner, found in features(_texts(batch.column(1))):
                for order, bucket in enumerate(found):
                    there = bucket >= 0
                    of = owner[there]
                    each = np.bincount(of, minlength=n)
                    words += each if order == 0 else 0
                    count += each
                    weight += np.bincount(of, gain[bucket[there]], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, count, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def weighted(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row. Both frames have a column ``text``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row; rows that are not drawn have no rank."""
    own = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = (F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0**32)
    score = F.col("weight") + F.floor(-SCALE * F.log(-F.log(noise)))
    rows = settle(weighted(docs, target).withColumn("score", score.cast("long")), "weighted").withColumn("fits", F.col("n_words") >= LEAST_WORDS)
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id")]
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the upper bits of the place are the partition, the lower ones the row in it
    placed = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fits").alias("fits")).orderBy("part").collect()
    drawn = PERCENT * sum(s.fits for s in sizes) // 100
    before, first = [], 0
    for s in sizes:
        before.append((s.part, first))
        first += s.n
    starts = F.broadcast(spark.createDataFrame(before, "part long, first long"))  # a row per partition of the sort
    ranked = placed.withColumn("part", part).join(starts, "part").withColumn("at", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (F.col("at") <= drawn), F.col("at")).alias("rank"))
