"""Texts in chunks and spans in rows, against the path that holds a document in one row."""

import random

import pytest
from pyspark.sql import functions as F

from veilscan import fixed_values as fv
from veilscan.config import DEFAULT
from veilscan.functions import checks
from veilscan.operators import chunks as C, detect as D, islands as I, resolve as RS, rules as R, spans as SP

PIECES = [
    "Mobile: +91 98765 43210", "write to a.b@mail.example.com", "PAN: ABCPK1234F", "diagnosed with anxiety disorder", "blood", "pressure", "medical",
    "certificate", "Dear Asha Rao", "regards,\n  Ravi Kumar", "5th", "may 2020", "january 5, 2021", "Rs", "4,50,000", "salary of 18 lakhs", "inr", "\n\n",
    "A/c No 12345678901", "4111 1111 1111 1111", "card", "bank account", "10.0.0.1", "fe80::1", "DE89 3704 0044 0532 0130 00", "555-12-3456",
    "2024-03-01", "name : Anil Rao", "employee", "net salary", "₹85,000", "\u0001", "é", "ünder", "x" * 90, " " * 70, "plain words", "of the", "hello", "K", "lakhs",
]


def made(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PIECES) + rng.choice([" ", " ", " ", "\n", ", ", ""]) for _ in range(n))


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "start", "end", "entity_type", "score", "value").collect())


@pytest.mark.parametrize("size", [1, 400])
def test_chunks_equal_the_whole_text(spark, size):
    texts = [made(k, 700) for k in range(8)] + ["", None, "short", "word " * 3000 + "PAN: ABCPK1234F", "x" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = rows(D.raw_findings(docs))
    assert len({w[3] for w in want}) > 10
    assert rows(C.raw_findings(docs, size=size)) == want
    pieces = C.chunked(docs.where(F.length("text") > 0), size=size)
    assert pieces.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 10
    ends = pieces.groupBy("doc_id").agg(F.sum(F.col("chunk_end") - F.col("chunk_start")).alias("n"))
    assert {r.doc_id: r.n for r in ends.collect()} == {k: len(t) for k, t in enumerate(texts) if t}


def test_context_windows_reach_over_borders(spark):
    """The label is in one chunk, the number in the next one; and the words that rule it out."""
    text = "we sent money to the bank account number of theirs which is of course " + "12345678901" + " and the rest follows " * 30
    docs = spark.createDataFrame([(k, "word " * k + text) for k in range(0, 60, 2)], "doc_id long, text string")
    assert rows(C.raw_findings(docs, size=50)) == rows(D.raw_findings(docs))


def test_no_match_reaches_over_a_barrier(spark):
    """What rules have around white space is never a barrier: each multi-word form, cut at each of its blanks."""
    forms = [t for t in fv.HEALTH_TERMS if " " in t] + ["5th may 2020", "1st january 2021", "2nd feb 2022", "3rd dec 2023", "rs 500", "inr 500", "usd 500",
                                                        "18 lakhs", "500 rupees", "dear Asha Rao", "regards,\n Ravi Rao"]
    frame = spark.createDataFrame([(f,) for f in forms], "t string").select("t", F.size(F.split("t", R.BARRIER)).alias("n"))
    assert [r.t for r in frame.where("n > 1").collect()] == []


def spans_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, start int, end int, entity_type string, score decimal(4,3), weak_card boolean, value string")


def random_spans(seed, docs, n, room):
    from decimal import Decimal

    rng = random.Random(seed)
    kinds = ["PHONE_NUMBER", "IN_PHONE", "CREDIT_CARD", "BANK_ACCOUNT", "PERSON", "LOCATION", "EMAIL_ADDRESS", "IN_PAN"]
    out = []
    for _ in range(n):
        start = rng.randrange(room)
        end = start + rng.randrange(2, 30)
        out.append((rng.randrange(docs), start, end, rng.choice(kinds), Decimal(rng.randrange(300, 1000)) / 1000, rng.random() < 0.2, "v" * (end - start)))
    return out


@pytest.mark.parametrize("stretch", [7, 100, 1 << 16])
def test_rows_resolve_as_arrays_do(spark, stretch):
    frame = spans_frame(spark, random_spans(stretch, 5, 600, 3000) + [(9, None, 5, "PERSON", None, False, "x"), (9, 4, None, "PERSON", None, False, "x")])
    whole = frame.where("start is not null and end is not null").groupBy("doc_id").agg(F.collect_list(F.struct(*I.SPAN)).alias("spans"))
    want = rows(whole.select("doc_id", F.inline(RS.resolve(F.col("spans")))))
    assert rows(I.resolve_rows(frame, stretch=stretch)) == want
    assert I.resolve_rows(frame.limit(0)).count() == 0


def test_islands_of_one_document_with_most_spans(spark):
    """A chain over many stretches is one island; the work of one document is in many partitions."""
    chain = spark.range(5000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 15).cast("int").alias("end"))
    apart = spark.range(5000).select(F.lit(2).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 10).cast("int").alias("end"))
    found = I.with_islands(chain.unionByName(apart), stretch=1000).groupBy("doc_id").agg(F.count_distinct("island").alias("n"), F.min("island").alias("low"))
    assert {(r.doc_id, r.n, r.low) for r in found.collect()} == {(1, 1, 0), (2, 5000, 0)}
