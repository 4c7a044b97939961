"""What round 3's findings asked for: bounded pieces of parsed files, checks worked out once, inputs spread before they are made."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from tests.test_detection import is_valid
from veilscan.functions import checks
from veilscan.operators import rules as R, spans as SP
from veilscan.sources import files


def test_parsing_takes_a_batch_in_pieces(monkeypatch):
    monkeypatch.setattr(files, "PARSED_AT_ONCE", 100)
    batch = pd.DataFrame({"path": range(7), "content": [b"x" * n for n in (60, 60, 40, 0, 500, 10, 10)]})
    pieces = list(files.in_pieces(batch, "content"))
    assert [list(p["path"]) for p in pieces] == [[0], [1, 2, 3], [4], [5, 6]]
    assert not list(files.in_pieces(batch.iloc[:0], "content"))


def test_all_files_of_all_pieces_are_parsed(spark):
    rows = spark.range(40).select(
        F.concat(F.lit("/in/"), F.col("id"), F.lit(".csv")).alias("path"),
        F.concat(F.lit("a,b\n"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(",y\n")), 50_000)).cast("binary").alias("content"),
        F.lit("2024-03-01 10:00:00").cast("timestamp").alias("modificationTime")).repartition(2)
    docs, skipped = files.split(files.parsed_files(rows))
    found = {r.source_path: r.md5 for r in docs.select("source_path", F.md5("text").alias("md5")).collect()}
    line = F.concat(F.lit("a: "), F.col("id").cast("string"), F.lit(" | b: y"))
    want = spark.range(40).select("id", F.md5(F.array_join(F.array_repeat(line, 50_000), "\n")).alias("md5")).collect()
    assert found == {f"/in/{r.id}.csv": r.md5 for r in want} and skipped.isEmpty()


@pytest.mark.parametrize(("name", "made"), [("csv_files", "content"), ("far_findings", "message")])
def test_inputs_are_spread_before_they_are_made(spark, tmp_path, name, made):
    spark.range(3).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    spread = [below.split("parquet")[0] for below in plan.split("Repartition")[1:]]
    assert spread and made in plan and not any(made in below for below in spread)


def test_a_rule_works_its_check_out_once(spark):
    rule = R.Rule("r", "IN_AADHAAR", "[0-9]{12}", 0.3, validate=lambda v: F.contains(v, F.lit("only-once")), adjust=R._aadhaar_label_wins)
    assert str(SP._confidence((rule,), F.lit(0), F.col("s"), 0.0)).count("only-once") == 1


def test_check_digits_of_any_length(spark):
    random.seed(5)
    numbers = ["".join(random.choices("0123456789", k=k)) for k in range(1, 16) for _ in range(40)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select(
        "n", checks.verhoeff_valid(F.col("n")).alias("valid"), checks.verhoeff_check_digit(F.col("n")).alias("digit")).collect()
    assert all(r.valid == is_valid(r.n) and is_valid(r.n + r.digit) for r in rows) and len(rows) == 600
