"""Stored scans: partitions, commit records, lookups, sketches, settings and ordered exports."""

import re
import threading
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilscan.config import DEFAULT
from veilscan.plans import reports as RP, scan as SN
from veilscan.sources import store

FINDING = "doc_id string, entity_type string, confidence decimal(4,3), masked_value string, start int, end int, scan_id bigint"


def findings(spark, scan_ids, docs=40, mark="x"):
    rows = spark.range(docs * 3).select(
        F.concat(F.lit("DOC-"), F.lpad((F.col("id") % docs).cast("string"), 6, "0")).alias("doc_id"), F.lit("IN_PAN").alias("entity_type"),
        F.lit(0.7).cast("decimal(4,3)").alias("confidence"), F.lit(mark).alias("masked_value"), F.col("id").cast("int").alias("start"),
        (F.col("id") + 5).cast("int").alias("end"))
    return rows.withColumn("scan_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in scan_ids])))


def commit(spark, base, scan_id, settings="{}", stats="{}"):
    row = spark.range(1).select(F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"), F.lit("t").alias("source"),
                                F.lit(1).cast("bigint").alias("docs_scanned"), F.lit(0).cast("bigint").alias("docs_skipped"),
                                F.lit(settings).alias("settings_json"), F.lit(stats).alias("stats_json"))
    store.write(row, base, "scans", scan_id)


def test_scans_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    base = str(tmp_path)
    store.write_scans(findings(spark, [1, 2, 3]), base, "findings")
    for i in (1, 2, 3):
        commit(spark, base, i)
    store.write_scans(findings(spark, [2], docs=5, mark="again"), base, "findings")
    loaded = {i: store.load_scan(spark, base, i)["findings"] for i in (1, 2, 3)}
    assert {i: df.count() for i, df in loaded.items()} == {1: 120, 2: 15, 3: 120}
    assert {r.masked_value for r in loaded[2].collect()} == {"again"}
    plan = loaded[2]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*scan_id#\d+L? = 2", plan)
    store.write(findings(spark, [3]).limit(0), base, "findings", 3)
    assert store.load_scan(spark, base, 3)["findings"].count() == 0
    assert store.read(spark, base, "findings").count() == 135


def test_unfinished_scans_are_hidden_and_swept(spark, tmp_path):
    base = str(tmp_path)
    now = time.time_ns()
    old, running, done = now - int(3e14), now, now - int(2e14)
    store.write_scans(findings(spark, [old, running, done]), base, "findings")
    commit(spark, base, done)
    assert [r.scan_id for r in store.list_scans(spark, base).collect()] == [done]
    assert store.load_scan(spark, base, old)["findings"].count() == 0 and store.load_scan(spark, base, done)["findings"].count() == 120
    assert {r.scan_id for r in store.read(spark, base, "findings").collect()} == {done}
    assert {(r["table"], r["scan_id"]) for r in store.unfinished(spark, base).collect()} == {("findings", old), ("findings", running)}
    assert store.sweep(spark, base) == 1
    left = {r.scan_id for r in store.read(spark, base, "findings", committed=False).collect()}
    assert left == {running, done}
    assert store.sweep(spark, base) == 0 and store.unfinished(spark, str(tmp_path / "none")).count() == 0


def test_scans_at_once_keep_both_rows(spark, tmp_path):
    docs = spark.createDataFrame([("d", "p", "txt", "", "", None, "", "PAN: ABCPK1234F", 15, False, None)],
                                 "doc_id string, source_path string, file_type string, sender string, recipients string, date timestamp, "
                                 "subject string, text string, char_count int, truncated boolean, error string")
    found = []
    threads = [threading.Thread(target=lambda: found.append(SN.run_scan(spark, docs, str(tmp_path), redact=False, key=b"k"))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    listed = store.list_scans(spark, str(tmp_path))
    assert {r.scan_id for r in listed.collect()} == {r.scan_id for r in found} and len(found) == 2
    assert [r.n for r in listed.select(F.col("stats.entity_counts")["IN_PAN"].alias("n")).collect()] == [1, 1]
    assert listed.where("settings.min_score = 0.5 and not settings.redact").count() == 2
    sketches = store.read(spark, str(tmp_path), "sketches")
    assert {tuple(r) for r in RP.unique_of_sketches(sketches).collect()} == {("IN_PAN", 1)}  # one key: the same identifier


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP", 4096)
    base = str(tmp_path)
    for n, scan_id in ((2_000, 1), (20_000, 2)):
        store.write(findings(spark, [scan_id], docs=n), base, "findings", scan_id)
        commit(spark, base, scan_id)
        wanted = "DOC-001234"
        assert store.find(spark, base, "findings", scan_id, wanted).count() == 3
        groups = holding = 0
        for file in Path(base, "findings", f"scan_id={scan_id}").glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(0).statistics
                groups += 1
                holding += stats.min <= wanted <= stats.max
        assert holding <= 2 < groups
    plan = store.find(spark, base, "findings", 2, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,DOC-001234)" in plan


def test_sketches_merge_within_their_error(spark):
    ids = lambda a, b: spark.range(a, b).select(F.array(F.struct(F.lit("MAIL").alias("id_group"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))).alias("digests"))
    parts = [RP.unique_sketches(ids(a, a + 30_000)) for a in (0, 20_000, 40_000)]
    merged = RP.unique_of_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2])).first()
    assert merged.id_group == "MAIL" and abs(merged.unique_values / 70_000 - 1) < 0.02
    assert RP.unique_of_sketches(parts[0].limit(0)).count() == 0


def test_settings_and_figures_of_other_versions(spark):
    rows = [('{"min_score":0.4,"new_field":[1]}', '{"docs_scanned":3,"level_counts":{"High":2}}'), ("", None), ("not json", "{}")]
    frame = spark.createDataFrame(rows, "settings_json string, stats_json string")
    got = store.parsed_scans(frame).select("settings.min_score", "settings.limit", F.col("stats.level_counts")["High"], "stats.docs_toxic").collect()
    assert [tuple(r) for r in got] == [(0.4, None, 2, None), (None, None, None, None), (None, None, None, None)]


@pytest.fixture
def whole_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exports_keep_order_and_text(spark, tmp_path, whole_partitions):
    odd = ['plain', 'a "quoted" word', "two\nlines, and\r\nmore", None, "é,中", '"', "\\ back \\\" slash"]
    docs = spark.range(3000).select(F.format_string("%05d", F.col("id")).alias("doc_id"), F.get(F.array(*map(F.lit, odd)), (F.col("id") % 7).cast("int")).alias("t"),
                                    F.array(F.lit("A"), F.lit("B")).alias("types"), F.col("id").cast("decimal(9,1)").alias("score"))
    path = store.export_csv({"documents": docs.orderBy(F.desc("score"))}, str(tmp_path))["documents"]
    files = sorted(Path(path).glob("part-*.csv"))
    back = store.read_export(spark, path, "doc_id string, t string, types array<string>, score decimal(9,1)")
    assert sorted(tuple(r) for r in back.select("doc_id", F.coalesce("t", F.lit("-")), "types", "score").collect()) == sorted(
        (f"{k:05d}", odd[k % 7] or "-", "A;B", k) for k in range(3000))
    firsts = [[float(r.score) for r in store.read_export(spark, str(f), "score decimal(9,1)").collect()] for f in files]
    kept = [(max(x), min(x)) for x in firsts if x]
    assert len(kept) > 1 and all(a[1] > b[0] for a, b in zip(kept, kept[1:], strict=False))


@pytest.mark.parametrize("settings", [DEFAULT])
def test_subjects_beside_the_text(spark, settings):
    rows = [("1", "Re a.b@mail.org now", "no address here"), ("2", "write to x", "write to xy@mail.org today"), ("3", "", "x@mail.org"), ("4", None, "q"),
            ("5", "bank account", "12345678901 is the number"), ("6", "PAN ABCPK1234F", "PAN ABCPK1234F and more")]
    docs = spark.createDataFrame([(i, f"p{i}", "eml", "", "", None, s, t, len(t), False) for i, s, t in rows],
                                 "doc_id string, source_path string, file_type string, sender string, recipients string, date timestamp, "
                                 "subject string, text string, char_count int, truncated boolean")
    got = {r.doc_id: r for r in SN.scan_documents(docs, settings, b"k").collect()}
    assert got["1"].subject == "Re a**@mail.org now" or re.fullmatch(r"Re a\*+@mail.org now", got["1"].subject)
    assert got["1"].finding_count == 0 and got["1"].digests == []
    assert re.fullmatch(r"write to x\*+@mail.org", got["2"].subject) and got["2"].finding_count == 1
    assert [got[k].subject for k in "345"] == ["", "", "bank account"]
    assert got["5"].finding_count == 0  # the label is not in the text
    assert "ABCPK1234F" not in got["6"].subject and got["6"].findings[0].start == 4
    plain = {r.doc_id: r for r in SN.scan_documents(docs.withColumn("subject", F.lit("")), settings, b"k").collect()}
    assert all(plain[k].findings == got[k].findings and plain[k].masked_snippet == got[k].masked_snippet for k in got)
