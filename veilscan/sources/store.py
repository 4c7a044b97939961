"""Scan results as Parquet tables: documents, findings, skipped, redactions, sketches and scans.

Every table is partitioned by ``scan_id`` and a scan only ever writes its own partition, so a
job that is run again replaces what it wrote before. The ``scans`` row is written last and is the commit record: rows of a scan
without it are neither listed nor loaded, and ``sweep`` empties their partitions.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilscan.plans import reports as RP
from veilscan.sources import csv_ranges

SCHEMAS = {
    "documents": "doc_id string, path string, file_type string, sender string, date timestamp, subject string, "
                 "risk_score decimal(5,1), risk_level string, reason string, finding_count int, char_count int, "
                 "truncated boolean, toxic boolean, entity_types array<string>, masked_snippet string, scan_id bigint",
    "findings": "doc_id string, entity_type string, confidence decimal(4,3), masked_value string, "
                "start int, end int, scan_id bigint",
    "skipped": "path string, error string, scan_id bigint",
    "redactions": "doc_id string, source string, redacted_path string, scan_id bigint",
    "sketches": "id_group string, sketch binary, scan_id bigint",
    "scans": "started_at timestamp, finished_at timestamp, source string, docs_scanned bigint, docs_skipped bigint, "
             "settings_json string, stats_json string, scan_id bigint",
}

#: Tables in which single documents are looked up, with the columns their rows are ordered by.
CLUSTERED = {"findings": ("doc_id", "start")}
#: Bytes of a row group of these: what a lookup reads at least.
ROW_GROUP = 8 << 20

SETTINGS = "source string, path string, limit int, min_score double, redact boolean, max_text_length int"
STATS = ("level_counts map<string,bigint>, entity_counts map<string,bigint>, unique_identifiers_by_type map<string,bigint>, "
         "docs_scanned bigint, unique_identifiers_total bigint, unique_individuals_estimate bigint, docs_with_pii bigint, docs_toxic bigint, "
         "total_findings bigint, truncated_docs bigint, exposure_index double, exposure_band string, scale_component double, "
         "severity_component double, dpdp_max_penalty_inr double, gdpr_max_fine_eur_default double, redacted_files bigint")


def _clustered(df: DataFrame, table: str) -> DataFrame:
    """Rows by range of the lookup columns, so that a document's are in one row group or a few neighbouring ones."""
    keys = CLUSTERED.get(table)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df


def _writer(df: DataFrame, table: str):
    writer = df.write.mode("overwrite")
    for key in CLUSTERED.get(table, ())[:1]:
        writer = writer.option("parquet.block.size", ROW_GROUP).option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer


def write(df: DataFrame, base: str, table: str, scan_id: int) -> None:
    """Write one scan's rows of a table; without rows its partition becomes empty."""
    _writer(_clustered(df.select(*_columns(table)[:-1]), table), table).parquet(f"{base}/{table}/scan_id={scan_id}")


def write_scans(df: DataFrame, base: str, table: str) -> None:
    """Write rows of many scans, told apart by ``scan_id``, in one job. Partitions of scans that have no row here stay as they are."""
    rows = df.select(*_columns(table))
    keys = CLUSTERED.get(table)
    if keys:
        rows = rows.repartitionByRange("scan_id", *keys).sortWithinPartitions("scan_id", *keys)
    _writer(rows, table).option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(f"{base}/{table}")


def write_redacted(copies: DataFrame, base: str, scan_id: int) -> None:
    """Write a scan's redacted copies below its id and record them.

    The copies are at most a handful of rows (``Settings.top_redacted``).
    """
    path = f"{base}/redacted/scan_id={scan_id}"
    copies.write.mode("overwrite").parquet(path)
    kept = copies.sparkSession.read.schema(copies.schema).parquet(path)
    write(kept.select("doc_id", "source", F.col("redacted_name").alias("redacted_path")), base, "redactions", scan_id)


def _columns(table: str) -> list[str]:
    """Names of a table's columns, ``scan_id`` last."""
    plain = SCHEMAS[table].replace("(5,1)", "").replace("(4,3)", "")
    return [c.split()[0] for c in plain.split(",")]


def _read(spark: SparkSession, base: str, table: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMAS[table]).parquet(f"{base}/{table}")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc.getCondition()):
            raise
        return spark.createDataFrame([], SCHEMAS[table])


def finished(spark: SparkSession, base: str) -> DataFrame:
    """scan_id of the scans that have their commit record."""
    return _read(spark, base, "scans").where(F.col("finished_at").isNotNull()).select("scan_id").distinct()


def read(spark: SparkSession, base: str, table: str, scan_id: int | None = None, committed: bool = True) -> DataFrame:
    """A table, or the partition of one scan; an empty frame when nothing was stored yet.

    Rows of scans without a commit record are left out, unless ``committed`` is false, as a scan needs it for what it has written itself."""
    df = _read(spark, base, table)
    if scan_id is not None:
        df = df.where(F.col("scan_id") == scan_id)
    return df.join(finished(spark, base), "scan_id", "left_semi").select(*_columns(table)) if committed else df


def find(spark: SparkSession, base: str, table: str, scan_id: int, doc_id: str) -> DataFrame:
    """The rows of one document in a clustered table. Statistics and bloom filters leave few row groups to read, however large the table."""
    return read(spark, base, table, scan_id).where(F.col(CLUSTERED[table][0]) == doc_id)


def list_scans(spark: SparkSession, base: str) -> DataFrame:
    """Finished scans, newest first, with their settings and figures as JSON and as columns."""
    rows = _read(spark, base, "scans").where(F.col("finished_at").isNotNull())
    return parsed_scans(rows).orderBy(F.desc("scan_id"))


def parsed_scans(scans: DataFrame) -> DataFrame:
    """Scans plus ``settings`` and ``stats`` as structs. Fields that the JSON lacks are null, others are passed over, bad JSON gives nulls."""
    return scans.withColumns({"settings": F.from_json("settings_json", SETTINGS), "stats": F.from_json("stats_json", STATS)})


def load_scan(spark: SparkSession, base: str, scan_id: int) -> dict[str, DataFrame]:
    """All tables of one finished scan; the filter on ``scan_id`` prunes to its partition."""
    return {table: read(spark, base, table, scan_id) for table in SCHEMAS}


def unfinished(spark: SparkSession, base: str) -> DataFrame:
    """table, scan_id of what scans without a commit record have left: running ones, and those that failed."""
    parts = [_read(spark, base, t).select(F.lit(t).alias("table"), "scan_id").distinct() for t in SCHEMAS if t != "scans"]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(finished(spark, base), "scan_id", "left_anti").select("table", "scan_id")


def sweep(spark: SparkSession, base: str, older_than_s: float = 86_400) -> int:
    """Empty the partitions of scans that were begun so long ago and have no commit record. Gives how many partitions there were.

    Ids of scans are nanoseconds since 1970. What is listed is as many rows as failed scans have tables."""
    before = time.time_ns() - int(older_than_s * 1e9)
    left = unfinished(spark, base).where(F.col("scan_id") < before).collect()
    for row in left:
        nothing = spark.createDataFrame([], SCHEMAS[row["table"]])
        write(nothing, base, row["table"], row["scan_id"])
    return len(left)


def export_csv(frames: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Write frames as CSV with a header, one folder each. Arrays become ``;``-joined text.

    The files of an ordered frame follow each other in order of their names. Quotes are doubled, line ends stay inside quotes."""
    paths = {}
    for name, df in frames.items():
        flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
        paths[name] = f"{base}/{name}"
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(paths[name])
    return paths


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export read back, by many tasks, with the types of a schema. Text that was empty is null; arrays stay joined text."""
    raw = csv_ranges.read(spark, path)
    wanted = spark.createDataFrame([], schema).dtypes
    return raw.select(*[F.col(f"`{name}`").cast("string" if kind.startswith("array") else kind).alias(name) for name, kind in wanted])


def exports(scanned: DataFrame, unique: DataFrame, accuracy: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames a scan exports, from scored documents that carry their findings."""
    frames = {
        "documents": RP.documents_export(scanned),
        "findings_summary": RP.findings_summary(scanned),
        "entity_counts": RP.entity_counts(RP.type_rows(scanned), unique),
    }
    if accuracy is not None:
        frames["accuracy"] = accuracy
    return frames
