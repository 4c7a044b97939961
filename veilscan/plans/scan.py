"""A whole scan: detect, score, store, redact, aggregate, export."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilscan.config import DEFAULT, Settings
from veilscan.functions import masking
from veilscan.operators import detect as D, score as SC, spans as SP
from veilscan.plans import compliance as CP, evaluate as EV, remediation as RM, reports as RP
from veilscan.session import settle
from veilscan.sources import files, store


@dataclass(frozen=True)
class ScanResult:
    scan_id: int
    documents: DataFrame
    findings: DataFrame
    skipped: DataFrame
    redactions: DataFrame
    stats: DataFrame
    exports: dict[str, str]


#: Between a subject and a text that does not begin with it: no match reaches over it, and no context test finds a word in it.
_APART = "\n" + "~ " * 64 + "\n"


def scan_documents(docs: DataFrame, settings: Settings = DEFAULT, key: bytes | None = None) -> DataFrame:
    """Scored documents with masked findings, masked subject and snippet, and identifier digests.

    ``docs`` has the columns of ``files.DOCUMENT_COLUMNS``. One narrow pass: the text is read
    once, every derived column is computed beside it, and the text is dropped. A subject is mostly the beginning of the text; one that is
    not is looked at in the same pass, in front of the text. Its findings mask the subject and count nowhere else.
    """
    subject = F.coalesce("subject", F.lit(""))
    own = (subject != "") & ~F.startswith(F.col("text"), subject)
    shift = F.when(own, F.length(subject) + len(_APART)).otherwise(0)
    looked = docs.select(
        *[c for c in docs.columns if c not in ("text", "subject")], subject.alias("subject"), shift.alias("_shift"),
        F.left("text", F.lit(settings.snippet_chars)).alias("_head"), F.length("text").alias("_chars"),
        F.when(own, F.concat(subject, F.lit(_APART), F.col("text"))).otherwise(F.col("text")).alias("_looked"))
    raw = SP.stage(D.with_raw_findings(looked, settings, "_looked").drop("_looked"), "_all", D.masked(F.col("found")))

    def moved(xs: Column) -> Column:
        behind = F.filter(xs, lambda f: f["start"] >= F.col("_shift"))
        return F.transform(behind, lambda f: f.withField("start", f["start"] - F.col("_shift")).withField("end", f["end"] - F.col("_shift")))

    of_text = SP.stage(raw.withColumn("found", moved(F.col("found"))), "findings", moved(F.col("_all")))
    keyed = D.with_digests(of_text, settings, key)
    snippet = masking.masked_snippet(F.col("_head"), F.col("_chars"), F.col("findings"), settings.snippet_chars)
    error = ["error"] if "error" in docs.columns else []
    masked = keyed.select(
        *error, "doc_id", F.col("source_path").alias("path"), "file_type", "sender", "date",
        masking.masked_text(F.col("subject"), F.col("_all")).alias("subject"),
        "char_count", "truncated", snippet.alias("masked_snippet"), "findings", "digests")
    return SC.score_documents(masked, settings)


def scan_stats(documents: DataFrame, types: DataFrame, unique: DataFrame, settings: Settings = DEFAULT,
               redacted: int = 0) -> DataFrame:
    """The aggregate figures of a scan in one row."""
    counts = RP.entity_counts(types).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("findings")).alias("k"), "entity_type", "findings"))),
                    lambda c: F.struct(c["entity_type"].alias("key"), c["findings"].alias("value"))).alias("pairs"))
    per_group = unique.agg(F.collect_list(F.struct("id_group", "unique_values")).alias("unique_pairs"))
    extra = documents.agg(F.count_if("truncated").alias("truncated_docs"),
                          F.coalesce(F.sum("finding_count"), F.lit(0)).alias("total_findings"))
    row = CP.beside(CP.kpi_row(documents, unique, settings), counts, per_group, extra)
    return row.select(
        F.create_map(F.lit("High"), "docs_high", F.lit("Medium"), "docs_medium",
                     F.lit("Low"), "docs_low", F.lit("Clean"), "docs_clean").alias("level_counts"),
        F.map_from_entries("pairs").alias("entity_counts"),
        F.map_from_entries("unique_pairs").alias("unique_identifiers_by_type"),
        "docs_scanned", "unique_identifiers_total", "unique_individuals_estimate", "docs_with_pii", "docs_toxic",
        "total_findings", "truncated_docs", "exposure_index", "exposure_band", "scale_component",
        "severity_component", CP.dpdp_ceiling(settings).alias("dpdp_max_penalty_inr"),
        CP.gdpr_ceiling(F.lit(settings.turnover_eur), settings).alias("gdpr_max_fine_eur_default"),
        F.lit(redacted).alias("redacted_files"))


def settings_record(source: str, path: str, limit: int | None, redact: bool,
                    settings: Settings = DEFAULT) -> Column:
    """The settings kept with a scan."""
    return F.to_json(F.struct(
        F.lit(source).alias("source"), F.lit(path).alias("path"), F.lit(limit).cast("int").alias("limit"),
        F.lit(settings.min_score).alias("min_score"), F.lit(redact).alias("redact"),
        F.lit(settings.max_text_length).alias("max_text_length")))


def run_scan(spark: SparkSession, parsed: DataFrame, base: str, source: str = "frame",
             root: str = "", settings: Settings = DEFAULT, limit: int | None = None, redact: bool = True,
             truth: DataFrame | None = None,
             fetch: Callable[[list[str]], DataFrame] | None = None, key: bytes | None = None) -> ScanResult:
    """Scan documents and store everything under ``base``.

    Distinct identifiers are also kept as sketches; scans with the same ``key`` can be counted together by them.

    ``parsed`` has the columns of ``files.DOCUMENT_COLUMNS`` and ``error``; rows with an error are skipped. It is read once.
    ``fetch`` gives (doc_id, text) for a handful of source paths, so that redaction does not
    read the corpus again; without it the document frame is filtered.
    """
    # microseconds, and a random part, so that scans started together do not share an id
    scan_id = time.time_ns() // 1000 * 1000 + random.randrange(1000)
    started = F.timestamp_micros(F.lit(scan_id // 1000))

    # One pass over the text; everything below reads what it wrote. The settled table holds
    # masked values and keyed digests whose key is gone, never raw values.
    rows = settle(scan_documents(parsed, settings, key))
    scanned = rows.where(F.col("error").isNull()).drop("error")
    skipped = rows.where(F.col("error").isNotNull()).select("path", "error")
    store.write(scanned, base, "documents", scan_id)
    store.write(D.explode_findings(scanned), base, "findings", scan_id)
    store.write(skipped, base, "skipped", scan_id)
    store.write(RP.unique_sketches(scanned), base, "sketches", scan_id)
    # a count per identifier group, at most ten rows
    counts = [tuple(r) for r in RP.unique_identifiers(scanned).collect()]
    unique = spark.createDataFrame(counts, "id_group string, unique_values bigint")

    documents, found = (store.read(spark, base, t, scan_id, committed=False) for t in ("documents", "findings"))
    top = []
    if redact:
        top = [r.path for r in RP.ranked_documents(scanned, settings.top_redacted).select("path").collect()]
        texts = fetch(top) if fetch else parsed.where(F.col("source_path").isin(*top))
        store.write_redacted(RM.redact_top(scanned, texts, settings), base, scan_id)

    types = RP.type_rows(scanned)
    stats = scan_stats(scanned, types, unique, settings, len(top))
    accuracy = None
    if truth is not None:
        matched = EV.match_truth(documents, truth, root)
        accuracy = EV.entity_accuracy(matched, settings)
    n_skipped = store.read(spark, base, "skipped", scan_id, committed=False).agg(F.count("*").alias("docs_skipped"))
    row = CP.beside(stats, n_skipped).select(
        started.alias("started_at"), F.current_timestamp().alias("finished_at"),
        F.lit(f"{source}:{root}").alias("source"), "docs_scanned", "docs_skipped",
        settings_record(source, root, limit, redact, settings).alias("settings_json"),
        F.to_json(F.struct(*stats.columns)).alias("stats_json"))
    paths = store.export_csv(store.exports(scanned, unique, accuracy), f"{base}/exports/{scan_id}")
    store.write(row, base, "scans", scan_id)
    return ScanResult(scan_id, documents, found, store.read(spark, base, "skipped", scan_id),
                      store.read(spark, base, "redactions", scan_id), stats, paths)


def scan_folder(spark: SparkSession, folder: str, base: str, limit: int | None = None,
                settings: Settings = DEFAULT, redact: bool = True, truth_path: str | None = None) -> ScanResult:
    """Scan a folder of files."""
    parsed = files.parsed_folder(spark, folder, limit, settings)
    truth = EV.read_truth(spark, truth_path) if truth_path else None

    def fetch(paths: list[str]) -> DataFrame:
        return files.read_paths(spark, paths, settings)[0] if paths else parsed.limit(0)

    return run_scan(spark, parsed, base, "folder", folder.rstrip("/"), settings, limit, redact, truth, fetch)


def scan_mail_corpus(spark: SparkSession, path: str, base: str, limit: int | None = None,
                     settings: Settings = DEFAULT, redact: bool = True) -> ScanResult:
    """Scan a CSV of raw messages."""
    raw = files.raw_messages(spark, path, limit)

    def fetch(paths: list[str]) -> DataFrame:
        wanted = raw.where(files.message_path(F.col("file"), "enron").isin(*paths))
        return files.parsed_messages(wanted, settings, "enron")

    return run_scan(spark, files.parsed_messages(raw, settings, "enron"), base, "mail", path, settings, limit, redact, fetch=fetch)
