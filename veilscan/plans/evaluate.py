"""Accuracy of a scan against labelled files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.config import DEFAULT, Settings


def read_truth(spark, path: str) -> DataFrame:
    """Labels: file, expected_risk and the planted types as an array."""
    raw = spark.read.csv(path, header=True, schema="file string, category string, file_type string, "
                                                   "expected_risk string, planted_entities string")
    planted = F.filter(F.split(F.coalesce("planted_entities", F.lit("")), ";"), lambda t: t != "")
    return raw.select("file", "category", "expected_risk", planted.alias("planted"))


def match_truth(docs: DataFrame, truth: DataFrame, root: str) -> DataFrame:
    """Documents with their labels, matched by the path relative to ``root``.

    Labelled files that were not scanned and scanned files without a label drop out.
    """
    base = root.rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 1_000_000))
    return docs.withColumn("file", relative).join(truth.select("file", "expected_risk", "planted"), "file")


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def entity_accuracy(matched: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """File-level counts, precision, recall and F1 per evaluated type.

    ``matched`` has the arrays ``entity_types`` (detected) and ``planted``. All types are counted
    in one aggregation pass; nothing is exploded.
    """
    def counts(kind: str) -> Column:
        planted = F.array_contains("planted", kind)
        found = F.array_contains("entity_types", kind)
        return F.struct(F.lit(kind).alias("entity_type"),
                        F.count_if(planted & found).alias("tp"),
                        F.count_if(found & ~planted).alias("fp"),
                        F.count_if(planted & ~found).alias("fn"))

    rows = matched.agg(F.array(*[counts(k) for k in settings.evaluated]).alias("a")).select(F.inline("a"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r))
    return rows.select("entity_type", "tp", "fp", "fn", F.round(p, 3).alias("precision"),
                       F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def micro_average(per_entity: DataFrame) -> DataFrame:
    """Precision and recall over all types together, 0 without a denominator."""
    s = per_entity.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    zero = F.lit(0.0)
    return s.select(
        F.round(F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), zero), 3).alias("micro_precision"),
        F.round(F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), zero), 3).alias("micro_recall"))


def tier_confusion(matched: DataFrame) -> DataFrame:
    """Files per expected and predicted level."""
    return (matched.groupBy(F.col("expected_risk").alias("expected"), F.col("risk_level").alias("predicted"))
            .agg(F.count("*").alias("files")).orderBy("expected", "predicted"))


def tier_agreement(matched: DataFrame) -> DataFrame:
    """Share of files whose level is the expected one, NULL when none was evaluated."""
    same = F.count_if(F.col("expected_risk") == F.col("risk_level"))
    return matched.agg(F.round(_ratio(same, F.count("*")), 3).alias("risk_tier_accuracy"),
                       F.count("*").alias("files_evaluated"))
