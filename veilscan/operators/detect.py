"""Detection: documents to findings, in one pass over the text and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilscan.config import DEFAULT, Settings
from veilscan.functions import masking
from veilscan.operators import resolve as RS, spans as SP
from veilscan.operators.rules import Rule


def with_raw_findings(docs: DataFrame, settings: Settings = DEFAULT, text_col: str = "text",
                      extra_spans: Column | None = None, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The documents plus ``found``: resolved findings that still carry the raw value.

    Do not write this frame. ``extra_spans`` is an array column of further candidates, for
    instance from ``operators.ner``.
    """
    spotted = SP.with_spans(docs, settings, text_col, rules)
    if extra_spans is not None:
        spotted = spotted.withColumn("spans", F.concat("spans", extra_spans))
    return spotted.select(*docs.columns, F.explode(F.array(resolved_spans("spans"))).alias("found"))


@SP.built_once
def resolved_spans(column: str) -> Column:
    """Findings from the candidate spans of a column."""
    return RS.resolve(F.col(column))


@SP.built_once
def _masked(column: str) -> Column:
    return masked(F.col(column))


def masked(found: Column) -> Column:
    """Findings as they may be stored: (start, end, entity_type, masked_value, confidence)."""
    return F.transform(found, lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["entity_type"].alias("entity_type"),
        masking.mask_value(f["value"], f["entity_type"]).alias("masked_value"),
        f["score"].alias("confidence")))


def with_findings(docs: DataFrame, settings: Settings = DEFAULT, text_col: str = "text",
                  extra_spans: Column | None = None) -> DataFrame:
    """The documents plus ``findings``, an array of masked findings in text order."""
    raw = with_raw_findings(docs, settings, text_col, extra_spans)
    return raw.select(*docs.columns, F.explode(F.array(_masked("found"))).alias("findings"))


def explode_findings(docs: DataFrame, id_col: str = "doc_id", column: str = "findings") -> DataFrame:
    """One row per finding."""
    return docs.select(id_col, F.inline(column))


def findings(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Masked findings as rows: (id, start, end, entity_type, masked_value, confidence)."""
    return explode_findings(with_findings(docs.select(id_col, text_col), settings, text_col), id_col)


def raw_findings(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Unmasked findings as rows, for identifier counting inside one job. Do not write it."""
    found = with_raw_findings(docs.select(id_col, text_col), settings, text_col)
    return explode_findings(found, id_col, "found")


def collect_findings(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows back to one array per document, for findings that come from a table."""
    one = F.struct("start", "end", "entity_type", "masked_value", "confidence")
    return found.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("findings"))


def with_digests(docs: DataFrame, settings: Settings = DEFAULT, key: bytes | None = None) -> DataFrame:
    """Documents with ``found`` plus ``digests``: (id_group, digest) of what identifies somebody.

    The key is drawn per call and kept nowhere, so digests only compare within one scan. It
    travels as a one-row table, because a literal would be printed in query plans.
    """
    pads = masking.key_table(docs.sparkSession, key)
    keyed = docs.withColumn("_one", F.lit(1)).join(F.broadcast(pads), "_one").drop("_one")

    def digest(f: Column) -> Column:
        group = masking.identifier_group(f["entity_type"])
        normal = masking.normalise_identifier(f["value"], f["entity_type"])
        return F.struct(group.alias("id_group"), masking.keyed_digest(
            group, normal, F.col("inner_pad"), F.col("outer_pad")).alias("digest"))

    named = F.filter("found", lambda f: f["entity_type"].isin(*settings.identifier_types))
    return SP.stage(keyed, "digests", F.transform(named, digest)).drop("inner_pad", "outer_pad")
