"""Overlap resolution over spans that are rows of a table, for documents whose spans do not fit one array.

Spans of a document are islands and gaps: an island begins where no earlier span reaches. The largest end before a span is a running
maximum in order of starts. It is taken in two steps, inside stretches of the document and over one row per stretch, so that a
document with most of all spans is many tasks' work. Then each island is folded as in ``resolve``.

A row without a start or an end is no span and is left out. Ties in start are ordered by end; rows that are equal stay apart until the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veilscan.operators import resolve as RS

#: Characters of a stretch.
STRETCH = 1 << 16
SPAN = ("start", "end", "entity_type", "score", "weak_card", "value")


def with_islands(spans: DataFrame, id_col: str = "doc_id", stretch: int = STRETCH) -> DataFrame:
    """The spans plus ``island``: where the run of overlapping spans that each is in begins. A document's islands differ in it."""
    placed = spans.where(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("_stretch", F.floor(F.col("start") / stretch))
    inside = Window.partitionBy(id_col, "_stretch").orderBy("start", "end")
    earlier = Window.partitionBy(id_col).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy(id_col, "_stretch").agg(F.max("end").alias("_top")).withColumn("_reach", F.max("_top").over(earlier)).drop("_top")
    reached = placed.join(tops, [id_col, "_stretch"])
    before = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    marked = reached.withColumn("_head", F.when(before.isNull() | (F.col("start") >= before), F.col("start"))).drop("_reach")
    heads = marked.groupBy(id_col, "_stretch").agg(F.max("_head").alias("_last")).withColumn("_open", F.max("_last").over(earlier)).drop("_last")
    own = F.max("_head").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(heads, [id_col, "_stretch"]).withColumn("island", F.coalesce(own, F.col("_open"))).drop("_stretch", "_head", "_open")


def resolve_rows(spans: DataFrame, id_col: str = "doc_id", stretch: int = STRETCH) -> DataFrame:
    """Findings without overlaps as rows, from candidate spans as rows: (id, start, end, entity_type, score, weak_card, value)."""
    islands = with_islands(spans.select(id_col, *SPAN), id_col, stretch).groupBy(id_col, "island").agg(F.collect_list(F.struct(*SPAN)).alias("spans"))
    return islands.select(id_col, F.inline(RS.resolve(F.col("spans"))))
