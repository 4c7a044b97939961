"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's part of the mix, at most ``most`` times the source's own words; what is above is shared out
again among the others. Whole copies that fit in the target are certain. What is left of it is drawn: document i gets an
inclusion probability p that grows with the square root of its words, and the order key
``[u / (1 - u)] / [p / (1 - p)]`` with a u from a hash of its id. Where p would be 1 or more the document is certain, and the others share
what words are left, until no p reaches 1. Documents with the smallest keys, certain ones first, are
in the sample. Targets are in words, so the sample's fixed size is one too: the first documents whose words come nearest to the rest.

* Null or empty texts have no words; they are never taken. A null source is a source of its own, the last.
* Rows equal in id, source and words share a key and are taken alike; other ties of keys go by id (null first), then words.
* An empty table gives an empty plan. Other columns are not read. The u are hashes, so a second run gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import WORD, filled, settle

WEIGHTS = (5, 2, 1)
#: Ranges of keys for counting words on the way to the cut; a source's sums are of as many rows.
RANGES = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """source, source_size, root_size (sum of size times root, for p), target, whole (copies) and rest (words to draw). One row per
    source; the windows without a key are over these rows, not over documents."""
    scale = 1
    for w in weights:
        scale *= w
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * root(F.col("size"))).alias("root_size"))
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    limit = F.col("source_size") * most
    ranked = (by_source.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place)).withColumn("limit", limit)
              .withColumn("full_at", F.col("limit") * (F.lit(scale) / F.col("weight")).cast("long"))
              .withColumn("mix", F.sum("source_size").over(Window.partitionBy()) * percent / 100.0))
    up = Window.orderBy("full_at", F.asc_nulls_last("source"))
    left = F.col("mix") - F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    full = ranked.withColumn("level", level).withColumn("order", F.row_number().over(up)).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    final = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("order"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(final * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (full.select("source", "source_size", "root_size", target.alias("target")).withColumn("whole", whole)
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))


def root(size: Column) -> Column:
    """The square root in sixteenths, a whole number, so that sums do not depend on their order."""
    return F.floor(F.sqrt(size.cast("double")) * 16)


def order_key(doc_id: Column, size: Column, inclusion: Column) -> Column:
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), size.cast("string"))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return (F.when(inclusion >= 1, 0.0).when(inclusion <= 0, F.lit(float("inf")))
            .otherwise((u / (1 - u)) / (inclusion / (1 - inclusion))))


def _of_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with what the plan says of their source. The plan has a row per source; Spark broadcasts it while it is small."""
    plan = plan.withColumnRenamed("source", "plan_source")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def with_certain(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with ``sure`` (documents with a root of at least that are certain), and words to draw and root sum of the others (``free``, ``roots``).

    Each pass over the sizes takes in the documents whose p reaches 1 now; when none is new, it is done."""
    now = plan.withColumns({"sure": F.lit(float("inf")), "free": F.col("rest"), "roots": F.col("root_size"), "n_sure": F.lit(0).cast("long")})
    while True:
        at_one = F.col("roots") / F.when(F.col("free") > 0, F.col("free"))
        trial = settle(now.withColumn("limit", F.least("sure", at_one)), "trial")
        words = _of_source(rows.select("source", "size"), trial.select("source", "limit")).where((F.col("size") > 0) & (root(F.col("size")) >= F.col("limit")))
        sums = words.groupBy("source").agg(F.sum("size").alias("words"), F.sum(F.col("size") * root(F.col("size"))).alias("their_roots"), F.count("*").alias("n"))
        found = sums.withColumnRenamed("source", "sum_source")
        with_sums = trial.join(found, F.col("source").eqNullSafe(F.col("sum_source")), "left").where(F.col("n") > F.col("n_sure"))
        new = settle(with_sums.select("source", F.col("limit").alias("new_sure"), (F.col("rest") - F.col("words")).alias("new_free"),
                                      (F.col("root_size") - F.col("their_roots")).alias("new_roots"), "n"), "certain")
        if new.isEmpty():
            return now
        both = now.join(new.withColumnRenamed("source", "new_source"), F.col("source").eqNullSafe(F.col("new_source")), "left")
        now = settle(both.select(*plan.columns, F.coalesce("new_sure", "sure").alias("sure"), F.coalesce("new_free", "free").alias("free"),
                                 F.coalesce("new_roots", "roots").alias("roots"), F.coalesce("n", "n_sure").alias("n_sure")), "plan")


def keyed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with what the plan says of their source, and their key."""
    own = root(F.col("size"))
    share = F.when((F.col("size") > 0) & (own >= F.col("sure")), 1.0).when((F.col("roots") > 0) & (F.col("free") > 0), F.col("free") * own / F.col("roots")).otherwise(0.0)
    return (_of_source(rows, plan).withColumn("key", order_key(F.col("doc_id"), F.col("size"), share))
            .withColumn("at", F.struct("key", F.coalesce("doc_id", F.lit(-1)).alias("id"), "size")))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with ``cut``, the last place of a source's sample (null: nothing is drawn).

    A source's rows are never in one window: words are summed by ranges of keys first, with partial sums, and only the range
    in which the cut lies is put in order."""
    in_range = F.when(F.isnan("key") | (F.col("key") == float("inf")), RANGES).otherwise(
        F.least(F.floor(F.col("key") / (F.col("key") + 1) * RANGES), F.lit(RANGES))).cast("int")
    ranged = keyed(rows, plan).where(F.col("size") > 0).withColumn("range", in_range)
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"), F.max("at").alias("last"))
            .withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0))))
    inside = F.col("before") + F.col("words") <= F.col("rest")
    crossing = (sums.where(~inside & (F.col("before") < F.col("rest"))).groupBy("source")
                .agg(F.min_by(F.struct("range", "before"), "range").alias("c")).select(F.col("source").alias("cut_source"), "c.*"))
    ordered = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (ranged.join(crossing.withColumnRenamed("range", "cut_range"), F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("range") == F.col("cut_range")))
             .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
             .where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).select("source", "at"))
    last = (sums.where(inside).select("source", F.col("last").alias("at")).unionByName(drawn)
            .groupBy("source").agg(F.max("at").alias("cut")).withColumnRenamed("source", "cut_source"))
    return plan.join(last, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")


def copies() -> Column:
    """Of a keyed row: the copies of it in the mix."""
    drawn = F.col("cut").isNotNull() & (F.col("at") <= F.col("cut"))
    return F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + drawn.cast("long"))


def plan_of(rows: DataFrame) -> DataFrame:
    """Targets and cuts of sized rows, one row per source, as a table."""
    return settle(cuts(rows, with_certain(rows, settle(targets(rows), "targets"))), "plan")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target of the source, taken: words of the document in the mix, repeats counted."""
    rows = settle(sized(docs), "sizes")
    return keyed(rows, plan_of(rows)).select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of the input as often as its copies, with the input's columns."""
    plan = plan_of(settle(sized(docs), "sizes"))
    row = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    times = F.explode(F.sequence(F.lit(1), copies().cast("int"))).alias("time")
    return keyed(row, plan).where(copies() > 0).select("row", times).select("row.*")
