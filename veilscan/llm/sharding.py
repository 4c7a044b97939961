"""Sharding by fixed virtual slots.

Records are hashed into SLOTS slots, a number that never changes. A slot map says which shard holds a slot. It is a table
with a version; to rebalance or to add a shard, slots are given to other shards in a new version, and only those move.

* A record's slot follows from its id (without an id: from its text), so equal ids share a slot.
* Null texts have no bytes. Repeated rows are records of their own. An empty table has a map with empty slots.
* Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm.common import filled, let, new_path, settle

SLOTS = 4096


def slot_of(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text_crc32)).otherwise(F.xxhash64(doc_id)), F.lit(slots))


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each record."""
    text = filled(F.col("text"))
    return (docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
            .withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots)))


def slot_totals(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of each slot: partial sums before the shuffle, as many rows as slots after it."""
    totals = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").alias("virtual_slot"))
    return every.join(totals, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def initial_map(totals: DataFrame, shards: int) -> DataFrame:
    """Slots dealt in turn."""
    return totals.withColumn("shard", F.pmod("virtual_slot", F.lit(shards)).cast("int"))


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """An edit of the map: a shard keeps its largest slots up to its even part of the bytes, the others go, largest first, to
    the shard with the least bytes. The fold runs over the slots, whose number is fixed, not over records. Shards
    from the map's own number up to ``shards`` are new and take slots from the others."""
    even = F.floor(F.sum("bytes").over(Window.partitionBy()) / F.lit(shards))
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    marked = slot_map.select("virtual_slot", "bytes", "rows", "shard", even.alias("even")).withColumn(
        "keep", (F.col("shard") < shards) & (F.sum("bytes").over(own) <= F.col("even")))
    kept = [F.coalesce(F.sum(F.when(F.col("keep") & (F.col("shard") == k), F.col("bytes"))), F.lit(0).cast("long")) for k in range(shards)]
    going = F.sort_array(F.collect_list(F.when(~F.col("keep"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))))
    one = marked.agg(F.array(*kept).alias("loads"), going.alias("going"))

    def give(state: Column, slot: Column) -> Column:
        def to(k: Column) -> Column:
            return F.struct(
                F.transform(state["loads"], lambda load, j: F.when(j == k, load - slot["less"]).otherwise(load)).alias("loads"),
                F.concat(state["given"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), k.cast("int").alias("to")))).alias("given"))

        return let((F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int"), to)

    start = F.struct(F.col("loads"), F.array().cast("array<struct<virtual_slot:bigint,to:int>>").alias("given"))
    given = one.select(F.explode(F.aggregate("going", start, give)["given"]).alias("g")).select("g.*")
    return (marked.join(F.broadcast(given), "virtual_slot", "left")
            .select("virtual_slot", "bytes", "rows", F.coalesce("to", "shard").alias("shard")))


def save(slot_map: DataFrame, path: str, version: int) -> None:
    slot_map.withColumn("version", F.lit(version)).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot (place in the shard, from 0, without gaps) of each record.

    Texts are read once and not shuffled. Places are counted within virtual slots, each a small part of all records, and a
    slot's first place follows from the map, so no task holds a whole shard. The map is broadcast: it has ``slots`` rows."""
    spark, path = docs.sparkSession, map_path or new_path(docs.sparkSession, "slot-map")
    records = settle(measured(docs, slots), "records")
    save(initial_map(slot_totals(records, slots), shards), path, 1)
    save(rebalanced(load(spark, path, 1), shards), path, 2)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    current = load(spark, path, 2).select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (records.withColumn("place", place.cast("long")).join(F.broadcast(current), "virtual_slot")
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("place") - 1).alias("slot")))
