"""Tables written on the way leave no shuffle files behind."""

from pyspark.sql import functions as F

from veilscan.llm import common


def _shuffled(spark) -> int:
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return held.mkString(" ").count("shuffle_")


def test_a_settled_table_leaves_no_shuffle_files(spark):
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    before = _shuffled(spark)
    rows = common.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert 0 < before == _shuffled(spark)
    assert sorted(r["count"] for r in rows.collect()) == [142] + [143] * 6
    assert spark.conf.get(common.CLEANUP) == "false"
