"""Operators that read texts in Python get them in batches of bounded size, unless the session names a limit."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilscan.llm import bpe, common, ngram_join, toxicity


def _largest(frame) -> int:
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    return frame.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]


@pytest.mark.parametrize("operator", [
    bpe.encoded, ngram_join.joined, lambda docs: toxicity.scored(docs, toxicity.Model({})), lambda docs: toxicity.accepted(docs, toxicity.Model({}))])
def test_texts_go_to_python_in_small_batches(spark, operator):
    own = spark.newSession()
    words = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat_ws(" ", F.lit("word"), F.col("id"), k))
    docs = own.range(0, 6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.array_join(words, " "), F.repeat(F.lit(" more"), 400)).alias("text"))
    assert _largest(docs) > 4 * common.BATCH_BYTES
    found = operator(docs)
    assert _largest(docs) < 1.1 * common.BATCH_BYTES
    assert found.count() == 6000


def test_a_limit_of_the_session_stays(spark):
    own = spark.newSession()
    own.conf.set(common.BATCH, "1m")
    common.in_small_batches(own.range(1))
    assert own.conf.get(common.BATCH) == "1m"
