"""From documents to token ids: toxicity, quality, near duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Each works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import bpe, mixing, ngram_join, quality, toxicity
from veilscan.llm.common import settle, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic, by a model fitted to the stage's own documents and their labels."""
    return toxicity.accepted(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.kept(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return ngram_join.kept(docs)


def in_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; those that it does not take are gone."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each copy."""
    return bpe.encoded(docs, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("ngram_jaccard_join", without_near_copies),
    ("mix_sources", in_mix),
    ("bpe", encoded),
]

#: A fitted model and near duplicates cannot be said in SQL; tests/llm holds the pipeline against plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
