"""The training-data pipeline over ``documents``: operators of ``runledger.llm`` in order.

Every stage reads all that its predecessor kept. Toxicity drops what scores 0.7 or more, the
near-duplicate join keeps the smallest id of each class, mixing samples by calibrated
probabilities, and packing returns the pieces of the kept documents with their places.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import jaccard_join, mixing, packing, toxicity
from runledger.llm.queries import table, tokenizer_file
from runledger.llm.store import Scratch


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_class(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file(packing.TOKENIZER))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("ngram_jaccard_join", one_of_each_near_duplicate),
    ("source_mixing", source_mixture),
    ("packing", packed),
]

# Learned scores, topics and a tokenizer have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
