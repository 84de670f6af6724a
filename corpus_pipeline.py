"""A training corpus from ``documents`` in five stages, each written and read again.

Toxic documents go, one document of each near-duplicate group stays, bytes that repeat earlier
long passages are cut, documents that hold benchmark items go, and the rest gets its places in
the training order. The last stage returns that order (a row per document: words to take,
training position of every taken pass), to be joined to the texts of the stage before.

Every stage keeps rows with a null id or text unless its own decision says otherwise, and runs
on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.llm import decontaminate, mixing, simhash, suffix, toxicity
from abstracta.llm.common import stored
from abstracta.llm.queries import toxicity_model
from abstracta.session import table


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return suffix.deduplicated(docs).withColumn("n_chars", n_chars).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(mixing.mix(docs))


STAGES = [
    ("toxicity", nontoxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL cannot express the toxicity score; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
