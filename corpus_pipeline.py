"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret redaction and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each result as Parquet in the cluster's shared folder and reads it
back for the next stage; what a stage stored on its way is deleted then. All stages but the last return the columns of ``documents``. Rows that a stage rejects are gone; secrets are replaced in
the text. Nulls, empty texts, repeated rows and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontamination, near_dedup, packing, quality_rules, secrets
from waymark.llm.common import scratch, shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: Learned models, MinHash classes and tokenisation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/waymark-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
