"""From raw documents to packed training sequences: toxic documents go, then exact and near copies; sources are mixed to
their target weights; what is left is packed.

``run`` writes every stage as Parquet to the shared folder and reads it again, so that a lost executor never leads back
beyond the stage.  Null values, empty texts and tables, and extra columns are handled as the operators' modules say.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from leadlens.llm import exact_dedup, mixing, packing, simhash, toxicity
from leadlens.llm.kit import run_folder
from leadlens.llm.queries import WORD_VOCABULARY, vocabulary


def acceptable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.acceptable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def not_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(WORD_VOCABULARY)).drop("text_hash")


STAGES = [
    ("toxicity", acceptable),
    ("exact_dedup", different),
    ("simhash_near_dedup", not_near),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

# Toxicity, SimHash and packing are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
