"""A training corpus from documents: each stage reads what its predecessor wrote.

Toxic documents go, then all but one of equal texts, then all but one of each group of near copies; the rest is mixed to the
sources' target weights (a document taken n times has n rows) and encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import cube_mix, dart_minhash, exact_dedup, queries, toxicity_mil
from pairloom.llm.common import free_name
from pairloom.session import materialize, ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below the threshold; the model learns from the labelled ones among them."""
    ship_package(spark)
    model = toxicity_mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "score")
    return toxicity_mil.score(docs, model).where(F.col(name) < toxicity_mil.TOXIC).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship_package(spark)
    return dart_minhash.drop_near_duplicates(docs).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship_package(spark)
    return cube_mix.mixed_documents(docs).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each row of the mix."""
    ship_package(spark)
    return queries.token_digests(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("bpe encoding", encoding)]

#: The model, the signatures, the draw and the tokenizer have no SQL form; tests hold the rows against plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
