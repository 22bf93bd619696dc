"""Pipeline over `documents`: quality rules, near-duplicates, personal data, mixing, packing.

Each stage's rows are written as Parquet to the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from termsieve.llm import mixing, packing, pii, quality, simhash, workers_import
from termsieve.runtime import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose fingerprints of 4-word shingles are linked within 4 bits."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text."""
    return pii.pseudonymize(docs, spans=False).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped by chance, to the target weights, in a random order."""
    return mixing.replicate(docs, mixing.TARGET_WEIGHTS).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("source_mix", source_mix), ("packed_sequences", packed_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Hashes of words, fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
