"""From raw documents to packed sequences: STAGES over ``documents``, each stage's result written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import decontaminate, linededup, packing, quality, simhash
from palimpsest.llm.common import materialize, release, scratch, shipped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality(docs, trusted).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the copies of lines that many sites share; n_chars follows the text."""
    out = linededup.line_dedup(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(new.get(c, F.col(f"row.`{c}`"))).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, packing.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", shipped(near_dedup)),
    ("benchmark_decontamination", shipped(decontamination)),
    ("best_fit_packing", shipped(best_fit_packing)),
]

#: Hashed n-grams, shingle fingerprints and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
        if last is not None:
            release(last)
        last = docs
    return docs
