"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result
as Parquet to the shared folder and reads it back as the next stage's documents.  Every stage but the last
returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, jaccard, packing, pii, quality
from weft.llm.arrow import new_folder, small_batches
from weft.session import ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier calls 1; it learns from the labelled ones among them."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of every component of the n-gram Jaccard join."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The removal spans are cut from contaminated documents; one with no words left goes."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced by labels."""
    return pii.sanitise(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece, with its ids."""
    return packing.pack(docs, with_ids=True)


def _sized(stage):
    """The stage, with batches to Python workers of a size that suits whole texts."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _sized(quality_filter)),
    ("n-gram Jaccard join", _sized(near_duplicates)),
    ("benchmark decontamination", _sized(decontamination)),
    ("PII", _sized(personal_data)),
    ("best-fit packing", _sized(best_fit)),
]
#: Trained vectors and tokenizer ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
