"""A corpus pipeline: each stage reads all that its predecessor kept.

The mixing stage repeats documents of smaller sources up to ``REPEATS`` times and drops none. So a document that several
sources' budgets reach again is packed once for each use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlane.llm.exact_dedup import deduplicate
from arborlane.llm.mixing import Target, mix
from arborlane.llm.ngram_join import SETTLE, keep_one
from arborlane.llm.packing import pack
from arborlane.llm.quality import accept
from arborlane.session import collect_shuffles, materialise, release

REPEATS = 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group that near-duplicate links join."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget uses them, each at least once."""
    return mix(docs, Target(repeats=REPEATS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: The classifier, near-duplicate groups and tokens are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written as Parquet in the shared folder and read again.

    What a stage read, and its shuffles, go once it is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        read, docs = docs, materialise(stage(spark, docs, sf_dir), "".join(c for c in name if c.isalpha()))
        release(read)
        collect_shuffles(spark, SETTLE)
    return docs
