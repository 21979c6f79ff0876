"""Parquet stores for tag vectors and the tag dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_COLUMNS = ("tag_id", "term_idx", "weight")


def save_vectors(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(tag_id, term_idx, weight)`` rows, each tag in one file, sorted by tag.

    The row groups of a file then have narrow ``tag_id`` ranges, so reading the vector of one tag
    skips most of them.  A tag has at most one row per vocabulary term, so no file is much larger.
    """
    (
        vectors.select(*VECTOR_COLUMNS)
        .repartition("tag_id")
        .sortWithinPartitions("tag_id", "term_idx")
        .write.mode(mode)
        .parquet(path)
    )


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tag_id bigint, term_idx int, weight double").parquet(path)


def save_tag_dim(tags: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the id and name of every tag; it serves look-ups in both directions."""
    tag_dim(tags).write.mode(mode).parquet(path)


def load_tag_dim(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tag_id bigint, tag_key string, tag_name string").parquet(path)


def tag_dim(tags: DataFrame) -> DataFrame:
    """``tag_id``, the same id as a string key, and ``tag_name``."""
    return tags.select("tag_id", F.col("tag_id").cast("string").alias("tag_key"), "tag_name")
