"""A store of vectors and tags that is bucketed and sorted by tag.

Ranking and graph jobs join vectors with tags on ``tag_id``; buckets of equal number on both sides make that
join, and an aggregate by tag, without a shuffle.  A reader that asks for one tag opens one bucket.  The files
are ordinary parquet.  Their layout is written beside them, so that any session can open the store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.store import VECTOR_COLUMNS, tag_dim

VECTORS = "tag_id BIGINT, term_idx INT, weight DOUBLE"
TAGS = "tag_id BIGINT, tag_key STRING, tag_name STRING"


def _names(path: str) -> tuple[str, str]:
    """Table names of a store in the session's catalogue, by its path."""
    key = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]
    return f"vectors_{key}", f"tags_{key}"


def _write(df: DataFrame, name: str, path: str, buckets: int, *order: str) -> None:
    # Dealt by the bucket first: each bucket is written by one task, as one sorted file.
    (
        df.repartition(buckets, "tag_id")
        .write.bucketBy(buckets, "tag_id")
        .sortBy(*order)
        .format("parquet")
        .option("path", path)
        .saveAsTable(name)
    )


def save_keyed(vectors: DataFrame, tags: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write vectors and tags in ``buckets``, by default one per shuffle partition, under ``path``."""
    spark = vectors.sparkSession
    path = path.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vector_name, tag_name = _names(path)
    _write(vectors.select(*VECTOR_COLUMNS), vector_name, f"{path}/vectors", buckets, "tag_id", "term_idx")
    _write(tag_dim(tags), tag_name, f"{path}/tags", buckets, "tag_id")
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/layout")


def load_keyed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The vectors and tags under ``path``, with their layout known to the planner."""
    path = path.rstrip("/")
    buckets = spark.read.schema("buckets INT").parquet(f"{path}/layout").head()["buckets"]
    frames = []
    for name, columns, folder, order in zip(
        _names(path), (VECTORS, TAGS), ("vectors", "tags"), ("tag_id, term_idx", "tag_id")
    ):
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (tag_id) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'"
        )
        frames.append(spark.table(name))
    return frames[0], frames[1]


def forget_keyed(spark: SparkSession, path: str) -> None:
    """Take the store's tables out of the session's catalogue; the files stay."""
    for name in _names(path.rstrip("/")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
