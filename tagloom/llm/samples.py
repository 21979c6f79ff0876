"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import crc_of_id
from tagloom.sources.staging import stage

#: How many labelled rows a fit reads, in expectation.
SAMPLE_ROWS = 20_000


def hash_share(rate: float) -> Column:
    """True for a share ``rate`` of the ids, the same ones in every run."""
    hashed = F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    return hashed <= min(int(rate * 2**63), (1 << 63) - 1)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int
) -> DataFrame:
    """``(text, label)`` of at most about ``rows`` labelled documents outside the held-out fold.

    An id with several labels takes the largest; null ids, labels and texts are left out, and of equal
    texts one stays.  The sampled ids are broadcast: their number is bounded by ``rows``.
    """
    own = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(F.pmod(crc_of_id(), F.lit(folds)) != held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    rate = min(1.0, rows / max(1, own.count()))
    chosen = own.filter(hash_share(rate)).select(F.col("doc_id").alias("_id"), "label")
    found = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id")
    )
    found = found.filter("text IS NOT NULL").groupBy(F.xxhash64("text")).agg(
        F.min_by("text", "doc_id").alias("text"), F.max("label").alias("label")
    )
    return stage(found.select("text", "label"), "sample")
