"""Joins of a large fact frame with a look-up frame, safe for hot keys.

One key may hold a third of all facts.  A small look-up side is broadcast, after its size was
checked; a larger one is joined by shuffle with the hot keys salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than this share of what a shuffle partition gets on average.
HOT_SHARE = 0.25


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows: one distributed count."""
    return df.count() <= rows


def hot_keys(facts: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """All keys of ``facts`` with more than ``share`` of an average shuffle partition's rows.

    Found by a count that combines before it shuffles.  There are fewer of them than partitions divided
    by ``share``, whatever the data, so they can be broadcast.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = facts.count() * share / partitions
    counts = facts.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter((F.col("_n") > least) & (F.col("_n") > 1)).select(key)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    salt_by: str,
    small: bool | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner join of ``facts`` with ``lookup`` on ``key``.

    ``small`` says whether ``lookup`` is, if the caller has checked its size already.  ``salt_by``
    is a column of ``facts`` whose values differ inside a hot group.  ``hot`` is the ``hot_keys``
    of ``facts``, if the caller joins the same facts again and again.
    """
    if is_small(lookup) if small is None else small:
        return facts.join(F.broadcast(lookup), key)
    return salted_join(facts, lookup, key, salt_by, hot)


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    salt_by: str,
    hot: DataFrame | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Inner equi-join where the most frequent keys are spread over ``spread`` salts.

    Each fact of a hot key gets one salt, each look-up row of a hot key is repeated for every salt:
    at most ``spread`` rows for each look-up row of a hot key.  By default there are as
    many salts as shuffle partitions, so even a key on most rows fills them evenly.  The salt is a
    hash, so a retried task sends its rows to the same places.
    """
    if spread is None:
        spread = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(facts, key) if hot is None else hot
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(salt_by), F.lit(spread)).cast("int")
    every = F.sequence(F.lit(0), F.lit(spread - 1))
    salted = facts.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(0)
    )
    repeated = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("_hot").join(repeated.drop("_hot"), [key, "_salt"]).drop("_salt")
