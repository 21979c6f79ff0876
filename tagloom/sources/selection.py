"""The first rows of a table, also when they are many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rows are taken by a plain ordered limit, which ends in one task of that size.
TAKEN_ROWS = 100_000


def first_rows(df: DataFrame, n: int, *keys: str, taken_rows: int = TAKEN_ROWS) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``keys``, nulls first; of equal keys at the cut any are taken.

    A large ``n`` is not brought into one task.  The keys are dealt into ranges, of which each reports its
    rows and its ends; ranges before the one that holds the ``n``-th row are kept whole by a filter, and
    only that one is cut, in the same way if it is large itself.  The keys of ``df`` are read twice, so stage
    what is dear to make.
    """
    if n <= taken_rows:
        return df.orderBy(*keys).limit(n)
    key = F.struct(*keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(*keys).repartitionByRange(max(tasks, n // max(64, taken_rows)), *keys)
    # One row per range.
    ranges = (
        ranged.groupBy(F.spark_partition_id().alias("_part"))
        .agg(F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
        .orderBy("_part")
        .collect()
    )
    before = 0
    for part in ranges:
        if before + part["rows"] > n:
            break
        before += part["rows"]
    else:
        return df

    def end(row):
        fields = df.select(*keys).schema.fields
        return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)))

    whole = df.filter(key < end(part["low"]))
    if before == n:
        return whole
    cut = df.filter((key >= end(part["low"])) & (key <= end(part["high"])))
    no_smaller = part["low"] == part["high"] or part["rows"] == sum(r["rows"] for r in ranges)
    if n - before <= taken_rows or no_smaller:
        return whole.unionByName(cut.orderBy(*keys).limit(n - before))
    return whole.unionByName(first_rows(cut, n - before, *keys, taken_rows=taken_rows))
