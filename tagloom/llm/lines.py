"""Line deduplication by overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines of a document are hashed in their row, without a shuffle.  An aggregate
that combines in the map tasks finds the windows that occur more than once and the first occurrence of
each; a join returns the later ones to their documents, where covered positions are merged and the
lines there leave the text.  A window on a third of all documents is one row per task in the aggregate;
in the join its rows are split by the adaptive skew join, since nothing above it needs them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import documents, free_name, row_key, same_row

WINDOW = 3


def _lines() -> Column:
    return F.split("text", "\n", -1)


def line_windows(docs: DataFrame) -> DataFrame:
    """``(h1, h2, doc_id, row_key, pos)``: a 128-bit hash for each three consecutive lines."""

    def hashed(lines: Column, i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(
            F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *reversed(parts)).alias("h2")
        )

    starts = F.sequence(F.lit(0), F.size("_lines") - WINDOW)
    return (
        documents(docs)
        .select("doc_id", row_key().alias("row_key"), _lines().alias("_lines"))
        .filter(F.size("_lines") >= WINDOW)
        .select(
            "doc_id",
            "row_key",
            F.posexplode(F.transform(starts, lambda i: hashed(F.col("_lines"), i))).alias(
                "pos", "_h"
            ),
        )
        .select("_h.h1", "_h.h2", "doc_id", "row_key", "pos")
    )


def repeated_windows(windows: DataFrame) -> DataFrame:
    """``(h1, h2, first)`` of windows that occur more than once; a null id comes last."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "pos")
    return (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("h1", "h2", "first")
    )


def _packed(docs: DataFrame, columns: list[str]) -> Column:
    """The columns as one struct, which also may have none of them."""
    return F.struct(F.lit(0).alias(free_name(docs, "_")), *columns)


def _deduped(docs: DataFrame, others: Column) -> DataFrame:
    """``doc_id, text, _n, _left, _null, _others``: texts without repeats, line counts, ``others`` as it was."""
    own = docs.select("doc_id", "text", row_key().alias("row_key"), others.alias("_others"))
    windows = line_windows(docs)
    first = repeated_windows(windows)
    later = (
        windows.join(first, ["h1", "h2"])
        .filter(
            ~(
                F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
                & (F.col("row_key") == F.col("first.row_key"))
                & (F.col("pos") == F.col("first.pos"))
            )
        )
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set("pos").alias("starts"))
    )
    covered = F.flatten(
        F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)]))
    )
    lines = _lines()
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.when(
        F.col("starts").isNull(), F.col("text")
    ).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    later = later.alias("later")
    return own.join(later, same_row(own, later), "left").select(
        own["doc_id"],
        kept.alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("_n"),
        F.when(F.col("starts").isNull(), F.size(lines)).otherwise(F.size(left)).alias("_left"),
        F.col("text").isNull().alias("_null"),
        "_others",
    )


def dedup_lines(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id, text, n_lines, n_removed``: every row with the lines of repeated windows removed.

    With ``carry`` the other columns of ``docs`` come along, unless they are named like one of these.

    Lines end at line feeds.  A window is three consecutive lines; of equal windows the first by
    ``(doc_id, line)`` stays, and every line that a later occurrence covers goes, also where it overlaps
    an occurrence that stays.  Fewer than three lines are never removed.  Null text has no lines and
    stays null; empty text is one empty line.  Rows that repeat an id and its text are one document.
    """
    names = ["doc_id", "text", "n_lines", "n_removed"]
    others = [c for c in docs.columns if c not in names] if carry else []
    found = _deduped(docs, _packed(docs, others))
    return found.select(
        "doc_id",
        "text",
        F.when(F.col("_null"), 0).otherwise(F.col("_n")).cast("long").alias("n_lines"),
        F.when(F.col("_null"), 0).otherwise(F.col("_n") - F.col("_left")).cast("long").alias("n_removed"),
        *[F.col("_others").getField(c).alias(c) for c in others],
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``dedup_lines``; all other columns as they were, whatever their names.

    Only ``n_chars``, where there is one, follows the text.  Every row stays, null texts as null.
    """

    def value(column: T.StructField) -> Column:
        if column.name == "text":
            return F.col("text")
        if column.name == "n_chars":
            return F.char_length("text").cast(column.dataType).alias("n_chars")
        return F.col("_others").getField(column.name).alias(column.name)

    found = _deduped(docs, _packed(docs, [c for c in docs.columns if c != "text"]))
    return found.select(*[value(c) for c in docs.schema.fields])
