"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every document becomes a fixed-size record: digest of its normalised text, two check values and its
rank.  Records are dealt into ``RUNS`` runs by a hash of the id, and each run is reduced to one record
per digest, sorted by the aggregate.  Then the runs meet in rounds: in each round ``FAN`` neighbouring
runs are merged, and of equal records the best identifier stays.  Digest, length and a second hash
together are the key of every level, so a record only merges with one that passes all three checks.

No task sees a whole run: a level is partitioned by digest and run.  A digest on a third of all
documents is spread over ``RUNS`` runs in the first level, where nearly all of its rows disappear; later
levels hold at most ``RUNS`` records of it.  The way back joins documents with their own run's record,
so the hot digest is spread over the runs there as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import documents
from tagloom.sources.staging import stage

RUNS = 256
FAN = 4
SPACE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "n_norm", "check"]


def digest_records(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, n_norm, check, n_points, run)`` per row; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    norm = F.regexp_replace("_text", SPACE, "")
    return (
        documents(docs)
        .select("doc_id", text.alias("_text"))
        .select("doc_id", norm.alias("_norm"), F.char_length("_text").cast("long").alias("n_points"))
        .select(
            "doc_id",
            F.unhex(F.sha2("_norm", 256)).alias("digest"),
            F.char_length("_norm").cast("long").alias("n_norm"),
            F.xxhash64("_norm").alias("check"),
            "n_points",
            F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).cast("int").alias("run"),
        )
    )


def merge_runs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first level ``(key, run)`` and the root ``(key, best, group_size)`` of the merge tree."""
    # The smallest rank wins: most code points, then the smallest id, a null id last.
    rank = F.struct(
        (-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id"
    )
    first = records.groupBy(*KEY, "run").agg(
        F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    level, runs = first, RUNS
    while runs > 1:
        level = level.groupBy(*KEY, F.expr(f"run div {FAN}").cast("int").alias("run")).agg(
            F.min("best").alias("best"), F.sum("group_size").alias("group_size")
        )
        runs //= FAN
    return first, level.drop("run")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII white space.  Of equal texts the one with the
    most code points in the original stays, then the smallest id.  Null and empty texts are one group.
    Rows repeated with the same id and text all count in ``group_size`` and share their answer.
    An empty table gives an empty result.
    """
    records = stage(digest_records(docs), "digests")
    first, root = merge_runs(records)
    answers = first.select(*KEY, "run").join(root, KEY)
    return records.join(answers, [*KEY, "run"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (
            F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
            & (F.col("n_points") == -F.col("best.less"))
        ).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
