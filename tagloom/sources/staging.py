"""Shared staging area: where lineage is cut and intermediate tables live.

A cluster names a folder every executor can reach in ``spark.checkpoint.dir``.  Tables staged
there are ordinary parquet, so a lost executor costs a re-read of its splits and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a ``local`` master may run without one; it then gets a fresh folder of its own.  A cluster
    without the setting is an error, because no machine-local path would be visible to every node.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        current = context.getCheckpointDir()
        if current is not None:
            return current
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def new_location(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    base = _SCRATCH.get() or f"{shared_dir(spark).rstrip('/')}/tagloom"
    return f"{base}/{uuid.uuid4().hex}/{label}"


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[str]:
    """Own what is staged and checkpointed inside the ``with`` block, and delete it at its end.

    Frames are lazy: write the results that are to stay, elsewhere, before the block ends.  Blocks may
    be nested; each owns what its own code makes.
    """
    context = spark.sparkContext
    base = new_location(spark, "scratch")
    before = context.getCheckpointDir()
    token = _SCRATCH.set(base)
    context.setCheckpointDir(f"{base}/checkpoints")
    try:
        yield base
    finally:
        _SCRATCH.reset(token)
        context.setCheckpointDir(before)
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several passes need the same expensive rows.  Columnar files keep column pruning and
    filter pushdown for the later passes, which an RDD checkpoint would lose.
    """
    spark = df.sparkSession
    path = new_location(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for one round of an iterative job."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
