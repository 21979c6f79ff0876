"""What the operators of this folder share: table access, document keys and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that no other column can clash with an operator's own."""
    return docs.select("doc_id", "text")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put after it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """Tells apart rows that share a ``doc_id`` but not a text; never null."""
    return F.xxhash64("text")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on ``doc_id`` and ``row_key``, null ids included."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["row_key"] == right["row_key"])


def crc_of_id() -> Column:
    """CRC-32 of the id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast a bounded object with the classes it needs, which executors may not have."""
    return spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})


def shared(box: Broadcast) -> Any:
    """What ``share`` was given: unpacked once per Python worker, so that its caches outlive a task."""
    held = box.value
    if "value" not in held:
        held["value"] = cloudpickle.loads(held["packed"])
    return held["value"]


def arrow_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def with_columns(
    df: DataFrame,
    added: T.StructType,
    compute: Callable[[], Callable[[pa.RecordBatch], list[list]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``added``, computed per Arrow batch.

    ``compute`` is called once in each task and returns the function of a batch, which gives one list
    per added column.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + list(added.fields))
    names, fresh = [f.name for f in kept], list(added.fields)
    arrow = to_arrow_schema(T.StructType(fresh))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_batch = compute()
        for batch in batches:
            # A few rows at a time, so that long texts do not add up.
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                new = [pa.array(v, arrow.field(i).type) for i, v in enumerate(per_batch(part))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + new, names + arrow.names
                )

    return df.mapInArrow(run, schema)
