"""Hard negatives by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label.  Each positive opens a window of scores, from
``LOW`` to ``HIGH`` hundredths of its own, and wants the best rows of other labels inside it.  The windows
of an anchor overlap, so they are not searched one by one: the distinct upper limits, falling, split the
scores into disjoint slots.  Every row falls into one slot of an anchor at most, tasks keep the best
``k`` of each slot only, and so do the combiners after them.  A window begins at the top of a slot; merging
this slot with the ones below it, in falling order, gives the best rows under its upper limit, of which
those above its lower limit are a prefix.

Anchors are taken in blocks of bounded bytes.  A block and its limits travel to all tasks, each row meets
it where it is read, and no row is shuffled: what leaves a task is ``k`` rows per anchor and slot.
Components are integers, so matrix products of doubles give exact scores while these are below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import share, shared
from tagloom.sources.staging import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
EVERY = 100
#: Bytes of the vectors of one block of anchors.
BLOCK_BYTES = 4 << 20
#: Rows that meet a block at a time.
STRIPE = 1024


def usable(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part; ``label`` may replace their own.

    Rows without an id, a label or a vector, and those with a null or non-finite component, do not.
    """
    bad = F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return (
        rows.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            (F.col("label") if label is None else label).cast("long").alias("label"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
        .filter(~bad)
    )


def whole(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The matrix of the scaled components, shorter vectors with zeros behind."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = vectors.flatten().to_numpy()
    return np.floor(SCALE * out)


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """All inner products of the rows of ``a`` and ``b`` as integers, and a bound of their size.

    Beyond the exact range of doubles they are summed as Python integers, and have to fit 64 bits.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64), int(bound) + 1
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    largest = max((abs(s) for row in exact for s in row), default=0)
    if largest >= 2**62:
        raise OverflowError("a score does not fit 64 bits")
    return np.array(exact, np.int64).reshape(len(a), len(b)), largest + 1


class Best:
    """The best ``k`` rows of each cell, by falling score, then by id."""

    def __init__(self, cells: int, k: int):
        self.score = np.full((cells, k), np.iinfo(np.int64).min)
        self.id = np.full((cells, k), np.iinfo(np.int64).max)
        self.real = np.zeros((cells, k), bool)
        self.k = k

    def add(self, cells: np.ndarray, score: np.ndarray, wanted: np.ndarray, ids: np.ndarray, bound: int):
        """Offer the rows of ``score`` (cells by rows) to ``cells``; ``ids`` must rise."""
        # What cannot replace a kept row need not be looked at.
        wanted = wanted & (score >= self.score[cells, -1][:, None])
        some = wanted.any(axis=1)
        if not some.any():
            return
        cells, score, wanted = cells[some], score[some], wanted[some]
        n = score.shape[1]
        least = np.iinfo(np.int64).min
        if bound < 2**62 // max(1, n):
            # One integer orders by score, then by place, which follows the id.
            key = np.where(wanted, score * n + np.arange(n)[::-1], least)
            kept = min(self.k, n)
            top = np.argpartition(key, n - kept, axis=1)[:, n - kept :]
        else:
            place = np.broadcast_to(np.arange(n), score.shape)
            top = np.lexsort((place, -score, ~wanted), axis=1)[:, : self.k]
        real = np.hstack([self.real[cells], np.take_along_axis(wanted, top, 1)])
        both = np.hstack([self.score[cells], np.take_along_axis(score, top, 1)])
        names = np.hstack([self.id[cells], ids[top]])
        order = np.lexsort((names, -both, ~real), axis=1)[:, : self.k]
        self.real[cells] = real = np.take_along_axis(real, order, 1)
        self.score[cells] = np.where(real, np.take_along_axis(both, order, 1), least)
        self.id[cells] = np.take_along_axis(names, order, 1)

    def batch(self, slots: int) -> pa.RecordBatch:
        cell = np.repeat(np.arange(len(self.real)), self.k).reshape(self.real.shape)[self.real]
        return pa.RecordBatch.from_arrays(
            [pa.array(cell // slots), pa.array(cell % slots), pa.array(self.id[self.real]), pa.array(self.score[self.real])],
            ["anchor", "slot", "vec_id", "score"],
        )


FOUND = "anchor long, slot long, vec_id long, score long"


def _stripes(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, STRIPE):
            part = batch.slice(at, STRIPE)
            order = np.argsort(part.column("vec_id").to_numpy(), kind="stable")
            yield (
                part.column("vec_id").to_numpy()[order],
                part.column("label").to_numpy()[order],
                whole(part.column("vector"))[order],
            )


def _combined(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each ``(anchor, slot)``: first among some tasks, then among all."""
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = [F.desc("score"), F.asc("vec_id")]
    group = F.pmod(F.spark_partition_id(), F.lit(max(1, int(tasks**0.5))))
    some = Window.partitionBy("anchor", "slot", "_group").orderBy(*best)
    every = Window.partitionBy("anchor", "slot").orderBy(*best)
    found = found.withColumn("_group", group).withColumn("_at", F.row_number().over(some))
    found = found.filter(F.col("_at") <= k).drop("_group", "_at")
    return found.withColumn("_at", F.row_number().over(every)).filter(F.col("_at") <= k).drop("_at")


def nearest_positives(rows: DataFrame, anchors: pa.Table, k: int = POSITIVES) -> DataFrame:
    """``(anchor, slot, vec_id, score)``: the best ``k`` rows of each anchor's label but those of its id.

    ``rows`` and ``anchors`` are of the form of ``usable``; ``anchor`` is the place in ``anchors``.
    """
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    box = share(rows.sparkSession, (ids, labels, whole(anchors.column("vector"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = shared(box)
        best = Best(len(ids), k)
        for own, label, vector in _stripes(batches):
            score, bound = products(vectors, vector)
            same = (labels[:, None] == label[None, :]) & (ids[:, None] != own[None, :])
            best.add(np.arange(len(ids)), score, same, own, bound)
        yield best.batch(1)

    return _combined(rows.mapInArrow(search, FOUND), k)


def limits(anchors: int, positives: list[tuple[int, int, int]], low: int, high: int):
    """Slots of each anchor from its ``positives (anchor, vec_id, score)``.

    ``upper[a]`` are the distinct upper limits, falling, ``least[a]`` is the smallest lower limit, and
    every positive comes back with the slot at whose top its window begins and its lower limit: ``(anchor,
    vec_id, score, slot, lowest)``.  A window without a whole number in it has no slot and is left out.
    """
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    for anchor, vec_id, score in positives:
        bottom, top = -(-low * score // 100), high * score // 100
        if bottom <= top:
            spans.setdefault(anchor, []).append((vec_id, score, bottom, top))
    width = max((len({s[3] for s in own}) for own in spans.values()), default=0)
    upper = np.full((anchors, width), np.iinfo(np.int64).min)
    least = np.full(anchors, np.iinfo(np.int64).max)
    placed = []
    for anchor, own in spans.items():
        tops = sorted({s[3] for s in own}, reverse=True)
        upper[anchor, : len(tops)] = tops
        least[anchor] = min(s[2] for s in own)
        placed += [(anchor, vec_id, score, tops.index(top), low_) for vec_id, score, low_, top in own]
    return upper, least, placed


def slot_negatives(
    rows: DataFrame, anchors: pa.Table, upper: np.ndarray, least: np.ndarray, k: int = NEGATIVES
) -> DataFrame:
    """``(anchor, slot, vec_id, score)``: the best ``k`` rows of other labels in each slot of an anchor.

    Slot ``j`` holds the scores above ``upper[a, j + 1]`` up to ``upper[a, j]``.
    """
    box = share(
        rows.sparkSession,
        (anchors.column("label").to_numpy(), whole(anchors.column("vector")), upper, least),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, vectors, upper, least = shared(box)
        n, slots = upper.shape
        best = Best(n * slots, k)
        for own, label, vector in _stripes(batches):
            score, bound = products(vectors, vector)
            other = (labels[:, None] != label[None, :]) & (score >= least[:, None])
            for slot in range(slots):
                inside = other & (score <= upper[:, slot, None])
                if slot + 1 < slots:
                    inside &= score > upper[:, slot + 1, None]
                best.add(np.arange(n) * slots + slot, score, inside, own, bound)
        yield best.batch(max(1, slots))

    return _combined(rows.mapInArrow(search, FOUND), k)


def merged(found: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The windows' rows from the best ``k`` of each slot: ``anchor, positive_id, positive_score, rank, ...``.

    A group has one row per slot and place at most.  A window takes the first ``k`` rows from its slot
    downwards, and of these the ones that reach its lower limit.
    """
    # The slots of an anchor are disjoint and fall, so one order by score merges them all.
    entry = F.struct((-F.col("score")).alias("down"), "vec_id", "slot")
    suffixes = found.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    from_slot = F.slice(F.filter("entries", lambda e: e["slot"] >= F.col("from_slot")), 1, k)
    reach = F.filter(from_slot, lambda e: -e["down"] >= F.col("lowest"))
    return (
        placed.join(suffixes, "anchor")
        .select("anchor", "positive_id", "positive_score", F.posexplode(reach).alias("at", "e"))
        .select(
            "anchor",
            "positive_id",
            (F.col("at") + 1).alias("rank"),
            F.col("e.vec_id").alias("negative_id"),
            "positive_score",
            (-F.col("e.down")).alias("negative_score"),
        )
    )


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor.

    ``rows`` and ``anchors`` are of the form of ``usable``; ``rows`` is read twice per block.  Rows that share an anchor's id are none of
    its positives; repeated rows each take part, and repeated anchors each get their answer.  Of equal
    scores the smaller id comes first.  A missing component counts as zero where vectors differ in length.
    An anchor without positives, and a window without rows, give nothing, as do empty tables.
    """
    spark = rows.sparkSession
    anchors = stage(anchors.select("vec_id", "label", "vector"), "anchors")
    rows = rows.select("vec_id", "label", "vector")
    size = anchors.agg(F.sum(8 * F.size("vector") + 16)).head()[0] or 0
    n_blocks = size // block_bytes + 1
    # Repeated anchors are dealt apart by their place, which is fixed once they are staged.
    dealt = anchors.withColumn("_at", F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64("vec_id", "_at"), F.lit(n_blocks))
    answers = []
    for i in range(n_blocks):
        own = dealt.filter(block == i).drop("_at").toArrow()
        near = nearest_positives(rows, own, positives)
        # At most ``positives`` rows per anchor of the block.
        known = [(r["anchor"], r["vec_id"], r["score"]) for r in near.collect()]
        upper, least, placed = limits(own.num_rows, known, low, high)
        names = own.column("vec_id").to_pylist()
        places = spark.createDataFrame(
            [(a, names[a], p, s, slot, lowest) for a, p, s, slot, lowest in placed],
            "anchor long, anchor_id long, positive_id long, positive_score long, from_slot long, lowest long",
        )
        best = slot_negatives(rows, own, upper, least, negatives)
        found = merged(best, places.drop("anchor_id"), negatives)
        answer = found.join(places.select("anchor", "anchor_id").distinct(), "anchor")
        answers.append(
            stage(
                answer.select(
                    "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
                ),
                "negatives",
            )
        )
    out = answers[0]
    for answer in answers[1:]:
        out = out.unionByName(answer)
    return out


def noisy_label() -> Column:
    """The label, moved by one of ten where the id is divisible by 7."""
    moved = (F.col("label").cast("long") + 1) % 10
    return F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, moved).otherwise(F.col("label"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine`` with the rows whose id is divisible by ``EVERY`` as anchors, after ``noisy_label``."""
    rows = usable(embeddings, noisy_label())
    return mine(rows, rows.filter(F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0))
