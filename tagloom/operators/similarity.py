"""Cosine similarity of tags: one against all, best matches of every tag, all pairs.

Similarities are reported to nine decimals.  A sum of doubles depends on the order of its terms, so
equal vectors would otherwise differ in the last bits and ties would come out in a random order.

All-pairs work uses a blocked matrix product.  A join on terms would make one row per pair and
shared term, and frequent terms are in nearly every tag; a product of two blocks costs the same
arithmetic without the rows.  Tags are hashed into blocks of bounded size, a block is sent to each
block it has to meet, and only the wanted pairs come back.  Blocks grow with the number of tags up
to a limit that a task can hold; inside a task the product is formed in stripes of rows.

Above a minimum similarity most products need not be formed.  Blocks then hold similar tags, and centres,
radii and the lengths of partial vectors bound what a pair of blocks, a row and a product can reach.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.vectors import unit_length
from tagloom.sources.selection import first_rows
from tagloom.sources.staging import stage

# The block functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 9
MIN_BLOCK_TAGS = 1024
MAX_BLOCK_TAGS = 8192
MAX_BLOCK_CELLS = MAX_BLOCK_TAGS * 1000
STRIPE_ROWS = 512


def find_tag(tags: DataFrame, name: str) -> int:
    """The id of the tag called ``name``; an unknown name is an error."""
    row = tags.filter(F.col("tag_name") == name).select("tag_id").orderBy("tag_id").head()
    if row is None:
        raise ValueError(f"no vector for tag {name!r}")
    return row["tag_id"]


def similarities_to(vectors: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """``(tag_id, tag_name, similarity)`` of every tag to the named one, itself included.

    A tag with the zero vector has similarity 0.  The query's own entries, at most one per
    vocabulary term, are broadcast; products and lengths are summed together, in each map task
    first.
    """
    wanted = F.col("tag_id") == find_tag(tags, name)
    query = vectors.filter(wanted).select("term_idx", F.col("weight").alias("_q"))
    length = query.agg(F.sqrt(F.sum(F.col("_q") * F.col("_q")))).head()[0]
    sums = (
        vectors.join(F.broadcast(query), "term_idx", "left")
        .groupBy("tag_id")
        .agg(
            F.sum(F.col("weight") * F.col("_q")).alias("_dot"),
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"),
        )
    )
    product = F.col("_length") * F.lit(length or 0.0)
    cosine = F.when(product > 0, F.coalesce(F.col("_dot") / product, F.lit(0.0))).otherwise(0.0)
    return tags.join(sums, "tag_id", "left").select(
        "tag_id", "tag_name", F.round(cosine, DIGITS).alias("similarity")
    )


def similar_tags(
    vectors: DataFrame,
    tags: DataFrame,
    name: str,
    k: int | None = 20,
    include_self: bool = True,
) -> DataFrame:
    """Tags by falling similarity to the named one, equal ones by id.

    The best ``k`` come back with their ``rank``; the ranking window sees only those ``k`` rows.
    ``k=None`` gives the whole ordered list with ranks, numbered partition by partition.
    """
    scored = similarities_to(vectors, tags, name)
    if not include_self:
        scored = scored.filter(F.col("tag_name") != name)
    order = [F.desc("similarity"), F.asc("tag_id")]
    if k is None:
        return _numbered(scored.orderBy(*order))
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _numbered(ordered: DataFrame) -> DataFrame:
    """``ordered`` with ``rank``, its position; no task sees more than one partition of the sort.

    Rows are marked with their partition and place in it.  They are staged, because the sizes of the
    partitions, one row each, must belong to the same sort.
    """
    marked = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranking")
    marked = marked.withColumn("_part", F.shiftright("_at", 33))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        marked.join(F.broadcast(offsets), "_part")
        .withColumn("rank", (F.col("_before") + place).cast("int"))
        .drop("_at", "_part", "_before")
        .orderBy("rank")
    )


def _block_size(vectors: DataFrame, n_tags: int) -> int:
    """Tags per block: few enough blocks, and a dense block that fits a task for any vocabulary."""
    last = vectors.agg(F.max("term_idx")).head()[0]
    width = 1 if last is None else last + 1
    wanted = min(MAX_BLOCK_TAGS, max(MIN_BLOCK_TAGS, n_tags // 64))
    return max(1, min(wanted, MAX_BLOCK_CELLS // width))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _block_pairs(vectors: DataFrame, tags: DataFrame, block_tags: int | None):
    """Tags grouped by ``(low_block, high_block)``, every unordered pair of blocks once.

    A tag's entries are packed into one row, zero vectors included.  A row is sent to each pair its
    block takes part in, so a group holds two blocks, or one where a block meets itself.
    """
    n_tags = tags.count()
    if block_tags:
        n_blocks = math.ceil(n_tags / block_tags)
    else:
        # Twice as many pairs of blocks as tasks, unless that makes blocks of a few tags.
        wanted = math.ceil(math.sqrt(4 * _tasks(tags)))
        n_blocks = max(math.ceil(n_tags / _block_size(vectors, n_tags)), min(wanted, n_tags // 16))
    n_blocks = max(1, n_blocks)
    entries = F.collect_list(F.struct("term_idx", "weight"))
    rows = vectors.groupBy("tag_id").agg(entries.alias("_entries"))
    packed = tags.select("tag_id").join(rows, "tag_id", "left").select(
        "tag_id",
        F.coalesce("_entries.term_idx", F.array().cast("array<int>")).alias("terms"),
        F.coalesce("_entries.weight", F.array().cast("array<double>")).alias("value"),
        F.pmod(F.xxhash64("tag_id"), F.lit(n_blocks)).cast("int").alias("block"),
    )
    packed = unit_length(packed).withColumnRenamed("value", "weights")
    others = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    return (
        packed.withColumn("_other", others)
        .withColumn("low_block", F.least("block", "_other"))
        .withColumn("high_block", F.greatest("block", "_other"))
        .drop("_other")
        # The rows are few bytes but their products much work: the number of tasks is given, so that
        # adaptive execution does not put all of them into one.
        .repartition(max(n_blocks, _tasks(tags)), "low_block", "high_block")
        .groupBy("low_block", "high_block")
    )


def _dense(block: pa.Table, width: int) -> np.ndarray:
    """One row per tag of the block, in table order."""
    terms = block.column("terms").combine_chunks()
    counts = np.diff(terms.offsets.to_numpy())
    out = np.zeros((block.num_rows, width))
    rows = np.repeat(np.arange(block.num_rows), counts)
    out[rows, terms.flatten().to_numpy()] = (
        block.column("weights").combine_chunks().flatten().to_numpy()
    )
    return out


def _blocks(key, group: pa.Table):
    """The two blocks of a group as ``(ids, matrix)``, ids rising, and whether they are the same."""
    low, high = key[0].as_py(), key[1].as_py()
    group = group.sort_by("tag_id")
    top = group.column("terms").combine_chunks().flatten().to_numpy()
    dense = _dense(group, 1 + int(top.max()) if len(top) else 1)
    ids, block = group.column("tag_id").to_numpy(), group.column("block").to_numpy()
    if low == high:
        return (ids, dense), (ids, dense), True
    left, right = block == low, block == high
    return (ids[left], dense[left]), (ids[right], dense[right]), False


def _stripes(rows, columns):
    """Cosines of two blocks, some rows at a time: ``(row ids, column ids, matrix)``."""
    ids, dense = rows
    for start in range(0, len(ids), STRIPE_ROWS):
        part = slice(start, start + STRIPE_ROWS)
        yield ids[part], columns[0], np.round(dense[part] @ columns[1].T, DIGITS)


def cosine_pairs(
    vectors: DataFrame,
    tags: DataFrame,
    min_similarity: float | None = None,
    block_tags: int | None = None,
) -> DataFrame:
    """``(src, dst, similarity)`` with ``src < dst`` for each pair of tags.

    With ``min_similarity`` only pairs at least that similar come back.  Without it every pair
    does, those with similarity 0 too: a complete matrix, so bound the number of tags first.
    """

    def pairs(
        key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        left, right, same = _blocks(key, pa.Table.from_batches(group))
        for rows, columns, cosines in _stripes(left, right):
            wanted = cosines >= (-1.0 if min_similarity is None else min_similarity)
            if same:
                wanted &= rows[:, None] < columns[None, :]
            i, j = np.nonzero(wanted)
            a, b = rows[i], columns[j]
            ends = {"src": np.minimum(a, b), "dst": np.maximum(a, b)}
            # Stripe by stripe, so that a task never holds all pairs of its blocks.
            yield pa.RecordBatch.from_pydict(
                ends | {"similarity": cosines[i, j]}, schema=arrow_schema
            )

    arrow_schema = pa.schema(
        [("src", pa.int64()), ("dst", pa.int64()), ("similarity", pa.float64())]
    )
    return _block_pairs(vectors, tags, block_tags).applyInArrow(
        pairs, "src bigint, dst bigint, similarity double"
    )


#: What rounding can do to an angle between unit vectors.
ANGLE_MARGIN = 1e-6


@dataclass(frozen=True)
class BlockPlan:
    """Blocks of similar tags, and which pairs of blocks can hold a pair that is similar enough."""

    #: ``(tag_id, terms, weights, block)``: unit vectors, zero vectors left out.
    rows: DataFrame
    #: One row per block: the unit vector in the middle, and the largest angle of a member to it.
    centres: np.ndarray
    radii: np.ndarray
    #: Pairs of blocks ``low <= high`` that have to meet.
    meets: list[tuple[int, int]]

    @property
    def skipped(self) -> float:
        """The share of block pairs that are never formed."""
        n = len(self.radii)
        return 1 - len(self.meets) / max(1, n * (n + 1) // 2)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _unit_rows(vectors: DataFrame, tags: DataFrame) -> DataFrame:
    """``(tag_id, terms, weights)``: one row per tag, of length one; zero vectors are left out."""
    entries = F.collect_list(F.struct("term_idx", "weight"))
    kept = vectors.filter("weight <> 0").join(tags.select("tag_id"), "tag_id", "left_semi")
    packed = kept.groupBy("tag_id").agg(entries.alias("_entries")).select(
        "tag_id", F.col("_entries.term_idx").alias("terms"), F.col("_entries.weight").alias("value")
    )
    return unit_length(packed).withColumnRenamed("value", "weights")


def _with_product(
    rows: DataFrame, width: int, name: str, kind: T.DataType, per_block: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]
) -> DataFrame:
    """``rows`` with a column computed from the dense vectors of each batch."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIPE_ROWS):
                part = batch.slice(at, STRIPE_ROWS)
                found = per_block(_dense(pa.Table.from_batches([part]), width), part)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*kept, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def plan_blocks(
    vectors: DataFrame, tags: DataFrame, min_similarity: float, block_tags: int | None = None
) -> BlockPlan:
    """Tags in blocks around pivots, with the bounds that tell which blocks can hold similar pairs.

    Pivots are the tags of the smallest hashes, one for as many tags as a block holds.  A tag goes to the
    pivot it is most similar to; what exceeds a block is dealt into several.  Two unit vectors are at least
    as far apart as their blocks' centres less both radii, as angles, so blocks whose centres are further
    apart never meet.  Only pivots, centres and radii reach the driver, a few rows per block.
    """
    spark = vectors.sparkSession
    n_tags = tags.count()
    size = block_tags or _block_size(vectors, n_tags)
    if n_tags <= size:  # one block, which meets itself only
        rows = _unit_rows(vectors, tags).withColumn("block", F.lit(0))
        return BlockPlan(rows, np.zeros((1, 1)), np.array([math.pi]), [(0, 0)])
    width = 1 + (vectors.agg(F.max("term_idx")).head()[0] or 0)
    rows = stage(_unit_rows(vectors, tags), "unit_vectors")
    pivots = rows.orderBy(F.xxhash64("tag_id"), "tag_id").limit(math.ceil(n_tags / size)).toArrow()
    if not pivots.num_rows:
        nothing = rows.withColumn("block", F.lit(0))
        return BlockPlan(nothing, np.zeros((0, width)), np.zeros(0), [])
    box = spark.sparkContext.broadcast(_dense(pivots, width))
    nearest = stage(
        _with_product(
            rows, width, "_cluster", T.LongType(), lambda dense, _: (dense @ box.value.T).argmax(axis=1)
        ),
        "clusters",
    )
    counts = {r["_cluster"]: r["count"] for r in nearest.groupBy("_cluster").count().collect()}
    first, parts, n_blocks = {}, {}, 0
    for cluster in sorted(counts):
        first[cluster], parts[cluster] = n_blocks, math.ceil(counts[cluster] / size)
        n_blocks += parts[cluster]
    table = spark.createDataFrame(
        [(c, first[c], parts[c]) for c in sorted(counts)], "_cluster long, _first int, _parts int"
    )
    place = F.col("_first") + F.pmod(F.xxhash64("tag_id"), F.col("_parts")).cast("int")
    rows = nearest.join(F.broadcast(table), "_cluster").select(
        "tag_id", "terms", "weights", place.alias("block")
    )
    entries = rows.select("block", F.explode(F.arrays_zip("terms", "weights")).alias("_e"))
    sums = entries.groupBy("block", "_e.terms").agg(F.sum("_e.weights").alias("sum")).toArrow()
    centres = np.zeros((n_blocks, width))
    centres[sums.column(0).to_numpy(), sums.column(1).to_numpy()] = sums.column(2).to_numpy()
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.divide(centres, lengths, out=np.zeros_like(centres), where=lengths > 0)
    middle = spark.sparkContext.broadcast(centres)

    def to_centre(dense: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        own = middle.value[part.column("block").to_numpy()]
        return np.einsum("ij,ij->i", dense, own)

    far = _with_product(rows, width, "_cosine", T.DoubleType(), to_centre)
    least = {r["block"]: r["least"] for r in far.groupBy("block").agg(F.min("_cosine").alias("least")).collect()}
    radii = _angles(np.array([least.get(b, 1.0) for b in range(n_blocks)]))
    apart = _angles(centres @ centres.T) - radii[:, None] - radii[None, :]
    near = apart <= math.acos(min(1.0, min_similarity)) + ANGLE_MARGIN
    np.fill_diagonal(near, True)
    low, high = np.nonzero(np.triu(near))
    return BlockPlan(rows, centres, radii, list(zip(low.tolist(), high.tolist())))


def _products_above(left: np.ndarray, right: np.ndarray, least: float, head: int):
    """``(i, j, cosine)`` of the rows of two blocks whose rounded cosine is at least ``least``.

    The product over the first ``head`` columns, with the lengths of what is left of the rows, bounds the
    whole product; only rows and columns with a pair that can reach ``least`` are multiplied in full.
    """
    rest_left = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", left[:, :head], left[:, :head])))
    rest_right = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", right[:, :head], right[:, :head])))
    bound = left[:, :head] @ right[:, :head].T + rest_left[:, None] * rest_right[None, :]
    possible = bound >= least - ANGLE_MARGIN
    rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
    cosines = np.round(left[rows] @ right[columns].T, DIGITS)
    i, j = np.nonzero(cosines >= least)
    return rows[i], columns[j], cosines[i, j]


def close_pairs(
    vectors: DataFrame,
    tags: DataFrame,
    min_similarity: float,
    block_tags: int | None = None,
) -> DataFrame:
    """``cosine_pairs`` for a positive ``min_similarity``, without most of the products that fail it.

    Exact: blocks, rows and products are left out only where a bound proves that no pair reaches the
    minimum.  Tags of up to one block are one product.
    """
    if min_similarity <= 0:
        return cosine_pairs(vectors, tags, min_similarity, block_tags)
    plan = plan_blocks(vectors, tags, min_similarity, block_tags)
    spark = vectors.sparkSession
    partners = [(low, low, high) for low, high in plan.meets]
    partners += [(high, low, high) for low, high in plan.meets if low != high]
    dealt = plan.rows.join(
        F.broadcast(spark.createDataFrame(partners, "block int, low_block int, high_block int")), "block"
    )
    box = spark.sparkContext.broadcast((plan.centres, plan.radii))
    angle = math.acos(min(1.0, min_similarity)) + ANGLE_MARGIN
    arrow_schema = pa.schema(
        [("src", pa.int64()), ("dst", pa.int64()), ("similarity", pa.float64())]
    )

    def reaching(rows, other: int, centres: np.ndarray, radii: np.ndarray):
        """The rows that may have a partner in another block, by their angle to its centre."""
        ids, dense = rows
        centre = np.zeros(dense.shape[1])
        common = min(len(centre), centres.shape[1])
        centre[:common] = centres[other, :common]
        near = _angles(dense @ centre) - radii[other] <= angle
        return ids[near], dense[near]

    def pairs(
        key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        left, right, same = _blocks(key, pa.Table.from_batches(group))
        if not same:
            centres, radii = box.value
            low, high = key[0].as_py(), key[1].as_py()
            left, right = reaching(left, high, centres, radii), reaching(right, low, centres, radii)
        if not len(left[0]) or not len(right[0]):
            return
        # The columns of most weight first, so that few of them bound the product well.
        order = np.argsort(-(np.square(left[1]).sum(axis=0) + np.square(right[1]).sum(axis=0)))
        columns = right[1][:, order]
        head = max(1, len(order) // 4)
        for start in range(0, len(left[0]), STRIPE_ROWS):
            stripe = slice(start, start + STRIPE_ROWS)
            i, j, cosines = _products_above(left[1][stripe][:, order], columns, min_similarity, head)
            a, b = left[0][stripe][i], right[0][j]
            wanted = a < b if same else np.ones(len(a), bool)
            ends = {"src": np.minimum(a, b)[wanted], "dst": np.maximum(a, b)[wanted]}
            yield pa.RecordBatch.from_pydict(ends | {"similarity": cosines[wanted]}, schema=arrow_schema)

    return (
        dealt.repartition(max(len(plan.radii), _tasks(tags)), "low_block", "high_block")
        .groupBy("low_block", "high_block")
        .applyInArrow(pairs, "src bigint, dst bigint, similarity double")
    )


def first_tags(tags: DataFrame, tag_count: int) -> DataFrame:
    """The first ``tag_count`` tags by id."""
    return first_rows(tags, tag_count, "tag_id")


def pairwise_cosine(
    vectors: DataFrame,
    tags: DataFrame,
    tag_count: int | None = None,
    block_tags: int | None = None,
) -> DataFrame:
    """The cosine matrix of all tags, or of the first ``tag_count`` of them, in sparse form.

    ``(src, dst, similarity)`` for the pairs ``src < dst`` whose similarity is not 0.  The matrix
    grows with the square of the tags; for many tags ask for ``close_pairs``.
    """
    chosen, kept = tags, vectors
    if tag_count is not None:
        chosen = first_tags(tags, tag_count)
        kept = vectors.join(chosen.select("tag_id"), "tag_id", "left_semi")
    return cosine_pairs(kept, chosen, 0.5 * 10**-DIGITS, block_tags)


def similar_tags_all(
    vectors: DataFrame,
    tags: DataFrame,
    k: int = 20,
    include_self: bool = True,
    block_tags: int | None = None,
) -> DataFrame:
    """The best ``k`` tags of every tag: ``(query_id, tag_id, similarity, rank)``.

    Each block pair keeps the best ``k`` per query under the final order, so the best ``k`` overall
    are among them; the ranking window sees at most ``k`` rows per query and block.
    """
    arrow_schema = pa.schema(
        [("query_id", pa.int64()), ("tag_id", pa.int64()), ("similarity", pa.float64())]
    )

    def best(queries, others, cosines):
        n = len(others)
        # One integer per pair orders by similarity, then by position, which follows the id.
        order = np.rint(cosines * 10**DIGITS).astype(np.int64) * n + np.arange(n)[::-1]
        if not include_self:
            cosines = np.where(queries[:, None] == others[None, :], -1.0, cosines)
            order = np.where(cosines < 0, -1, order)
        kept = min(k, n)
        top = np.argpartition(order, n - kept, axis=1)[:, n - kept :]
        similarity = np.take_along_axis(cosines, top, axis=1).ravel()
        real = similarity >= 0
        return pa.table(
            {
                "query_id": np.repeat(queries, kept)[real],
                "tag_id": others[top].ravel()[real],
                "similarity": similarity[real],
            },
            schema=arrow_schema,
        )

    def candidates(key, group):
        left, right, same = _blocks(key, group)
        found = [arrow_schema.empty_table()]
        if len(left[0]) and len(right[0]):
            found += [best(*stripe) for stripe in _stripes(left, right)]
            if not same:
                found += [best(*stripe) for stripe in _stripes(right, left)]
        return pa.concat_tables(found)

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("tag_id"))
    return (
        _block_pairs(vectors, tags, block_tags)
        .applyInArrow(candidates, "query_id bigint, tag_id bigint, similarity double")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
