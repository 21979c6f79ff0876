"""SimHash near-duplicates by anchor-point covering.

The anchors are the pairs of codewords of the binary Golay code over two blocks of 23 bits of the
fingerprint.  The code is perfect with covering radius 3: every block value has exactly one codeword
within 3 bits, its home.  A fingerprint stays at its home anchor and is sent to every other anchor within
the covering radius plus the threshold: if two fingerprints differ in ``t`` bits, the blocks of one are at
most 3 plus its share of ``t`` away from the home of the other, so all anchors whose distances exceed 3 by
``t`` in sum are enough.  At each anchor the homes are compared with all that were sent there.

Copies disappear before that: only distinct fingerprints are covered, so a text on a third of all rows is
one fingerprint.  The comparison is an equi-join on the anchor with the Hamming distance as its further
condition; a crowded anchor is split by the adaptive skew join, and only real links leave it.  Linked
fingerprints form components by large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_bytes, free_name, row_key, with_columns
from tagloom.operators.graph import TagGraph, connected_components
from tagloom.sources.staging import stage

SHINGLE = 3
THRESHOLD = 2
SEED = 42
BLOCK = 23
RADIUS = 3
#: The generator polynomial of the Golay code [23, 12].
GENERATOR = 0b110001110101


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of ``size``-word shingles, repeats included, as a signed 64-bit integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, total, 4096):
        last = min(at + 4096, total)
        part = (b" ".join(words[i : i + size]) for i in range(at, last))
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(s, SEED) for s in part), np.dtype("<u8"), last - at
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with the column ``_fp``; null and empty texts have fingerprint zero."""

    def compute():
        return lambda part: [[fingerprint(t, size) for t in arrow_bytes(part.column("text"))]]

    added = T.StructType([T.StructField("_fp", T.LongType())])
    return with_columns(docs, added, compute, ("_fp",))


def syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of block values modulo the generator polynomial: equal within a coset."""
    rest = values.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def anchor_offsets(excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, pattern, over)``: by syndrome, what leads from a value to its anchors.

    ``pattern[first[s]:first[s + 1]]`` are the differences to all codewords within the covering radius
    plus ``excess`` of a value with syndrome ``s``, and ``over`` says by how much each exceeds the radius.
    """
    patterns, weights = [0], [0]
    for weight in range(1, RADIUS + excess + 1):
        for ones in combinations(range(BLOCK), weight):
            patterns.append(sum(1 << b for b in ones))
            weights.append(weight)
    pattern, weight = np.array(patterns), np.array(weights)
    syndrome = syndromes(pattern)
    order = np.lexsort((weight, syndrome))
    first = np.searchsorted(syndrome[order], np.arange(2**11 + 1))
    return first, pattern[order], np.maximum(weight[order] - RADIUS, 0)


def cover(
    values: np.ndarray, threshold: int, table: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, over)`` for all anchors of all values; ``over`` is 0 for the home only."""
    first, pattern, over = table
    mask = (1 << BLOCK) - 1
    rows = np.arange(len(values))
    anchor, spent = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for block in range(2):
        part = (values >> (BLOCK * block)) & mask
        syndrome = syndromes(part)[rows]
        begin, size = first[syndrome], first[syndrome + 1] - first[syndrome]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        rows, anchor, spent = (np.repeat(x, size) for x in (rows, anchor, spent))
        anchor = anchor | (part[rows] ^ pattern[at]) << (BLOCK * block)
        spent = spent + over[at]
        near = spent <= threshold
        rows, anchor, spent = rows[near], anchor[near], spent[near]
    return rows, anchor, spent


def near_pairs(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(src, dst)``, ``src < dst``: all pairs of distinct fingerprints within ``threshold`` bits.

    ``prints`` has one row per distinct fingerprint in ``fp``.
    """
    table = anchor_offsets(threshold)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2000):
                part = values[at : at + 2000]
                rows, anchor, spent = cover(part, threshold, table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(part[rows]), pa.array(spent == 0)],
                    ["anchor", "fp", "home"],
                )

    sent = prints.select("fp").mapInArrow(send, "anchor long, fp long, home boolean")
    homes = prints.select("fp").mapInArrow(send, "anchor long, fp long, home boolean")
    homes = homes.filter("home").select("anchor", F.col("fp").alias("at_home"))
    # Either of two linked fingerprints visits the home of the other; one direction is enough.
    close = (F.col("at_home") < F.col("fp")) & (
        F.bit_count(F.col("at_home").bitwiseXOR(F.col("fp"))) <= threshold
    )
    return (
        sent.join(homes, "anchor")
        .filter(close)
        .select(F.col("at_home").alias("src"), F.col("fp").alias("dst"))
        .distinct()
    )


def linked_components(links: DataFrame) -> DataFrame:
    """``(fp, component)`` for the ends of ``links (src, dst)``: the smallest end reachable."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    graph = TagGraph(ends.withColumn("name", F.lit("")), links.withColumn("weight", F.lit(1.0)))
    return connected_components(graph).select(F.col("id").alias("fp"), "component")


def components_of(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(fp, component)`` for fingerprints with a link: the smallest fingerprint reachable."""
    return linked_components(stage(near_pairs(prints, threshold), "links"))


def with_components(rows: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, row_key, fp, component, component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` of the component, null only if none of its rows has an
    id.  Only ``component`` tells components apart.
    """
    owned = prints.select("fp", "first_id").join(found, "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = owned.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answer = owned.join(smallest, "component").select("fp", "component", "component_id")
    return rows.join(answer, "fp").select("doc_id", "row_key", "fp", "component", "component_id")


def close_prints(
    docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """``with_components`` of rows that link when their fingerprints differ in ``threshold`` bits or fewer.

    Null, empty and blank texts have fingerprint zero and link like any other.  Repeated rows are linked
    to each other.  ``row_key`` tells rows of one id apart.  An empty table gives an empty result.
    """
    rows = stage(
        fingerprints(docs.select("doc_id", "text"), size).select(
            "doc_id", row_key().alias("row_key"), F.col("_fp").alias("fp")
        ),
        "fingerprints",
    )
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    return with_components(rows, prints, components_of(prints, threshold))


def component_report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row, the fingerprint as 16 hexadecimal digits."""
    return close_prints(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the row of the smallest id of each component stays.

    Components are those of ``close_prints``.  A null id comes after all others.  Of rows that share the id
    the one with the smallest text hash stays, of identical ones any one.  Null, empty and blank texts are
    one component; a text of any length counts as a whole.  All columns come back as they were, whatever
    their names.  An empty table gives an empty result.
    """
    found = close_prints(docs, size, threshold)
    stays = found.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("_s")
    )
    key = free_name(docs, "_row_key")
    kept = docs.withColumn(key, row_key())
    stays = stays.select(F.col("_s.doc_id").alias("_id"), F.col("_s.row_key").alias("_key"))
    return (
        kept.join(
            stays, kept["doc_id"].eqNullSafe(stays["_id"]) & (kept[key] == stays["_key"]), "left_semi"
        )
        .dropDuplicates(["doc_id", key])
        .select(*docs.columns)
    )
