"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item.  A document holds a window only if it holds every
word of it, so one necessary word is enough to find candidates: the prefix of a window is its rarest word
by document frequency, counted over all documents.  A task joins the words of a document with these
prefixes; the offset of the prefix in its window bounds where the window can start and end, and a
candidate that fits is verified word by word.

Documents are not shuffled.  The windows travel to the tasks in blocks of items of a bounded size; with
more than one block the documents are passed over once per block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_bytes, free_name, share, shared, with_columns
from tagloom.sources.staging import stage

WINDOW = 10
BLOCK_BYTES = 8 << 20

#: Bytes of words map to themselves, A-Z to a-z, all others to a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(FOLD).split()


def item_windows(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """Every ``size`` consecutive words; an item of fewer words is one window, of none has none."""
    for i in range(max(len(words) - size + 1, min(len(words), 1))):
        yield tuple(words[i : i + size])


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a block occurs: at most one row per word reaches the driver."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in arrow_bytes(batch.column(0)):
                found.update(known.value.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
            ["word", "n"],
        )

    counts = docs.select("text").mapInArrow(count, "word binary, n long")
    totals = counts.groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()
    return {bytes(word): n for word, n in totals}


class PrefixTable:
    """Windows of one block of items under their rarest word."""

    def __init__(self, items: list[tuple[str, bytes]], frequency: dict[bytes, int]):
        self.items: dict[tuple[bytes, ...], set[str]] = {}
        #: By prefix word: the offsets at which it stands and the lengths of the windows.
        self.places: dict[bytes, set[tuple[int, int]]] = {}
        for item_id, text in items:
            for window in item_windows(words_of(text)):
                if window not in self.items:
                    rarest = min(window, key=lambda w: (frequency.get(w, 0), w))
                    self.places.setdefault(rarest, set()).add((window.index(rarest), len(window)))
                self.items.setdefault(window, set()).add(item_id)
        self.prefixes = frozenset(self.places)

    def search(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """Positions of words inside an occurring window, and the items with such windows."""
        hit: set[int] = set()
        items: set[str] = set()
        present = self.prefixes.intersection(words)
        if not present:
            return hit, items
        n = len(words)
        for at, word in enumerate(words):
            if word in present:
                for offset, size in self.places[word]:
                    start = at - offset
                    if start >= 0 and start + size <= n:
                        owners = self.items.get(tuple(words[start : start + size]))
                        if owners:
                            hit.update(range(start, start + size))
                            items |= owners
        return hit, items


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Items dealt by hash into blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(
        "text IS NOT NULL"
    )
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = size // block_bytes + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.filter(block == i) for i in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str] = ("_n_words", "_hit", "_items"),
) -> DataFrame:
    """``docs`` with the number of words, the positions of hit words and the items (ids, as strings).

    ``names`` are those of the three columns; columns of ``docs`` that are so named make place.

    Null and empty texts have no words.  A null item id is listed as an empty string, and items that
    share an id are one.  Rows that repeat a document each get the answer.  No documents give an empty
    result; no benchmark hits nothing.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField(names[0], T.LongType()),
            T.StructField(names[1], T.ArrayType(T.IntegerType())),
            T.StructField(names[2], T.ArrayType(T.StringType())),
        ]
    )
    out = None
    for block in benchmark_blocks(benchmark, block_bytes):
        items = [(i or "", t.encode()) for i, t in block.toLocalIterator()]
        vocabulary = frozenset(w for _, text in items for w in words_of(text))
        frequency = document_frequencies(docs, vocabulary) if vocabulary else {}
        table = share(spark, PrefixTable(items, frequency))
        before = out is not None

        def compute(table=table, before=before):
            windows = shared(table)

            def batch(part):
                counts, hits, ids = [], [], []
                for k, text in enumerate(arrow_bytes(part.column("text"))):
                    words = words_of(text)
                    hit, items = windows.search(words)
                    if before:
                        hit.update(part.column(names[1])[k].as_py())
                        items.update(part.column(names[2])[k].as_py())
                    counts.append(len(words))
                    hits.append(sorted(hit))
                    ids.append(sorted(items))
                return [counts, hits, ids]

            return batch

        if before:
            out = stage(out, "decontamination")
        out = with_columns(out if before else docs, schema, compute, tuple(schema.names))
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their own columns, whatever their names.

    Null, empty and blank texts hold none and stay; repeated rows all stay or go.  No documents give an
    empty result, an empty benchmark keeps every row.
    """
    names = tuple(free_name(docs, n) for n in ("_n_words", "_hit", "_items"))
    found = contamination(docs, benchmark, names=names)
    return found.filter(F.size(names[1]) == 0).select(*docs.columns)
