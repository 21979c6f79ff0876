"""Groups of near copies in a labelled sample, by keys of MinHashes of five-word shingles.

A set of shingles gets ``BANDS`` keys of ``WIDTH`` MinHashes; two sets share none with probability
``(1 - j ** WIDTH) ** BANDS`` at Jaccard similarity ``j``: 0.0004 at 0.8.  Sets that share a key are one
group.  Every set is linked to the smallest set of each of its keys, so there are at most ``BANDS`` links
for a set, however large a group is.  Links are not verified: a group only says which labels count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_bytes, row_key, with_columns
from tagloom.sources.staging import stage

SIZE = 5
BANDS, WIDTH = 20, 5
SEED = 42


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; a shorter text is one shingle, a blank has none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - size + 1
    found = np.full(n, size, np.uint64)
    for i in range(size):
        found = mix(found + hashes[i : i + n])
    return np.unique(found)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The signed keys of the bands of a set; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    odd, least = _permutations(), np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        part = found[at : at + 1024, None] * odd
        np.minimum(least, part.min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        keys = mix(keys + column)
    return keys.view(np.int64)


def _permutations() -> np.ndarray:
    return mix(np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, fp, bands`` of every row, staged; ``fp`` is the hash of the whole shingle set."""

    def compute():
        def batch(part: pa.RecordBatch) -> list[list]:
            import xxhash

            prints, bands = [], []
            for text in arrow_bytes(part.column("text")):
                found = shingles(text)
                digest = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                prints.append(digest - (1 << 64) if digest >> 63 else digest)
                bands.append(band_keys(found).tolist())
            return [prints, bands]

        return batch

    added = T.StructType(
        [T.StructField("_fp", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))]
    )
    found = with_columns(docs.select("doc_id", "text"), added, compute)
    return stage(
        found.select(
            "doc_id", row_key().alias("row_key"), F.col("_fp").alias("fp"), F.col("_bands").alias("bands")
        ),
        "sketches",
    )


def copy_links(sketched: DataFrame) -> DataFrame:
    """``(src, dst)`` of set hashes: each set with the smallest one of each key, no set with itself."""
    members = sketched.select("fp", F.explode("bands").alias("key")).distinct()
    centres = members.groupBy("key").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("n"))
    stars = members.join(centres.filter("n > 1"), "key").filter("fp <> src")
    return stars.select("src", F.col("fp").alias("dst")).distinct()
