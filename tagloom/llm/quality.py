"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text.  Preference pairs put a document
labelled good above one labelled bad; logistic loss on the difference of their features gives the weights,
so the intercept falls out.  The threshold is the quantile of the strengths of the sample at which the
share above equals the share of good labels; the score is the logistic of the strength, moved so that the
threshold lies at ``ACCEPT``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_bytes, crc_of_id, share, shared, with_columns
from tagloom.llm.logistic import fit_logistic, sigmoid
from tagloom.llm.samples import SAMPLE_ROWS, labelled_sample

FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3
PAIRS_PER_ROW = 4

_LOWER, _UPPER, _DIGIT = slice(97, 123), slice(65, 91), slice(48, 58)
_USUAL = [ord(c) for c in ".,;:'\"-()?"]


def features(text: bytes) -> list[float]:
    """Shares of character classes, repetition of words and lines, and lengths, over the whole text."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lower, upper = int(counts[_LOWER].sum()), int(counts[_UPPER].sum())
    digits, high = int(counts[_DIGIT].sum()), int(counts[128:].sum())
    usual = int(counts[_USUAL].sum())
    blank, feeds = int(counts[32] + counts[9]), int(counts[10])
    odd = int(counts[:128].sum()) - lower - upper - digits - usual - blank - feeds
    words = text.split()
    m = max(1, len(words))
    tally = Counter(words)
    lines = text.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        upper / max(1, lower + upper),
        digits / n,
        high / n,
        usual / m,
        odd / n,
        int(counts[124]) / m,
        blank / n,
        len(tally) / m,
        max(tally.values(), default=0) / m,
        again / m,
        pairs / m,
        len(set(lines)) / len(lines),
        len(lines) / m,
        (lower + upper + high) / m,
        np.log1p(m),
        np.log1p(int(counts[33]) * 1000 / m),
        np.log1p(odd * 1000 / m),
        np.log1p(again * 1000 / m),
    ]


class Ranking:
    """Scaling of the features, weights of the strengths, and the threshold."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray):
        self.middle, self.spread = middle, spread
        self.weights = np.zeros(2 * len(middle))
        self.threshold = 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -5, 5)
        return np.hstack([z, z * z])

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = self.expand(x) @ self.weights
        return sigmoid(strength - self.threshold + np.log(ACCEPT / (1 - ACCEPT)))


def fit_ranking(x: np.ndarray, good: np.ndarray, seed: int = 0) -> Ranking:
    """Bradley-Terry weights from pairs of a good and a bad row, ``PAIRS_PER_ROW`` for each row."""
    spread = x.std(axis=0)
    ranking = Ranking(x.mean(axis=0), np.where(spread > 1e-9, spread, 1.0))
    above, below = np.flatnonzero(good), np.flatnonzero(~good)
    if len(above) and len(below):
        draw = np.random.default_rng(seed)
        n = PAIRS_PER_ROW * len(x)
        z = ranking.expand(x)
        # Every row of the rarer label takes part equally often.
        winners = np.resize(draw.permutation(above), n)
        losers = np.resize(draw.permutation(below), n)
        ranking.weights = fit_logistic(z[winners] - z[losers], np.ones(n), ridge=1.0)
        strength = z @ ranking.weights
        ranking.threshold = float(np.quantile(strength, 1 - good.mean()))
    return ranking


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ranking:
    """A ranking from a bounded sample of labelled rows; only their features reach the driver."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)

    def compute():
        return lambda part: [[features(t) for t in arrow_bytes(part.column("text"))]]

    added = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    known = with_columns(sample, added, compute).select("x", "label").toPandas()
    if not len(known):
        return fit_ranking(np.zeros((1, len(features(b"")))), np.array([True]))
    # Rows of a table come in no fixed order: sort for the same pairs in every run.
    order = np.lexsort(np.vstack(known["x"].to_numpy()).T)
    x = np.vstack(known["x"].to_numpy())[order]
    return fit_ranking(x, (known["label"].to_numpy() > 0)[order])


def scored(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``docs`` with ``_score`` from 0 to 1 for every whole text; a null text counts as empty."""
    box = share(docs.sparkSession, ranking)

    def compute():
        model = shared(box)

        def batch(part: pa.RecordBatch) -> list[list]:
            rows = [features(t) for t in arrow_bytes(part.column("text"))]
            return [model.score(np.array(rows)).tolist() if rows else []]

        return batch

    added = T.StructType([T.StructField("_score", T.DoubleType())])
    return with_columns(docs, added, compute, ("_score",))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Without labels of both kinds every score is ``ACCEPT``.  Repeated rows get equal scores; a null id
    counts as an empty one for ``held_out``.  An empty table gives an empty result.
    """
    found = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        "doc_id",
        (F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= ACCEPT).cast("int").alias("predicted"),
    )
