"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases and maps look-alike letters of other scripts and digits that stand for letters.
The lexicon is learned from labelled documents: folded words that are far more frequent in toxic ones,
weighted by their log odds.  Near copies of a label count as one document, so a word that only they share
is not learned, and a word in one fixed phrase of different documents is.  Two-word phrases around a lexicon
word that mark clean documents are exceptions: a match inside one does not count.  The weights found in a document, as a sum and normalised by
its length, give the score through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm import near, simhash
from tagloom.llm.common import crc_of_id, free_name, row_key, share, shared, with_columns
from tagloom.llm.logistic import fit_logistic, sigmoid
from tagloom.llm.samples import SAMPLE_ROWS, labelled_sample
from tagloom.sources.staging import stage

FOLDS, HELD_OUT = 4, 2
REJECT = 0.3
LEAST_DOCS = 5
LEAST_WEIGHT = 2.0

# Look-alikes of Latin letters in the Cyrillic and Greek scripts, digits for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ո": "n", "օ": "o", "ս": "u",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
}
FOLDING = str.maketrans(
    LOOK_ALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}  # full-width letters
)
INSIDE = re.compile(r"(?<=\w)[@$]+(?=\w)|\b[@$](?=\w)")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-cased text with look-alikes, digits and signs inside words as the letters they stand for."""
    text = text.lower().translate(FOLDING)
    if "@" in text or "$" in text:
        text = INSIDE.sub(lambda m: m.group().replace("@", "a").replace("$", "s"), text)
    return text


class Lexicon:
    """Weights of words, phrases that excuse them, and the coefficients of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights = weights
        self.exceptions = exceptions
        self.curve = np.zeros(3)
        self.automaton = None

    def make_automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            automaton.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    def matches(self, text: str) -> tuple[float, int]:
        """Sum of the weights found in the whole text outside exception phrases, and its length in words."""
        length = text.count(" ") + text.count("\n") + 1
        if not self.weights:
            return 0.0, length
        if self.automaton is None:
            self.automaton = self.make_automaton()
        folded = fold(text)
        found, excused = [], []
        for last, (size, weight) in self.automaton.iter(folded):
            first = last - size + 1
            if first and folded[first - 1].isalnum():
                continue
            if last + 1 < len(folded) and folded[last + 1].isalnum():
                continue
            (excused if weight is None else found).append((first, last, weight))
        # The furthest end among the phrases that begin at or before each one, so that a long text with
        # many matches takes one search per match.
        excused.sort()
        begins = [c for c, _, _ in excused]
        ends = list(accumulate((d for _, d, _ in excused), max))
        total = 0.0
        for first, last, weight in found:
            at = bisect_right(begins, first)
            if not at or ends[at - 1] < last:
                total += weight
        return total, length

    @staticmethod
    def features(total: float, length: int) -> list[float]:
        return [math.log1p(total), math.log1p(1000 * total / length), 1.0]

    def score(self, text: str) -> float:
        return float(sigmoid(np.dot(self.curve, self.features(*self.matches(text)))))


def _counted(df: DataFrame, keys) -> DataFrame:
    """``(term, toxic, clean)``: in how many groups of ``copies`` of either label each key occurs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                terms = list(set(keys(fold(part.column("text")[0].as_py()))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array([0] * len(terms), pa.int64())) for c in ("copies", "toxic")]
                    + [pa.array(terms, pa.string())],
                    ["copies", "toxic", "term"],
                )

    terms = df.select("text", "copies", "toxic").mapInArrow(
        found, "copies long, toxic boolean, term string"
    )
    return terms.distinct().groupBy("term").agg(
        F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")
    )


def near_copy_groups(sample: DataFrame) -> DataFrame:
    """``(text, copies, toxic)`` of the sampled texts; ``copies`` is equal for near copies."""
    texts = sample.select(row_key().alias("row_key"), "text", (F.col("label") > 0).alias("toxic"))
    sketched = near.sketches(texts.select(F.col("row_key").alias("doc_id"), "text"))
    found = simhash.linked_components(stage(near.copy_links(sketched), "copy_links"))
    groups = texts.join(sketched.select("row_key", "fp"), "row_key").join(found, "fp", "left")
    return stage(groups.select("text", F.coalesce("component", "fp").alias("copies"), "toxic"), "groups")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """The lexicon of a bounded sample of labelled rows.

    Every word and phrase that passes the statistical limits is kept: ``LEAST_DOCS`` groups of a label, and
    for words log odds that exceed ``LEAST_WEIGHT`` by their standard error.  So their number is bounded
    by the sample, and only they reach the driver.
    """
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows)
    groups = near_copy_groups(sample)
    sizes = {r["toxic"]: r["count"] for r in groups.groupBy("toxic").agg(F.count_distinct("copies").alias("count")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    toxic_share, clean_share = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (
        n_clean + 1
    )
    weight = F.log(toxic_share / clean_share)
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    terms = (
        _counted(groups, WORD.findall)
        .filter(F.col("toxic") >= LEAST_DOCS)
        .withColumn("weight", weight)
        .filter(F.col("weight") - doubt > LEAST_WEIGHT)
    )
    weights = {r["term"]: r["weight"] for r in terms.collect()}

    def phrases(text: str) -> Iterator[str]:
        words = WORD.findall(text)
        return (f"{a} {b}" for a, b in zip(words, words[1:]) if a in weights or b in weights)

    excused = _counted(groups, phrases).filter(
        (F.col("clean") >= LEAST_DOCS) & (F.col("clean") * n_toxic > F.col("toxic") * n_clean)
    )
    lexicon = Lexicon(weights, [r["term"] for r in excused.collect()] if weights else [])
    box = share(docs.sparkSession, lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared(box)
        for batch in batches:
            rows_ = [Lexicon.features(*words.matches(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows_], pa.float64()) for i in range(2)] + [batch.column(1)],
                ["total", "density", "label"],
            )

    # Two numbers per sampled row.
    known = sample.select("text", "label").mapInArrow(
        measure, "total double, density double, label int"
    ).toPandas()
    if len(known) and known["label"].nunique() > 1:
        x = np.column_stack([known["total"], known["density"], np.ones(len(known))])
        lexicon.curve = fit_logistic(x, (known["label"] > 0).to_numpy(float))
    else:
        lexicon.curve = np.array([0.0, 0.0, -5.0])
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """``docs`` with the score from 0 to 1 of every whole text in ``name``, which no column may have.

    Null and empty texts match nothing.
    """
    box = share(docs.sparkSession, lexicon)

    def compute():
        words = shared(box)
        return lambda part: [[words.score(t.as_py() or "") for t in part.column("text")]]

    return with_columns(docs, T.StructType([T.StructField(name, T.DoubleType())]), compute)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Without usable labels nothing is toxic.  Repeated rows get equal scores; a null id counts as an empty
    one for ``held_out``.  An empty table gives an empty result.
    """
    found = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        "doc_id",
        (F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, learn_from: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below the rejecting score, with their own columns, whatever their names.

    Null, empty and blank texts match nothing and stay, as do all rows without usable labels.  Texts of any
    length are searched as a whole, and equal texts share their verdict.  An empty table gives an empty
    result.
    """
    name = free_name(docs, "_score")
    found = scored(docs, learn(learn_from, labels), name)
    return found.filter(F.col(name) < REJECT).select(*docs.columns)
