"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Every line with a word has features of its own bytes and words.  The field scores a labelling by a weight
for each feature of the lines labelled content and a weight for each pair of neighbouring labels; Viterbi
decoding finds the best labelling of a whole text.  The share of words in content lines decides whether the
text is kept, beside rules on length and repetition.

The weights maximise the conditional likelihood, computed forward and backward over the lines, on a bounded
sample of documents with a quality label: lines of good documents are content, unless they repeat an
earlier line of their text, and lines of bad ones are boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_bytes, share, shared, with_columns
from tagloom.llm.samples import labelled_sample

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that a fit reads, in expectation, and the lines of a sequence that it learns from.
SAMPLE_ROWS, SEQUENCE = 4_000, 32
STEPS, RATE, RIDGE = 400, 0.2, 1e-4
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT = 20, 8, 30
CONTENT_SHARE = 0.5
#: Bytes whose classes are counted at a time.
PORTION = 1 << 20

SYMBOLS = b"#*$%&|<>"
# Classes of bytes: other, symbol, upper, lower, digit, beyond ASCII, exclamation mark, white space; the
# last also counts bytes inside a character.
OTHER, SYMBOL, UPPER, LOWER, DIGIT, HIGH, BANG, BLANK, INNER = range(9)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = UPPER, LOWER, DIGIT
_CLASS[128:192], _CLASS[192:] = INNER, HIGH
_CLASS[list(SYMBOLS)] = SYMBOL
_CLASS[ord("!")] = BANG
_CLASS[[32, 9, 10, 11, 12, 13]] = BLANK


def class_counts(lines: list[bytes]) -> np.ndarray:
    """How many bytes of each class each line has."""
    out = np.zeros((len(lines), 9), np.int64)
    first, size = 0, 0
    for i, line in enumerate(lines):
        if len(line) > PORTION:
            for at in range(0, len(line), PORTION):
                part = np.frombuffer(line, np.uint8, min(PORTION, len(line) - at), at)
                out[i] += np.bincount(_CLASS[part], minlength=9)
    lengths = [len(x) if len(x) <= PORTION else 0 for x in lines]
    for i in range(len(lines) + 1):
        if i == len(lines) or size + lengths[i] > PORTION:
            part = np.frombuffer(b"".join(x for x, n in zip(lines[first:i], lengths[first:i]) if n), np.uint8)
            of = np.repeat(np.arange(i - first), lengths[first:i])
            found = np.bincount(of * 9 + _CLASS[part], minlength=9 * (i - first))
            out[first:i] += found.reshape(-1, 9)
            first, size = i, 0
        if i < len(lines):
            size += lengths[i]
    return out


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included; ``window`` a power of 2."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    distinct = set(words)
    if len(distinct) == len(words):
        return 0
    index = dict(zip(distinct, range(len(distinct))))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    size = 1
    while size < window:
        if len(np.unique(ids)) == len(ids):
            return 0
        # Numbers of twice as long windows, from pairs of numbers.
        _, ids = np.unique(ids[:-size] * (int(ids.max()) + 1) + ids[size:], return_inverse=True)
        size *= 2
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


class Text:
    """Lines with a word, their features, and the counts of the rules."""

    def __init__(self, text: bytes):
        lines = text.split(b"\n")
        by_line = [x.split() for x in lines]
        self.lines = [x for x, w in zip(lines, by_line) if w]
        by_line = [w for w in by_line if w]
        words = list(chain.from_iterable(by_line))
        counts = class_counts(self.lines)
        self.counts = np.fromiter(map(len, by_line), np.int64, len(by_line))
        self.n_words = len(words)
        self.word_chars = int(counts.sum() - counts[:, [BLANK, INNER]].sum())
        self.n_symbols = int(counts[:, SYMBOL].sum())
        seen: set[bytes] = set()
        self.again = np.array([x in seen or seen.add(x) is not None for x in self.lines], bool)
        self.n_dup_lines = int(self.again.sum())
        self.n_repeat_words = repeat_words(words)
        self.features = self._features(counts, by_line)

    def _features(self, counts: np.ndarray, by_line: list[list[bytes]]) -> np.ndarray:
        if not by_line:
            return np.zeros((0, N_FEATURES))
        n = np.maximum(1, self.counts)
        chars = np.maximum(1, counts.sum(axis=1) - counts[:, BLANK] - counts[:, INNER])
        letters = np.maximum(1, counts[:, UPPER] + counts[:, LOWER])
        distinct = np.fromiter((len(set(w)) for w in by_line), np.int64, len(by_line))
        ends = np.fromiter((x.rstrip()[-1:] in (b".", b"!", b"?") for x in self.lines), bool, len(by_line))
        return np.column_stack(
            [
                np.ones(len(n)),
                np.minimum(1, counts[:, SYMBOL] / n),
                4 * counts[:, SYMBOL] / chars,
                counts[:, UPPER] / letters,
                counts[:, DIGIT] / chars,
                np.minimum(1, counts[:, BANG] / n),
                counts[:, OTHER] / chars,
                distinct / n,
                np.minimum(1, np.log1p(n) / 6),
                np.minimum(1, chars / n / 20),
                ends,
                self.again,
            ]
        )


N_FEATURES = 12


class Field:
    """Weights of the features for content, and of pairs of neighbouring labels (0 boilerplate, 1 content)."""

    def __init__(self):
        self.weights = np.zeros(N_FEATURES)
        self.pairs = np.zeros((2, 2))

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best labelling; of equally good ones content wins, decided from the last line on."""
        scores = (features @ self.weights).tolist()
        (stay0, to1), (to0, stay1) = self.pairs.tolist()
        zero = one = 0.0
        back: list[tuple[bool, bool]] = []
        for i, score in enumerate(scores):
            if i:
                a, b, c, d = zero + stay0, one + to0, zero + to1, one + stay1
                back.append((b >= a, d >= c))
                zero, one = max(a, b), max(c, d)
            one += score
        labels = np.zeros(len(scores), bool)
        label = one >= zero
        for i in range(len(scores) - 1, -1, -1):
            labels[i] = label
            if i:
                label = back[i - 1][label]
        return labels


def log_likelihood(field: Field, x: np.ndarray, y: np.ndarray, sizes: np.ndarray):
    """Mean conditional log-likelihood of a line and its gradients, for padded sequences.

    ``x`` is ``(sequences, lines, features)``, ``y`` the labels, ``sizes`` the lines of each sequence, which
    fall, so that a step along the lines has a prefix of the sequences.
    """
    n, length = y.shape
    emit = np.ascontiguousarray((x @ field.weights).T)
    inside = np.arange(length)[:, None] < sizes
    some = inside.sum(axis=1).tolist()
    (p00, p01), (p10, p11) = field.pairs.tolist()
    forward, backward = np.zeros((2, length, n)), np.zeros((2, length, n))
    forward[1, 0] = emit[0]
    for t in range(1, length):
        zero, one = forward[:, t - 1, : some[t]]
        forward[0, t, : some[t]] = np.logaddexp(zero + p00, one + p10)
        forward[1, t, : some[t]] = np.logaddexp(zero + p01, one + p11) + emit[t, : some[t]]
    for t in range(length - 1, 0, -1):
        zero, one = backward[0, t, : some[t]], backward[1, t, : some[t]] + emit[t, : some[t]]
        backward[0, t - 1, : some[t]] = np.logaddexp(p00 + zero, p01 + one)
        backward[1, t - 1, : some[t]] = np.logaddexp(p10 + zero, p11 + one)
    whole = np.logaddexp(*forward[:, sizes - 1, np.arange(n)])
    marginal = np.exp(forward[1] + backward[1] - whole) * inside
    truth = y.T * inside
    both = inside[1:]
    rest = backward[:, 1:] - whole
    rest[1] += emit[1:]
    expected, seen = np.zeros((2, 2)), np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            expected[a, b] = (np.exp(forward[a, :-1] + field.pairs[a, b] + rest[b]) * both).sum()
            seen[a, b] = ((y.T[:-1] == a) & (y.T[1:] == b) & both).sum()
    lines = max(1, int(sizes.sum()))
    reached = (emit * truth).sum() + (seen * field.pairs).sum() - whole.sum()
    by_weight = np.tensordot((truth - marginal).T, x, 2)
    return reached / lines, by_weight / lines, (seen - expected) / lines


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> Field:
    """Weights for sequences ``(features, labels)``, by steps along the gradient with adaptive rates."""
    field = Field()
    cut = [(x[i : i + SEQUENCE], y[i : i + SEQUENCE]) for x, y in sequences for i in range(0, len(y), SEQUENCE)]
    if not cut or len({int(v) for _, y in cut for v in np.unique(y)}) < 2:
        return field
    cut.sort(key=lambda sequence: -len(sequence[1]))
    length = len(cut[0][1])
    x, y = np.zeros((len(cut), length, N_FEATURES)), np.zeros((len(cut), length), np.int64)
    sizes = np.array([len(v) for _, v in cut])
    for i, (features, labels) in enumerate(cut):
        x[i, : len(labels)], y[i, : len(labels)] = features, labels
    means = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    squares = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        _, by_weight, by_pair = log_likelihood(field, x, y, sizes)
        for k, (value, slope) in enumerate(((field.weights, by_weight), (field.pairs, by_pair))):
            slope = slope - RIDGE * value
            means[k] = 0.9 * means[k] + 0.1 * slope
            squares[k] = 0.99 * squares[k] + 0.01 * slope**2
            value += RATE * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-9)
    return field


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Field | None:
    """A field from a bounded sample of labelled rows, ``None`` without rows of both labels.

    Rows whose crc32 of the id modulo 5 is 0 are held out.  Only features of the sample's lines reach the
    driver.
    """
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(arrow_bytes(batch.column(0)), batch.column(1).to_pylist()):
                found = Text(text)
                truth = ~found.again & (label > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([found.features.astype("<f4").tobytes()]),
                        pa.array([truth.astype(np.uint8).tobytes()]),
                    ],
                    ["x", "y"],
                )

    known = sample.select("text", "label").mapInArrow(lines, "x binary, y binary").toArrow()
    # Rows of a table come in no fixed order: sort for the same sums in every run.
    pairs = sorted(zip(known.column("x").to_pylist(), known.column("y").to_pylist()))
    sequences = [
        (np.frombuffer(x, "<f4").reshape(-1, N_FEATURES).astype(float), np.frombuffer(y, np.uint8).astype(np.int64))
        for x, y in pairs
        if y
    ]
    if len({int(v) for _, y in sequences for v in np.unique(y)}) < 2:
        return None
    return fit_field(sequences)


VERDICT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    + [T.StructField("content_words", T.LongType()), T.StructField("labels", T.StringType())]
)


def verdicts(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with the columns of ``VERDICT`` for every whole text; columns so named make place.

    ``labels`` has a ``c`` or ``b`` for every line with a word.  A null text has no words; an empty or blank
    one has neither, fails the rules and is not kept.  Without a field every line is content.  Rows are
    independent, so repeated rows get equal verdicts, and an empty table gives an empty result.
    """
    box = share(docs.sparkSession, field)

    def compute():
        model = shared(box)

        def verdict(text: bytes) -> tuple:
            found = Text(text)
            failed = found.n_words < MIN_WORDS or 100 * found.n_repeat_words > MAX_REPEAT * found.n_words
            content = np.ones(len(found.lines), bool) if model is None else model.decode(found.features)
            inside = int(found.counts[content].sum())
            return (
                found.n_words,
                found.word_chars,
                found.n_symbols,
                found.n_dup_lines,
                found.n_repeat_words,
                failed,
                not failed and inside >= CONTENT_SHARE * found.n_words,
                inside,
                np.where(content, b"c", b"b").tobytes().decode(),
            )

        def batch(part: pa.RecordBatch) -> list[list]:
            rows = [verdict(t) for t in arrow_bytes(part.column("text"))]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in VERDICT.fields]

        return batch

    return with_columns(docs, VERDICT, compute, tuple(VERDICT.names))


def rules_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts of the rules, ``base_failed`` and ``kept`` of every row."""
    found = verdicts(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        "doc_id", *[n for n in VERDICT.names if n != "labels"]
    )


def keep_content(docs: DataFrame, learn_from: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names."""
    own = docs.select("text", F.struct(*docs.columns).alias("_row"))
    found = verdicts(own, learn(learn_from, labels)).filter("kept")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
