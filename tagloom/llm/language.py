"""Language identification by prediction by partial matching.

For every language the training texts give counts of each byte after each context of up to ``ORDER`` bytes.
A byte that was seen after a context costs its share of the context's count plus its number of distinct
bytes; otherwise it costs an escape, of which that number is the share, and is predicted from the context
that is one byte shorter, down to the uniform distribution over bytes.  Statistics are frozen after training,
so the cost of a byte depends on its context alone, and the exact code length of a text under a language is
the sum of its bytes' costs.  The language with the shortest code is predicted; the score is its posterior
probability under equal priors.

All contexts of the sample are kept.  The cost of a byte after its two last bytes is a row of a table over
languages, with the escapes from unseen strings below it.  What the third byte before changes is stored
sparsely: each context of three bytes lists the languages that saw it, with their escape, and each of its
continuations their gain.  So coding a text is a few searches for its strings and sums over what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_bytes, crc_of_id, share, shared, with_columns
from tagloom.llm.samples import hash_share
from tagloom.sources.staging import stage

FOLDS, HELD_OUT = 3, 1
ORDER = 3
#: How many training documents of a language are read, in expectation.
SAMPLE_ROWS = 2_000
UNKNOWN = "und"
PIECE = 1 << 20


def pack(text: bytes, order: int) -> np.ndarray:
    """The ``order + 1`` bytes that end at each position, as one integer; before the text stand zeros."""
    b = np.frombuffer(bytes(order) + text, np.uint8).astype(np.int64)
    packed = np.zeros(len(text), np.int64)
    for i in range(order + 1):
        packed = packed << 8 | b[i : i + len(text)]
    return packed


def gram_counts(sample: DataFrame) -> DataFrame:
    """``(lang, gram, n)``: how often each ``ORDER + 1`` bytes occur in the sample of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), arrow_bytes(batch.column("text"))):
                by_lang.setdefault(lang, []).append(pack(text, ORDER))
            for lang, parts in by_lang.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Rows of costs, or lists of them, under sorted strings."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the strings, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted


class Lists(Table):
    """For each key the languages that have a value, and the values."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, value: np.ndarray):
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        super().__init__(keys)
        self.first = np.append(first, len(key))
        self.lang, self.value = lang[order], value[order].astype(np.float32)

    def sums(self, at: np.ndarray, langs: int) -> np.ndarray:
        """The values at the places, added up by language."""
        size = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.lang[entry], self.value[entry], langs)


class Model:
    """Costs in bits by language; see the module's text."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        # Below the shortest context all bytes cost the same.
        costs = np.full((256, len(langs)), 8.0)
        self.below: list[tuple[Table, np.ndarray, Table, np.ndarray]] = []
        for order in range(ORDER):
            mask = (1 << 8 * (order + 1)) - 1
            strings = Table(np.unique(gram & mask))
            contexts = Table(np.unique(strings.keys >> 8))
            escapes = np.zeros((len(contexts.keys), len(langs)))
            own = self._missed(strings.keys, costs, order) if order else costs[strings.keys & 255].copy()
            for k in range(len(langs)):
                short, context, cost, escape = self._counted(gram[lang == k] & mask, n[lang == k])
                at = contexts.find(context)[0]
                escapes[at, k] = escape
                own[:, k] += escapes[contexts.find(strings.keys >> 8)[0], k]
                own[strings.find(short)[0], k] = cost
            self.below.append((strings, own.astype(np.float32), contexts, escapes.astype(np.float32)))
            costs = own
        keys, who, gains = [], [], []
        context_keys, context_who, context_escapes = [], [], []
        every = np.unique(gram)
        for k in range(len(langs)):
            short, context, cost, escape = self._counted(gram[lang == k], n[lang == k])
            context_keys.append(context)
            context_escapes.append(escape)
            context_who.append(np.full(len(context), k))
            # Of every string after a context that the language saw: the escape, or the gain of having seen it.
            seen = Table(context)
            at, known = seen.find(every >> 8)
            strings, value = every[known], escape[at[known]]
            place = np.searchsorted(strings, short)
            value[place] = cost - self.shorter(short & ((1 << 8 * ORDER) - 1))[:, k]
            keys.append(strings)
            gains.append(value)
            who.append(np.full(len(strings), k))
        self.strings = Lists(*(np.concatenate(x) for x in (keys, who, gains)))
        self.contexts = Lists(*(np.concatenate(x) for x in (context_keys, context_who, context_escapes)))

    @staticmethod
    def _counted(gram: np.ndarray, n: np.ndarray):
        """``(string, context, cost, escape)`` of one language: distinct strings and their contexts."""
        short, at = np.unique(gram, return_inverse=True)
        count = np.bincount(at, n)
        context, where = np.unique(short >> 8, return_inverse=True)
        total, distinct = np.bincount(where, count), np.bincount(where)
        return short, context, np.log2((total + distinct)[where] / count), np.log2((total + distinct) / distinct)

    def _missed(self, strings: np.ndarray, costs: np.ndarray, order: int) -> np.ndarray:
        """Costs of strings by what is one byte shorter; every one of these was seen."""
        return costs[self.below[order - 1][0].find(strings & ((1 << 8 * order) - 1))[0]].copy()

    def shorter(self, strings: np.ndarray, order: int = ORDER - 1) -> np.ndarray:
        """Costs by language of the last byte of strings of ``order + 1`` bytes, seen or not."""
        known, rows, contexts, escapes = self.below[order]
        at, there = known.find(strings)
        if not len(known.keys):
            return np.full((len(strings), len(self.langs)), 8.0)
        out = rows[at].astype(float)
        missed = np.flatnonzero(~there)
        if len(missed):
            left = strings[missed]
            place, seen = contexts.find(left >> 8)
            escape = np.where(seen[:, None], escapes[place], 0.0)
            out[missed] = escape + (self.shorter(left & ((1 << 8 * order) - 1), order - 1) if order else 8.0)
        return out

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of the whole text under each language."""
        langs = len(self.langs)
        bits = np.zeros(langs)
        before = bytes(ORDER)
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            grams = pack(before + piece, ORDER)[ORDER:]
            bits += self.shorter(grams & ((1 << 8 * ORDER) - 1)).sum(axis=0)
            place, there = self.strings.find(grams)
            bits += self.strings.sums(place[there], langs)
            place, there = self.contexts.find(grams[~there] >> 8)
            bits += self.contexts.sums(place[there], langs)
            before = (before + piece)[-ORDER:]
        return bits

    def predict(self, text: bytes) -> tuple[str, float]:
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the languages of the training fold, ``None`` if there are none.

    Only the grams of the bounded sample reach the driver.
    """
    train = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & (F.pmod(crc_of_id(), F.lit(FOLDS)) != HELD_OUT)
    )
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return None
    rates = [
        (F.col("lang") == lang) & hash_share(min(1.0, rows / n)) for lang, n in sorted(sizes.items())
    ]
    chosen = rates[0]
    for rate in rates[1:]:
        chosen = chosen | rate
    counts = gram_counts(stage(train.filter(chosen), "sample")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return None
    place = {x: k for k, x in enumerate(langs)}
    lang = np.array([place[x] for x in counts.column("lang").to_pylist()])
    return Model(langs, lang, counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` for every whole text.

    A null text and one without a letter are ``und`` with score 0, as is every text without a model.
    """
    box = share(docs.sparkSession, model)

    def compute():
        coder = shared(box)

        def batch(part: pa.RecordBatch) -> list[list]:
            langs, scores = [], []
            letters = part.column("_letter").to_pylist()
            for text, letter in zip(arrow_bytes(part.column("text")), letters):
                lang, score = coder.predict(text) if letter and coder else (UNKNOWN, 0.0)
                langs.append(lang)
                scores.append(score)
            return [langs, scores]

        return batch

    added = T.StructType(
        [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())]
    )
    ready = docs.withColumn("_letter", F.col("text").rlike(r"\p{L}"))
    return with_columns(ready, added, compute, tuple(added.names)).drop("_letter")


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Repeated rows get equal predictions; of equally long codes the alphabetically first language wins; a
    null id counts as an empty one for ``held_out``.  An empty table gives an empty result.
    """
    found = predicted(docs.select("doc_id", "text"), learn(docs))
    return found.select(
        "doc_id",
        (F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
    )
