"""Quality rules: counts, likelihood and decoding against brute force, verdicts on held-out labels."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import boilerplate
from tagloom.llm.common import table
from tagloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def counts_of(found):
    return found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words


@pytest.mark.parametrize("portion", [boilerplate.PORTION, 7])
def test_counts(portion, monkeypatch):
    monkeypatch.setattr(boilerplate, "PORTION", portion)
    rng = random.Random(2)
    for _ in range(1000):
        alphabet = rng.choice(["ab #\n", "abc é日🦆|$\n \t\x0b", "x y\n", "a!B1&<> \n. "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        text = text * 2 if rng.random() < 0.3 else text
        assert counts_of(boilerplate.Text(text.encode())) == brute_counts(text), text


def random_field(rng):
    field = boilerplate.Field()
    field.weights, field.pairs = rng.normal(size=boilerplate.N_FEATURES), rng.normal(size=(2, 2))
    return field


def brute_scores(field, x):
    """The score of every labelling."""
    return {
        labels: sum(x[t] @ field.weights for t, y in enumerate(labels) if y)
        + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:]))
        for labels in itertools.product((0, 1), repeat=len(x))
    }


def test_decoding_and_likelihood():
    rng = np.random.default_rng(0)
    field = random_field(rng)
    sizes = np.array([7, 5, 3, 2, 1])
    x, y = rng.normal(size=(5, 7, boilerplate.N_FEATURES)), rng.integers(0, 2, (5, 7))
    total = 0.0
    for i, n in enumerate(sizes):
        scores = brute_scores(field, x[i, :n])
        assert tuple(field.decode(x[i, :n]).astype(int)) == max(scores, key=scores.get)
        total += scores[tuple(y[i, :n])] - np.log(sum(np.exp(v) for v in scores.values()))
    reached, by_weight, by_pair = boilerplate.log_likelihood(field, x, y, sizes)
    assert reached == pytest.approx(total / sizes.sum())
    for values, slopes in ((field.weights, by_weight), (field.pairs, by_pair)):
        for at in np.ndindex(values.shape):
            values[at] += 1e-6
            moved = boilerplate.log_likelihood(field, x, y, sizes)[0]
            values[at] -= 1e-6
            assert (moved - reached) / 1e-6 == pytest.approx(slopes[at], abs=1e-4)
    assert len(field.decode(np.zeros((0, boilerplate.N_FEATURES)))) == 0


def test_neighbours_decide_a_doubtful_line():
    """A line that alone would be boilerplate is content among content."""
    field = boilerplate.Field()
    field.weights[1], field.pairs = -1.0, np.array([[1.0, -1.0], [-1.0, 1.0]])
    line = lambda score: np.eye(boilerplate.N_FEATURES)[1] * -score
    alone, among = np.array([line(-0.5)]), np.array([line(2.0), line(-0.5), line(2.0)])
    assert field.decode(alone).tolist() == [False] and field.decode(among).tolist() == [True] * 3


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op11_quality_rules"](spark, sf).join(table(spark, sf, "labels"), "doc_id")
    held = found.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & ~F.col("base_failed"))
    rates = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert rates[1, True] > 0.98 * (rates[1, True] + rates.get((1, False), 0))
    assert rates[0, False] > 0.9 * (rates[0, False] + rates.get((0, True), 0))


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    found = QUERIES["op11_quality_rules"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        counts = brute_counts(texts[r.doc_id])
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert (counts_of(r), r.base_failed) == (counts, failed)
        assert r.kept == (not failed and 2 * r.content_words >= r.n_words)


def test_edges(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(25)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.filter("false"), labels.filter("quality = 1")):
        found = boilerplate.rules_report(docs, known)
        got = Counter((r.doc_id, *counts_of(r)) for r in found.collect())
        assert got == Counter((i, *brute_counts(t)) for i, t in rows)
        assert found.filter("kept IS NULL OR (kept AND base_failed)").count() == 0
    assert found.filter("NOT kept AND NOT base_failed").count() == 0  # without a field all is content
    assert boilerplate.rules_report(no_docs, labels).count() == 0
    kept = boilerplate.keep_content(docs, docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
