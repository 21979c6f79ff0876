"""Quality ranking and lexicon learning, spelled out in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import quality, toxicity
from tagloom.llm.logistic import fit_logistic

PLAIN = "the of and to in is that it was for on are with as his they at be this from".split()


def brute_features(text):
    """The features of ``quality`` by their names, character by character."""
    data = text.encode()
    words = data.split()
    n, m = max(1, len(data)), max(1, len(words))
    count = lambda wanted: sum(wanted(b) for b in data)
    lower, upper = count(lambda b: 97 <= b <= 122), count(lambda b: 65 <= b <= 90)
    digits, high = count(lambda b: 48 <= b <= 57), count(lambda b: b >= 128)
    usual = count(lambda b: b in b".,;:'\"-()?")
    blank, feeds = count(lambda b: b in b" \t"), count(lambda b: b == 10)
    odd = count(lambda b: b < 128) - lower - upper - digits - usual - blank - feeds
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = data.split(b"\n")
    return [
        upper / max(1, lower + upper), digits / n, high / n, usual / m, odd / n, count(lambda b: b == 124) / m,
        blank / n, len(set(words)) / m, max(Counter(words).values(), default=0) / m, again / m,
        len(set(zip(words, words[1:]))) / m, len(set(lines)) / len(lines), len(lines) / m,
        (lower + upper + high) / m, math.log1p(m), math.log1p(count(lambda b: b == 33) * 1000 / m),
        math.log1p(odd * 1000 / m), math.log1p(again * 1000 / m),
    ]


def test_features():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aB3é .,|!\n\t-xyz ") for _ in range(rng.randint(0, 80)))
        assert quality.features(text.encode()) == pytest.approx(brute_features(text))


def loss(weights, pairs, ridge):
    """Minus the log-likelihood of Bradley-Terry pairs, with the penalty."""
    total = ridge / 2 * sum(w * w for w in weights)
    for winner, loser in pairs:
        strength = sum(w * (a - b) for w, a, b in zip(weights, winner, loser))
        total += math.log1p(math.exp(-strength))
    return total


def test_pair_loss_is_least():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.4, 1, (15, 3)), rng.normal(-0.4, 1, (15, 3))
    pairs = [(good[i % 15], bad[i * 7 % 15]) for i in range(60)]
    differences = np.array([a - b for a, b in pairs])
    weights = fit_logistic(differences, np.ones(60), ridge=1.0)
    least = loss(weights, pairs, 1.0)
    for k in range(3):
        slope = weights[k] - sum(
            d[k] / (1 + math.exp(sum(w * x for w, x in zip(weights, d)))) for d in differences
        )
        assert slope == pytest.approx(0, abs=1e-5)
        for step in (-0.01, 0.01):
            moved = weights.copy()
            moved[k] += step
            assert loss(moved, pairs, 1.0) > least


def test_threshold_is_the_quantile_of_strengths():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    good = np.arange(30) % 3 > 0
    x[good] += 1.0
    ranking = quality.fit_ranking(x, good)
    strengths = sorted((float(s) for s in ranking.expand(x) @ ranking.weights))
    place = (1 - good.mean()) * 29
    low, part = int(place), place - int(place)
    assert ranking.threshold == pytest.approx(strengths[low] + part * (strengths[low + 1] - strengths[low]))
    for row, strength in zip(x, ranking.expand(x) @ ranking.weights):
        expected = 1 / (1 + math.exp(-(strength - ranking.threshold + math.log(0.3 / 0.7))))
        assert ranking.score(row[None, :])[0] == pytest.approx(expected)


def toxic_corpus(rng):
    """Different documents; toxic words alone, in phrases that excuse them, and written with signs."""
    rows = []
    for i in range(260):
        words = [rng.choice(PLAIN) + str(rng.randint(0, 400)) for _ in range(40)]
        label = int(i % 4 == 0)
        if label:
            words[rng.randint(0, 39)] = rng.choice(["grunkle", "GRUNKLE,", "grunk1e", "zibble", "z1bble!"])
        elif i % 3 == 0:
            at = rng.randint(0, 38)
            words[at : at + 2] = ["grunkle", "park"]
        rows.append((i, " ".join(words), label))
    return rows


def test_lexicon_counts(spark):
    rows = toxic_corpus(random.Random(5))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    import zlib

    sample = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = {0: Counter(), 1: Counter()}
    for text, label in sample:
        seen[label].update(set(re.findall(r"[^\W_]+", toxicity.fold(text))))
    n_toxic, n_clean = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    expected = {}
    for word, toxic in seen[1].items():
        clean = seen[0][word]
        weight = math.log(((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1)))
        doubt = math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if toxic >= 5 and weight - doubt > 2:
            expected[word] = weight
    assert lexicon.weights == pytest.approx(expected) and "zibble" in expected
    phrases = {0: Counter(), 1: Counter()}
    for text, label in sample:
        words = re.findall(r"[^\W_]+", toxicity.fold(text))
        phrases[label].update({f"{a} {b}" for a, b in zip(words, words[1:]) if a in expected or b in expected})
    excused = {p for p, n in phrases[0].items() if n >= 5 and n * n_toxic > phrases[1][p] * n_clean}
    assert set(lexicon.exceptions) == excused


def brute_matches(weights, exceptions, text):
    folded = toxicity.fold(text)

    def places(term):
        for at in range(len(folded) - len(term) + 1):
            end = at + len(term)
            whole = not (at and folded[at - 1].isalnum()) and not (end < len(folded) and folded[end].isalnum())
            if folded.startswith(term, at) and whole:
                yield at, end

    excused = [span for e in exceptions for span in places(e)]
    return sum(
        w
        for term, w in weights.items()
        for begin, end in places(term)
        if not any(a <= begin and end <= b for a, b in excused)
    )


def test_matches_with_nested_and_overlapping_phrases():
    rng = random.Random(6)
    weights = {"trash": 3.0, "scum": 4.0, "can": 0.5, "a": 0.25, "trash can": 2.0}
    exceptions = ["trash can", "the trash", "can a", "scum of", "of scum"]
    lexicon = toxicity.Lexicon(weights, exceptions)
    parts = ["trash", "TR4SH", "scum", "sсum", "can", "c@n", "a", "of", "the", "trashy", "x", "trash-can", "$cum", "ｓcum"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", ", ", "\n", ""]) for _ in range(rng.randint(0, 12)))
        assert lexicon.matches(text)[0] == pytest.approx(brute_matches(weights, exceptions, text)), text
