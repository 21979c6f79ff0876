"""Hard negatives against brute force; the query's twin is checked with the others."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tagloom.llm import negatives


def brute(rows, anchors, positives=5, wanted=10, low=30, high=90):
    ints = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows]
    found = Counter()
    for a, label, v in [r for r in ints if r[0] in anchors]:
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, y) for i, y, w in ints)
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:positives]:
            inside = [x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -high * s]
            for rank, (t, j, _) in enumerate(inside[:wanted], 1):
                found[(a, i, rank, j, -s, -t)] += 1
    return found


def made(rng, n, width, big=1.0):
    rows = []
    for i in range(n):
        vector = [rng.choice([-0.25, 0.0, 0.1, 0.5, 1.0]) * big for _ in range(width)]
        if i % 9 == 3 and rows:
            vector = list(rows[-1][2])  # equal scores
        rows.append((i * 3 % n, rng.randint(0, 3), vector))
    return rows


@pytest.mark.parametrize("block, big, n", [(negatives.BLOCK_BYTES, 1.0, 400), (400, 1.0, 150), (1 << 20, 3e6, 60)])
def test_against_brute_force(spark, block, big, n, monkeypatch):
    monkeypatch.setattr(negatives, "STRIPE", 64)
    rng = random.Random(n)
    rows = made(rng, n, 6, big)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    usable = negatives.usable(df)
    found = negatives.mine(usable, usable.filter("vec_id % 10 = 0"), block_bytes=block)
    expected = brute(rows, set(range(0, n, 10)))
    assert Counter(tuple(r) for r in found.collect()) == expected and len(expected) > 50


def test_windows_of_one_anchor_overlap(spark):
    """Positives of many scores: a small ``k`` per slot and windows that reach over several slots."""
    rows = [(0, 1, [1.0])] + [(i, 1, [10.0 - i]) for i in range(1, 8)] + [(20 + i, 2, [i / 8]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    usable = negatives.usable(df)
    found = negatives.mine(usable, usable.filter("vec_id = 0"), positives=7, negatives=4)
    assert Counter(tuple(r) for r in found.collect()) == brute(rows, {0}, 7, 4)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [1.0, 1.0]), (1, 0, [1.0, 0.9]), (2, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]), (8, 3, [0.3, 0.3])]
    bad = [(3, None, [1.0, 1.0]), (4, 0, None), (5, 0, [1.0, nan]), (6, 0, [inf, 1.0]), (9, 0, [None, 1.0]), (None, 0, [1.0, 1.0])]
    data = [(*r, "x", 1) for r in rows + bad]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>, anchor string, slot int")
    found = Counter(tuple(r) for r in negatives.hard_negatives(df).collect())
    # 0 is divisible by 7, so its label becomes 1; the two rows of 2 are its positives.
    assert found == {(0, 2, 1, 8, 65536, 38912): 2}
    assert negatives.hard_negatives(df.filter("false")).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 0")).count() == 0


def test_slots_are_disjoint():
    upper, least, placed = negatives.limits(3, [(0, 7, 100), (0, 8, 101), (0, 9, 50), (1, 5, -4), (1, 6, 0)], 30, 90)
    assert upper.tolist()[0] == [90, 45] and upper[1][0] == 0 and least.tolist()[:2] == [15, 0]
    assert sorted(placed) == [(0, 7, 100, 0, 30), (0, 8, 101, 0, 31), (0, 9, 50, 1, 15), (1, 6, 0, 0, 0)]
