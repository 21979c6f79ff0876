from __future__ import annotations

import numpy as np
import pytest

from tagloom.operators import similarity as S


def random_tags(n=23, width=9, seed=0):
    """Sparse non-negative vectors; some are zero, some are equal."""
    rng = np.random.default_rng(seed)
    dense = rng.random((n, width)) * (rng.random((n, width)) < 0.4)
    dense[3] = 0
    dense[n - 1] = 0
    dense[5] = dense[8] * 2
    ids = np.sort(rng.choice(10_000, n, replace=False)).astype(int)
    return ids, dense


def frames(spark, ids, dense):
    rows = [
        (int(t), int(j), float(dense[i, j]))
        for i, t in enumerate(ids)
        for j in np.nonzero(dense[i])[0]
    ]
    rows.append((int(ids[-1]), 0, 0.0))  # a zero vector may also be stored as a zero entry
    vectors = spark.createDataFrame(rows, "tag_id bigint, term_idx int, weight double")
    tags = spark.createDataFrame(
        [(int(t), f"t{t}") for t in ids], "tag_id bigint, tag_name string"
    )
    return vectors.repartition(3), tags


def cosine_matrix(dense):
    length = np.linalg.norm(dense, axis=1)
    safe = np.where(length == 0, 1, length)
    return np.round((dense @ dense.T) / np.outer(safe, safe), S.DIGITS)


def ranking(ids, row, k):
    order = sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k]
    return [(int(ids[j]), float(row[j])) for j in order]


@pytest.mark.parametrize("k", [None, 4, 100])
def test_one_against_all(spark, k):
    ids, dense = random_tags()
    vectors, tags = frames(spark, ids, dense)
    got = S.similar_tags(vectors, tags, f"t{ids[5]}", k=k).collect()
    want = ranking(ids, cosine_matrix(dense)[5], k)
    assert [(r["tag_id"], r["similarity"]) for r in got] == want
    assert got[0]["tag_id"] == ids[5] and got[0]["similarity"] == 1.0
    if k is not None:
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_zero_vector_self_and_unknown_name(spark):
    ids, dense = random_tags()
    vectors, tags = frames(spark, ids, dense)
    zero = S.similar_tags(vectors, tags, f"t{ids[3]}", k=None).collect()
    assert {r["similarity"] for r in zero} == {0.0} and len(zero) == len(ids)
    without = S.similar_tags(vectors, tags, f"t{ids[5]}", k=1, include_self=False).head()
    assert (without["tag_id"], without["similarity"]) == (ids[8], 1.0)
    with pytest.raises(ValueError, match="nobody"):
        S.similar_tags(vectors, tags, "nobody")


@pytest.mark.parametrize("block_tags", [None, 7, 1])
def test_all_pairs_in_blocks(spark, block_tags, monkeypatch):
    monkeypatch.setattr(S, "STRIPE_ROWS", 4)
    ids, dense = random_tags()
    vectors, tags = frames(spark, ids, dense)
    want = cosine_matrix(dense)
    n = len(ids)
    pairs = {(int(ids[i]), int(ids[j])): want[i, j] for i in range(n) for j in range(i + 1, n)}

    def got(df):
        rows = df.collect()
        out = {(r["src"], r["dst"]): r["similarity"] for r in rows}
        assert len(out) == len(rows)
        return out

    assert got(S.cosine_pairs(vectors, tags, None, block_tags)) == pairs
    assert got(S.pairwise_cosine(vectors, tags, len(ids), block_tags=block_tags)) == {
        p: s for p, s in pairs.items() if s > 0
    }
    assert got(S.cosine_pairs(vectors, tags, 0.5, block_tags)) == {
        p: s for p, s in pairs.items() if s >= 0.5
    }
    assert all(0 <= s <= 1 for s in pairs.values())


def test_matrix_is_bounded_by_its_tag_count(spark):
    ids, dense = random_tags()
    vectors, tags = frames(spark, ids, dense)
    got = S.pairwise_cosine(vectors, tags, tag_count=6).collect()
    assert got and {r["dst"] for r in got} <= {int(i) for i in ids[:6]}


@pytest.mark.parametrize("block_tags", [None, 5])
@pytest.mark.parametrize("include_self", [True, False])
def test_best_of_every_tag(spark, block_tags, include_self, monkeypatch):
    monkeypatch.setattr(S, "STRIPE_ROWS", 3)
    ids, dense = random_tags(seed=7)
    vectors, tags = frames(spark, ids, dense)
    got = S.similar_tags_all(vectors, tags, 6, include_self, block_tags).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["tag_id"], r["similarity"]))
    want = cosine_matrix(dense)
    for i, query in enumerate(ids):
        keep = [j for j in range(len(ids)) if include_self or j != i]
        assert by_query[query] == ranking(ids[keep], want[i, keep], 6)


def test_blocks_fit_a_task(spark):
    one = spark.createDataFrame([(1, 999, 1.0)], "tag_id bigint, term_idx int, weight double")
    assert S._block_size(one, 10) == 1024
    assert S._block_size(one, 128_000) == 2000
    assert S._block_size(one, 10**9) == 8192
    wide = spark.createDataFrame([(1, 99_999, 1.0)], "tag_id bigint, term_idx int, weight double")
    assert S._block_size(wide, 10**9) == 81
    assert S._block_size(one.limit(0), 0) == 1024
