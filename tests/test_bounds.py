"""Threshold joins, the implicit complete graph, range selection, keyed store and bitmaps."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import graph as G
from tagloom.operators import postings as B
from tagloom.operators import similarity as S
from tagloom.plans import detect_communities
from tagloom.sources import first_rows, forget_keyed, load_keyed, new_location, save_keyed
from tests.test_plans import plan
from tests.test_similarity import cosine_matrix, frames


def clustered(n=300, width=40, groups=10, seed=1, apart=(0.02, 0.2, 0.6)):
    """Tags around a few directions, at several distances, with copies and zero vectors."""
    rng = np.random.default_rng(seed)
    middle = rng.random((groups, width)) * (rng.random((groups, width)) < 0.15)
    noise = rng.random((n, width)) * (rng.random((n, width)) < 0.2)
    dense = middle[rng.integers(0, groups, n)] + noise * rng.choice(apart, (n, 1))
    dense[7] = dense[9] * 3
    dense[11] = 0
    return np.sort(rng.choice(100_000, n, replace=False)).astype(int), dense


@pytest.mark.parametrize("block_tags", [None, 30])
@pytest.mark.parametrize("least", [0.5, 0.8, 0.95, 1.0])
def test_close_pairs_lose_nothing(spark, block_tags, least, monkeypatch):
    monkeypatch.setattr(S, "STRIPE_ROWS", 17)
    ids, dense = clustered()
    vectors, tags = frames(spark, ids, dense)
    want = cosine_matrix(dense)
    expected = {
        (int(ids[i]), int(ids[j])): want[i, j]
        for i in range(len(ids))
        for j in range(i + 1, len(ids))
        if want[i, j] >= least
    }
    rows = S.close_pairs(vectors, tags, least, block_tags).collect()
    assert len(rows) == len({(r.src, r.dst) for r in rows})
    assert {(r.src, r.dst): r.similarity for r in rows} == expected and expected


def test_most_block_pairs_are_skipped(spark):
    ids, dense = clustered(seed=2, apart=(0.02, 0.1))
    vectors, tags = frames(spark, ids, dense)
    shares = [S.plan_blocks(vectors, tags, least, 20).skipped for least in (0.5, 0.8, 0.95)]
    assert shares == sorted(shares) and shares[0] > 0.3 and shares[1] > 0.5 and shares[2] > 0.6
    blocks = S.plan_blocks(vectors, tags, 0.8, 20).rows.groupBy("block").count().collect()
    assert sum(r["count"] for r in blocks) == len(ids) - 1


def test_close_pairs_of_nothing(spark):
    vectors = spark.createDataFrame([], "tag_id bigint, term_idx int, weight double")
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "tag_id bigint, tag_name string")
    assert S.close_pairs(vectors, tags, 0.5).count() == 0
    assert S.close_pairs(vectors, tags.filter("false"), 0.5).count() == 0


@pytest.mark.parametrize("self_loops", [True, False])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_implicit_complete_graph(spark, n, self_loops):
    vertices = spark.createDataFrame([(10 * i + 3, f"v{i}") for i in range(n)], "id bigint, name string")
    pairs = [(10 * i + 3, 10 * j + 3, 1.0) for i in range(n) for j in range(n) if self_loops or i != j]
    whole = G.TagGraph(vertices, spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"))
    for rounds in (1, 2, 5):
        found = {r.id: r.label for r in G.complete_label_propagation(vertices, rounds, self_loops).collect()}
        assert found == {r.id: r.label for r in G.label_propagation(whole, rounds).collect()}
    if n:
        found = {r.id: r.component for r in G.complete_components(vertices).collect()}
        assert found == {r.id: r.component for r in G.connected_components(whole).collect()}


def test_complete_communities_make_no_edges(spark):
    n = 3000  # nine million edges, had they been written
    tags = spark.range(5, 5 + n).select(F.col("id").alias("tag_id"), F.lit("x").alias("tag_name"))
    vectors = spark.createDataFrame([], "tag_id bigint, term_idx int, weight double")
    found = detect_communities(vectors, tags, min_similarity=None)
    assert found.groupBy("component", "label").count().collect() == [(5, 5, n)]


def test_first_rows_match_an_ordered_limit(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.randint(0, 5), str(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (0, 1, 13, 350, 699, 700, 5000):
        got = [tuple(r) for r in first_rows(df, n, "a", "b", taken_rows=-1).collect()]
        assert Counter(r[:2] for r in got) == Counter(r[:2] for r in order[:n]) and set(got) <= set(rows)
        assert len(set(got)) == len(got)
        exact = first_rows(df, n, "a", "b", "c", taken_rows=-1).collect()
        assert Counter(map(tuple, exact)) == Counter(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[:n])
    assert first_rows(df.filter("false"), 5, "a", taken_rows=-1).count() == 0


def test_no_single_task_holds_many_first_rows(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("id")).repartition(5)
    for n in (50_000, 49_999, 31_000):
        chosen = first_rows(df, n, "id", taken_rows=1000)
        limits = [int(x) for x in __import__("re").findall(r"TakeOrderedAndProject\(limit=(\d+)", chosen._jdf.queryExecution().executedPlan().toString())]
        assert all(x <= 4000 for x in limits) and len(limits) <= 1
        assert chosen.agg(F.count("*"), F.max("id")).head() == (n, n - 1)
        assert n < 50_000 or "SinglePartition" not in plan(chosen)


def test_keyed_store_needs_no_exchange(spark):
    ids, dense = clustered(n=60)
    vectors, tags = frames(spark, ids, dense)
    path = new_location(spark, "keyed")
    save_keyed(vectors, tags, path, buckets=4)
    forget_keyed(spark, path)  # as in another session: the layout comes from the files' folder
    stored, names = load_keyed(spark, path)
    assert Counter(map(tuple, stored.collect())) == Counter(map(tuple, vectors.collect()))
    assert {(r.tag_id, r.tag_name) for r in names.collect()} == {(r.tag_id, r.tag_name) for r in tags.collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.join(names, "tag_id")
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert "Exchange" not in plan(joined.groupBy("tag_id").agg(F.sum("weight")))
        assert joined.count() == vectors.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Files of other buckets are left out in any case; the plan says so only for scans by bucket.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        one = stored.filter(F.col("tag_id") == int(ids[0]))
        assert "SelectedBucketsCount: 1 out of 4" in plan(one)
        assert one.count() == np.count_nonzero(dense[0])
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert S.similar_tags(stored, names, f"t{ids[5]}").count() == 20
    forget_keyed(spark, path)


def index_rows(rng):
    rows = []
    for post in [-70_000, -32_769, -32_768, -1, 0, 1, 32_767, 32_768, 2**40, 2**62, *rng.sample(range(200_000), 300)]:
        for tag in rng.sample(range(5), rng.randint(1, 3)):
            rows += [(tag, f"t{tag}", post)] * rng.choice([1, 1, 1, 2, 4])
    return rows


def test_bitmaps_hold_the_index(spark):
    rows = index_rows(random.Random(8))
    index = spark.createDataFrame(rows + [(1, "t1", None)], "tag_id bigint, tag_name string, post_id bigint")
    made = B.bitmap_postings(index.repartition(4)).cache()
    assert made.count() < len(rows) / 5
    assert Counter(tuple(r) for r in B.decode_postings(made).collect()) == Counter(rows)
    found = {r.tag_id: (r.n_posts, r.n_rows) for r in B.posting_counts(made).collect()}
    assert found == {t: (len({p for u, _, p in rows if u == t}), sum(u == t for u, _, _ in rows)) for t in range(5)}
    posts = random.Random(9).sample(sorted({p for _, _, p in rows}), 120)
    corpus = spark.createDataFrame([(p,) for p in posts + posts[:9]] + [(5_000_000,), (None,)], "post_id bigint")
    inside = B.postings_in_corpus(made, corpus).cache()
    kept = Counter(r for r in rows if r[2] in set(posts))
    assert Counter(tuple(r) for r in B.decode_postings(inside).collect()) == kept
    found = {r.tag_id: (r.n_posts, r.n_rows) for r in B.posting_counts(inside).collect()}
    assert found == {t: (len({k for k in kept if k[0] == t}), sum(n for k, n in kept.items() if k[0] == t)) for t in range(5)}
    assert B.decode_postings(B.bitmap_postings(index.filter("false"))).count() == 0
