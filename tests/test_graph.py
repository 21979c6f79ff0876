from __future__ import annotations

import random
from collections import Counter

import pytest

from tagloom.operators import graph as G
from tagloom.plans import detect_communities


def make(spark, n, edges):
    vertices = spark.createDataFrame([(i, f"v{i}") for i in range(n)], "id bigint, name string")
    rows = [(a, b, 1.0) for a, b in edges]
    return G.TagGraph(
        vertices, spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    )


def union_find(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(n)}


def propagate(n, edges, rounds):
    labels = list(range(n))
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    for _ in range(rounds):
        votes = [Counter(labels[j] for j in near[i]) for i in range(n)]
        labels = [
            min(v, key=lambda x: (-v[x], x)) if v else labels[i] for i, v in enumerate(votes)
        ]
    return dict(enumerate(labels))


def shuffled_path(n, seed):
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return list(zip(order, order[1:]))


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [tuple(rng.sample(range(n), 2)) for _ in range(m)]


GRAPHS = {
    "path": (40, shuffled_path(40, 1)),
    "star": (60, [(59, i) for i in range(50)]),
    "random": (60, random_edges(60, 45, 2)),
    "loops and repeats": (5, [(1, 1), (2, 3), (3, 2), (2, 3)]),
    "no edges": (4, []),
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("small", [True, False])
def test_connected_components(spark, name, small, monkeypatch):
    monkeypatch.setattr(G, "is_small", lambda df: small)
    n, edges = GRAPHS[name]
    got = {r["id"]: r["component"] for r in G.connected_components(make(spark, n, edges)).collect()}
    assert got == union_find(n, edges)


@pytest.mark.parametrize("name", ["random", "star", "loops and repeats", "no edges"])
@pytest.mark.parametrize("small", [True, False])
def test_label_propagation(spark, name, small, monkeypatch):
    monkeypatch.setattr(G, "is_small", lambda df: small)
    n, edges = GRAPHS[name]
    got = {r["id"]: r["label"] for r in G.label_propagation(make(spark, n, edges), 5).collect()}
    assert got == propagate(n, edges, 5)
    assert set(got.values()) <= set(range(n))


@pytest.mark.parametrize("small", [True, False])
def test_dangling_edges(spark, small, monkeypatch):
    monkeypatch.setattr(G, "is_small", lambda df: small)
    graph = make(spark, 3, [(0, 1), (1, 7), (8, 2), (8, 9), (2, 2)])
    got = sorted((r["src"], r["dst"]) for r in G.dangling_edges(graph).collect())
    assert got == [(1, 7), (8, 2), (8, 9)]
    again = make(spark, 3, [(1, 7), (1, 7), (None, 2), (0, 1)])
    got = [(r["src"], r["dst"]) for r in G.dangling_edges(again).collect()]
    assert sorted(got, key=str) == [(1, 7), (1, 7), (None, 2)]


@pytest.mark.parametrize("small", [True, False])
def test_dangling_edges_connect_nothing(spark, small, monkeypatch):
    monkeypatch.setattr(G, "is_small", lambda df: small)
    graph = make(spark, 4, [(0, 9), (9, 1), (2, 3), (None, 0)])
    got = {r["id"]: r["component"] for r in G.connected_components(graph).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def tag_frames(spark):
    rows = [(1, 0, 1.0), (2, 0, 1.0), (2, 1, 0.1), (3, 1, 1.0), (4, 1, 2.0)]
    vectors = spark.createDataFrame(rows, "tag_id bigint, term_idx int, weight double")
    tags = spark.createDataFrame(
        [(i, f"t{i}") for i in range(1, 6)], "tag_id bigint, tag_name string"
    )
    return vectors, tags


def test_tag_graph_modes(spark):
    vectors, tags = tag_frames(spark)
    graph = G.tag_graph(vectors, tags, min_similarity=0.9)
    assert sorted((r["src"], r["dst"]) for r in graph.edges.collect()) == [(1, 2), (3, 4)]
    assert graph.vertices.count() == 5
    first = G.tag_graph(vectors, tags, tag_count=3, min_similarity=0.9)
    assert [(r["src"], r["dst"]) for r in first.edges.collect()] == [(1, 2)]
    complete = {
        (r["src"], r["dst"]): r["weight"]
        for r in G.tag_graph(vectors, tags, tag_count=5, min_similarity=None).edges.collect()
    }
    assert len(complete) == 25
    assert complete[3, 3] == complete[3, 4] == complete[4, 3] == 1.0
    assert complete[5, 5] == complete[5, 1] == 0.0 and complete[1, 2] == complete[2, 1] > 0.9
    with pytest.raises(ValueError):
        G.tag_graph(vectors, tags, tag_count=None, min_similarity=None)


def test_communities_end_to_end(spark):
    vectors, tags = tag_frames(spark)
    found = detect_communities(vectors, tags, min_similarity=0.9)
    got = {r["id"]: (r["component"], r["label"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {k: v[1] for k, v in got.items()} == {
        k + 1: v + 1 for k, v in propagate(5, [(0, 1), (2, 3)], 5).items()
    }
    complete = detect_communities(vectors, tags, tag_count=5, min_similarity=None)
    summary = {
        r["method"]: r["communities"] for r in G.community_summary(complete, complete).collect()
    }
    assert summary == {"connected_components": 1, "label_propagation": 1}
