"""The tag similarity graph and its communities.

Both algorithms are rounds of joins and aggregations.  Each round ends in a reliable checkpoint, so
plans stay short and a lost executor costs one round at most.  A hub may hold a large part of all
edges: aggregates combine before they shuffle, and joins go through ``lookup_join``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.joins import hot_keys, is_small, lookup_join
from tagloom.operators.similarity import close_pairs, cosine_pairs, first_tags
from tagloom.sources.staging import cut_lineage


@dataclass(frozen=True)
class TagGraph:
    """``vertices (id, name)`` and ``edges (src, dst, weight)``; edge direction has no meaning."""

    vertices: DataFrame
    edges: DataFrame


def similarity_edges(
    vectors: DataFrame,
    tags: DataFrame,
    min_similarity: float,
    block_tags: int | None = None,
) -> DataFrame:
    """``(src, dst, weight)``, ``src < dst``, for pairs at least ``min_similarity`` similar."""
    pairs = close_pairs(vectors, tags, min_similarity, block_tags)
    return pairs.withColumnRenamed("similarity", "weight")


def complete_edges(vectors: DataFrame, tags: DataFrame, block_tags: int | None = None) -> DataFrame:
    """Every ordered pair of tags with its similarity, self-loops included.

    The result has ``n * n`` rows: pass a bounded ``tags`` frame, as ``tag_graph`` does.
    """
    pairs = cosine_pairs(vectors, tags, None, block_tags).withColumnRenamed("similarity", "weight")
    has_vector = vectors.groupBy("tag_id").agg(F.lit(1.0).alias("_one"))
    loops = tags.join(has_vector, "tag_id", "left").select(
        F.col("tag_id").alias("src"),
        F.col("tag_id").alias("dst"),
        F.coalesce("_one", F.lit(0.0)).alias("weight"),
    )
    return _both_ways(pairs, "weight").unionByName(loops)


def _both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """Each edge in both directions, in one pass over the edges."""
    ends = F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
    )
    return edges.select(F.explode(ends).alias("_e"), *carry).select(
        F.col("_e.a").alias("src"), F.col("_e.b").alias("dst"), *carry
    )


def tag_graph(
    vectors: DataFrame,
    tags: DataFrame,
    tag_count: int | None = None,
    *,
    min_similarity: float | None,
    block_tags: int | None = None,
) -> TagGraph:
    """Graph over all tags, or over the first ``tag_count`` of them by id.

    ``min_similarity=None`` asks for the complete graph, which needs a ``tag_count``.
    """
    if min_similarity is None and tag_count is None:
        raise ValueError("the complete graph has n * n edges: give tag_count or min_similarity")
    chosen = tags.select("tag_id", "tag_name")
    if tag_count is not None:
        chosen = first_tags(chosen, tag_count)
        vectors = vectors.join(chosen.select("tag_id"), "tag_id", "left_semi")
    if min_similarity is None:
        edges = complete_edges(vectors, chosen, block_tags)
    else:
        edges = similarity_edges(vectors, chosen, min_similarity, block_tags)
    vertices = chosen.select(F.col("tag_id").alias("id"), F.col("tag_name").alias("name"))
    return TagGraph(vertices, edges)


def dangling_edges(graph: TagGraph) -> DataFrame:
    """Edges with an end that is not a vertex or is null, as often as they occur.

    Ends are made distinct before they meet the vertices, so a hub is looked up once.
    """
    columns = graph.edges.columns
    edges = graph.edges.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))
    no_end = F.col("src").isNull() | F.col("dst").isNull()
    whole = edges.filter(~no_end)
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    missing = ends.join(graph.vertices, "id", "left_anti")
    small = is_small(missing)
    by_src = lookup_join(
        whole, missing.withColumnRenamed("id", "src"), "src", salt_by="dst", small=small
    )
    by_dst = lookup_join(
        whole, missing.withColumnRenamed("id", "dst"), "dst", salt_by="src", small=small
    )
    found = by_src.unionByName(by_dst).distinct().unionByName(edges.filter(no_end))
    times = F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))
    return found.withColumn("_time", times).select(*columns)


def valid_edges(graph: TagGraph, small: bool) -> DataFrame:
    """``(src, dst)`` of the edges whose two ends are vertices."""
    known = graph.vertices.select("id").distinct()
    edges = graph.edges.select("src", "dst")
    edges = lookup_join(edges, known.withColumnRenamed("id", "src"), "src", salt_by="dst", small=small)
    return lookup_join(edges, known.withColumnRenamed("id", "dst"), "dst", salt_by="src", small=small)


def connected_components(graph: TagGraph) -> DataFrame:
    """Vertices with ``component``, the smallest vertex id they are connected to.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
    MapReduce and Beyond" (2014), until no edge changes; the edges then point at the components.
    The number of rounds grows with the logarithm of the number of vertices, not with path length.
    Edges with an end that is not a vertex connect nothing.
    """
    small = is_small(graph.vertices)
    # Each edge once, from the larger id to the smaller one.
    links = (
        valid_edges(graph, small)
        .filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    links = cut_lineage(links)
    before = None
    while (after := _fingerprint(links)) != before:
        before = after
        links = cut_lineage(_small_star(_large_star(links, small), small))
    roots = links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return graph.vertices.join(roots, "id", "left").select(
        "id", "name", F.coalesce("component", "id").alias("component")
    )


def _fingerprint(links: DataFrame):
    """Number and combined hash of the distinct links: one row."""
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).head()


def _large_star(links: DataFrame, small: bool) -> DataFrame:
    """Link each vertex's larger neighbours to the smallest vertex it knows."""
    known = links.select(
        F.explode(
            F.array(
                F.struct(F.col("hi").alias("id"), F.col("lo").alias("near")),
                F.struct(F.col("lo").alias("id"), F.col("lo").alias("near")),
            )
        ).alias("_k")
    ).select("_k.*")
    smallest = known.groupBy("id").agg(F.min("near").alias("root"))
    moved = lookup_join(
        links, smallest.withColumnRenamed("id", "lo"), "lo", salt_by="hi", small=small
    )
    return moved.select("hi", F.col("root").alias("lo")).distinct()


def _small_star(links: DataFrame, small: bool) -> DataFrame:
    """Link each vertex and its smaller neighbours to the smallest of them."""
    smallest = links.groupBy("hi").agg(F.min("lo").alias("root"))
    moved = lookup_join(links, smallest, "hi", salt_by="lo", small=small)
    siblings = moved.filter(F.col("lo") != F.col("root")).select(
        F.col("lo").alias("hi"), F.col("root").alias("lo")
    )
    own = smallest.select("hi", F.col("root").alias("lo"))
    return siblings.unionByName(own).distinct()


def label_propagation(graph: TagGraph, max_iter: int = 5) -> DataFrame:
    """Vertices with ``label`` after ``max_iter`` synchronous rounds.

    A label starts as the vertex id.  In a round each vertex takes the label most frequent among
    its neighbours, of equally frequent ones the smallest; without neighbours it keeps its own.
    """
    small = is_small(graph.vertices)
    links = cut_lineage(_both_ways(graph.edges.select("src", "dst")))
    hubs = None if small else cut_lineage(hot_keys(links, "src"))
    labels = graph.vertices.select("id", F.col("id").alias("label"))
    for _ in range(max_iter):
        known = labels.withColumnRenamed("id", "src")
        told = lookup_join(links, known, "src", salt_by="dst", small=small, hot=hubs)
        votes = told.groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("votes"))
        # The largest (votes, -label) is the winner; an aggregate combines before it shuffles.
        heard = votes.groupBy("id").agg(
            F.max_by("label", F.struct("votes", -F.col("label"))).alias("heard")
        )
        labels = cut_lineage(
            labels.join(heard, "id", "left").select(
                "id", F.coalesce("heard", "label").alias("label")
            )
        )
    return graph.vertices.join(labels, "id")


def complete_components(vertices: DataFrame) -> DataFrame:
    """``connected_components`` of the complete graph over ``vertices``: one component, no edge."""
    smallest = vertices.agg(F.min("id")).head()[0]
    return vertices.select("id", "name", F.lit(smallest).cast(vertices.schema["id"].dataType).alias("component"))


def complete_label_propagation(
    vertices: DataFrame, max_iter: int = 5, self_loops: bool = True
) -> DataFrame:
    """``label_propagation`` of the complete graph over ``vertices``, whose ids are distinct; no edge is written.

    In a complete graph every vertex hears every label as often as it is worn, only its own once less if
    there are no ``self_loops``.  So a round needs no more than the two most frequent labels: the first, and
    the second for vertices that wear the first and could lose it by not hearing themselves.
    """
    labels = vertices.select("id", F.col("id").alias("label"))
    for _ in range(max_iter):
        votes = labels.groupBy("label").agg(F.count("*").alias("votes"))
        best = votes.orderBy(F.desc("votes"), "label").limit(2).collect()
        if not best:
            break
        top = F.lit(best[0]["label"])
        heard = top
        if not self_loops:
            n = best[0]["votes"]
            if len(best) == 1:  # all wear it; a single vertex hears nothing and keeps it
                second = top
            else:
                left, rival = (n - 1, -best[0]["label"]), (best[1]["votes"], -best[1]["label"])
                second = F.lit(best[1]["label"]) if rival > left else top
            heard = F.when(F.col("label") == top, second).otherwise(top)
        labels = cut_lineage(labels.select("id", heard.cast(labels.schema["label"].dataType).alias("label")))
    return vertices.join(labels, "id")


def community_summary(components: DataFrame, labels: DataFrame) -> DataFrame:
    """``(method, communities)``: the number of distinct groups either method found."""

    def count(groups: DataFrame, column: str, method: str) -> DataFrame:
        return (
            groups.select(column)
            .distinct()
            .agg(F.count("*").alias("communities"))
            .select(F.lit(method).alias("method"), "communities")
        )

    return count(components, "component", "connected_components").unionByName(
        count(labels, "label", "label_propagation")
    )
