"""Communities of tags, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.graph import (
    TagGraph,
    complete_components,
    complete_label_propagation,
    connected_components,
    label_propagation,
    tag_graph,
)
from tagloom.operators.similarity import first_tags
from tagloom.sources.staging import stage


def staged(graph: TagGraph) -> TagGraph:
    """The graph with its two frames written once; both algorithms read them."""
    return TagGraph(stage(graph.vertices, "vertices"), stage(graph.edges, "edges"))


def detect_communities(
    vectors: DataFrame,
    tags: DataFrame,
    tag_count: int | None = None,
    *,
    min_similarity: float | None,
    max_iter: int = 5,
) -> DataFrame:
    """``(id, name, component, label)`` for all tags, or the first ``tag_count`` of them.

    ``min_similarity=None`` asks for the complete graph: both answers follow from its vertices, and none of
    its edges is made.
    """
    if min_similarity is None:
        chosen = tags if tag_count is None else first_tags(tags, tag_count)
        vertices = stage(
            chosen.select(F.col("tag_id").alias("id"), F.col("tag_name").alias("name")), "vertices"
        )
        labels = complete_label_propagation(vertices, max_iter).select("id", "label")
        return complete_components(vertices).join(labels, "id").select(
            "id", "name", "component", "label"
        )
    graph = staged(tag_graph(vectors, tags, tag_count, min_similarity=min_similarity))
    labels = label_propagation(graph, max_iter).select("id", "label")
    return connected_components(graph).join(labels, "id").select(
        "id", "name", F.col("component"), F.col("label")
    )
