"""Tag analytics on Spark: index posts by tag, vectorise their text, compare and group tags."""

from tagloom.operators.graph import community_summary, connected_components, label_propagation
from tagloom.operators.similarity import pairwise_cosine, similar_tags, similar_tags_all
from tagloom.plans import (
    TagModel,
    detect_communities,
    fit_post_vectors,
    fit_tag_vectors,
    load_model,
    save_model,
)
from tagloom.sources import Corpus, CorpusConfig, load_corpus, make_corpus, read_table

__all__ = [
    "Corpus",
    "CorpusConfig",
    "TagModel",
    "community_summary",
    "connected_components",
    "detect_communities",
    "fit_post_vectors",
    "fit_tag_vectors",
    "label_propagation",
    "load_corpus",
    "load_model",
    "make_corpus",
    "pairwise_cosine",
    "read_table",
    "save_model",
    "similar_tags",
    "similar_tags_all",
]
