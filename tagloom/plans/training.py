"""Fit tag vectors from a corpus, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.posts import build_post_text, training_posts
from tagloom.operators.tags import split_tags, used_tags
from tagloom.operators.terms import with_words
from tagloom.operators.vectors import (
    FEATURE_SIZE,
    Vocabulary,
    count_vectors,
    coverage,
    fit_vocabulary,
    mean_by_tag,
    smooth_idf,
    sum_by_tag,
    tfidf,
    unit_length,
    vectors_of,
)
from tagloom.sources.staging import stage
from tagloom.sources.store import load_vectors, save_vectors
from tagloom.sources.tables import Corpus

TAGS = "tag_id bigint, tag_name string, n_posts bigint"
TERMS = "term string, total bigint, term_idx int"


@dataclass(frozen=True)
class TagModel:
    """``tags (tag_id, tag_name, n_posts)``, ``vectors (tag_id, term_idx, weight)`` and
    ``terms (term, total, term_idx)``, the vocabulary."""

    tags: DataFrame
    vectors: DataFrame
    terms: DataFrame


@dataclass(frozen=True)
class PostModel:
    """Post vectors: ``posts`` carries ``term_idx`` and ``value`` arrays, ``idf`` is ``smooth_idf``."""

    posts: DataFrame
    idf: DataFrame
    vocabulary: Vocabulary


def fit_post_vectors(
    posts: DataFrame,
    feature_size: int = FEATURE_SIZE,
    stem: bool = False,
    lemmas: DataFrame | None = None,
) -> PostModel:
    """Unit-length TF-IDF vectors of ``posts.words``; other columns are carried along.

    ``posts`` is read twice, for the totals and for the counts of the chosen terms, so stage it if
    its rows are costly.  The counts, much smaller than the words, are staged here: document
    frequencies and vectors both read them.
    """
    vocab = fit_vocabulary(posts, feature_size, stem, lemmas)
    counted = stage(count_vectors(posts, vocab), "counts")
    idf = smooth_idf(counted, vocab)
    return PostModel(unit_length(tfidf(counted, idf)), idf, vocab)


def fit_tag_vectors(
    corpus: Corpus,
    feature_size: int = FEATURE_SIZE,
    score: int = 1,
    stem: bool = True,
    lemmas: DataFrame | None = None,
    stop_words: Sequence[str] | None = None,
    max_posts: int | None = None,
) -> TagModel:
    """From raw posts to one vector per tag.

    The tag string stays on its post, so post vectors meet their tags without a join on post ids.
    Sums are formed per tag name first; the tag dimension joins the sums, not the posts.
    """
    text = build_post_text(corpus.posts, corpus.excerpts, corpus.wikis, carry=["tags"])
    cleaned = training_posts(text, score, stop_words, max_posts)
    words = with_words(cleaned.select("post_id", "tags", "body"), cleaned=True)
    posts = stage(words, "training_posts")
    model = fit_post_vectors(posts, feature_size, stem, lemmas)
    tagged = model.posts.withColumn("tag_name", F.explode(split_tags(F.col("tags"))))
    sums = sum_by_tag(tagged, "tag_name")
    dim = corpus.tags.select(F.col("id").alias("tag_id"), "tag_name")
    means = stage(mean_by_tag(sums.join(dim, "tag_name")), "tag_means")
    tags = stage(coverage(used_tags(corpus.posts, corpus.tags), means), "tags")
    return TagModel(tags, vectors_of(means), model.vocabulary.table)


def save_model(model: TagModel, path: str, mode: str = "errorifexists") -> None:
    """Write the three frames below ``path``, to be ranked or grouped later without training."""
    save_vectors(model.vectors, f"{path}/vectors", mode)
    model.tags.write.mode(mode).parquet(f"{path}/tags")
    model.terms.write.mode(mode).parquet(f"{path}/terms")


def load_model(spark: SparkSession, path: str) -> TagModel:
    """The model that ``save_model`` wrote to ``path``."""
    return TagModel(
        spark.read.schema(TAGS).parquet(f"{path}/tags"),
        load_vectors(spark, f"{path}/vectors"),
        spark.read.schema(TERMS).parquet(f"{path}/terms"),
    )
