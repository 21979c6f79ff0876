"""Post filters and the combined post text frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.cleaning import clean_text
from tagloom.functions.stemming import stem_text
from tagloom.operators.terms import normal_text
from tagloom.sources.selection import TAKEN_ROWS, first_rows
from tagloom.sources.staging import stage


def tagged_posts(posts: DataFrame) -> DataFrame:
    """Posts with a non-empty tag string; a null drops as well, and with it every answer."""
    return posts.filter(F.col("tags") != "")


def build_post_text(
    posts: DataFrame, excerpts: DataFrame, wikis: DataFrame, carry: Sequence[str] = ()
) -> DataFrame:
    """Posts, tag wiki excerpts and tag wikis as ``(post_id, body, title, score)``.

    The wiki branches have no title and no score.  ``carry`` keeps further post columns, null for
    the other branches.  Nothing is deduplicated.
    """
    columns = ("body", "title", "score", *carry)
    text = posts.select(F.col("id").alias("post_id"), *columns)
    for wiki in (excerpts, wikis):
        typed = [
            F.col("body") if c == "body" else F.lit(None).cast(text.schema[c].dataType).alias(c)
            for c in columns
        ]
        text = text.unionByName(wiki.select(F.col("id").alias("post_id"), *typed))
    return text


def drop_untitled(text: DataFrame) -> DataFrame:
    """Drop rows without a title or a body."""
    return text.dropna(subset=["title", "body"])


def min_score(text: DataFrame, score: int = 1) -> DataFrame:
    """Rows scored at least ``score``; rows without a score drop."""
    return text.filter(F.col("score") >= score)


def nonblank_text(text: DataFrame) -> DataFrame:
    """Rows whose title and body hold more than spaces."""
    return text.filter((F.trim("title") != "") & (F.trim("body") != ""))


def preprocess_text(
    text: DataFrame,
    stop_words: Sequence[str] | None = None,
    stem: bool = False,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Drop untitled rows and clean title and body; stem and lemmatise every word in place if asked.

    The cleaned pair comes out of an ``inline`` of one struct.  A later filter on cleaned text
    would otherwise be pushed below the projection and clean every row a second time.
    """

    def cleaned(name: str):
        out = clean_text(F.col(name), stop_words)
        return (stem_text(out) if stem and lemmas is None else out).alias(name)

    rest = [c for c in text.columns if c not in ("title", "body")]
    pair = F.inline(F.array(F.struct(cleaned("title"), cleaned("body"))))
    clean = drop_untitled(text).select(*rest, pair).select(*text.columns)
    return clean if lemmas is None else normal_text(clean, ["title", "body"], stem, lemmas)


def training_posts(
    text: DataFrame,
    score: int = 1,
    stop_words: Sequence[str] | None = None,
    max_posts: int | None = None,
) -> DataFrame:
    """The cleaned posts that vectors are fitted on.

    The score filter is applied before cleaning: it reaches the scan, and no row is cleaned in
    vain.  ``max_posts`` caps the corpus for a trial run, by post id.
    """
    kept = nonblank_text(preprocess_text(min_score(text, score), stop_words))
    if max_posts is None:
        return kept
    # The keys are read once more where many are asked for; cleaning is not repeated for that.
    return first_rows(stage(kept, "capped") if max_posts > TAKEN_ROWS else kept, max_posts, "post_id")


def corpus_counts(tag_posts: DataFrame, text: DataFrame) -> DataFrame:
    """One row ``(n_tags, n_posts)``: the tags that have posts, and the text rows."""
    tags = tag_posts.select("tag_id").distinct().agg(F.count("*").alias("n"))
    posts = text.agg(F.count("*").alias("n"))
    both = tags.withColumn("what", F.lit("n_tags")).unionByName(
        posts.withColumn("what", F.lit("n_posts"))
    )
    return both.agg(
        F.max(F.when(F.col("what") == "n_tags", F.col("n"))).alias("n_tags"),
        F.max(F.when(F.col("what") == "n_posts", F.col("n"))).alias("n_posts"),
    )
