"""The tag index: which posts carry which tag.

The working form is long, one row per ``(tag, post)``.  List forms are made on request, in chunks:
the posts of a popular tag never meet in one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.joins import lookup_join

# Post ids [k * IDS_PER_CHUNK, (k + 1) * IDS_PER_CHUNK) of a tag share one list.
IDS_PER_CHUNK = 1_000_000


def split_tags(tags: Column) -> Column:
    """``"a|b"`` to ``["a", "b"]``."""
    return F.split(tags, r"\|")


def explode_tags(posts: DataFrame) -> DataFrame:
    """``(post_id, tag_name)``, one row per tag occurrence; a repeated tag repeats."""
    return posts.select(
        F.col("id").alias("post_id"), F.explode(split_tags(F.col("tags"))).alias("tag_name")
    )


def tag_index(posts: DataFrame, tags: DataFrame, small: bool | None = None) -> DataFrame:
    """``(tag_id, tag_name, post_id)`` for the tags that the dimension knows."""
    dim = tags.select(F.col("id").alias("tag_id"), "tag_name")
    joined = lookup_join(explode_tags(posts), dim, "tag_name", salt_by="post_id", small=small)
    return joined.select("tag_id", "tag_name", "post_id")


def tag_post_lists(post_tags: DataFrame, ids_per_chunk: int = IDS_PER_CHUNK) -> DataFrame:
    """``(tag_name, chunk, post_ids)``: sorted post ids per tag, duplicates kept.

    A chunk is a range of post ids, so a list has a bounded length whatever the tag's popularity,
    and the chunks of a tag in order are its whole sorted list.
    """
    chunk = F.floor(F.col("post_id") / F.lit(ids_per_chunk)).cast("bigint")
    return (
        post_tags.withColumn("chunk", chunk)
        .groupBy("tag_name", "chunk")
        .agg(F.sort_array(F.collect_list("post_id")).alias("post_ids"))
    )


def encode_post_ids(post_ids: Column) -> Column:
    """Ids as one comma-joined string, for interchange."""
    return F.array_join(post_ids.cast("array<string>"), ",")


def decode_post_ids(encoded: Column) -> Column:
    """The ids of a comma-joined string, typed."""
    return F.split(encoded, ",").cast("array<bigint>")


def build_tag_post(
    posts: DataFrame,
    tags: DataFrame,
    ids_per_chunk: int = IDS_PER_CHUNK,
    small: bool | None = None,
) -> DataFrame:
    """The tag dimension with its encoded post ids, one row per tag and chunk.

    Posts are grouped before the join, so the join sees a tag at most once per chunk; a tag with
    very many chunks is a hot key of that join.
    """
    lists = tag_post_lists(explode_tags(posts), ids_per_chunk).select(
        "tag_name", "chunk", encode_post_ids(F.col("post_ids")).alias("post_ids")
    )
    dim = tags.select(
        F.col("id").alias("tag_id"), "tag_name", F.col("count"), "excerpt_post_id", "wiki_post_id"
    )
    return lookup_join(lists, dim, "tag_name", salt_by="chunk", small=small).select(
        "tag_id", "tag_name", "count", "excerpt_post_id", "wiki_post_id", "chunk", "post_ids"
    )


def used_tags(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """``(tag_id, tag_name, n_tagged)`` for dimension tags that at least one post carries."""
    used = explode_tags(posts).groupBy("tag_name").agg(F.count("*").alias("n_tagged"))
    dim = tags.select(F.col("id").alias("tag_id"), "tag_name")
    return dim.join(used, "tag_name").select("tag_id", "tag_name", "n_tagged")


def in_corpus(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """Index rows whose post is in the corpus."""
    return index.join(corpus.select("post_id"), "post_id", "left_semi")
