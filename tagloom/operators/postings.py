"""The tag index as bitmaps: one bit per post, in buckets of post ids.

A bucket holds ``BITS`` ids, so a row has one size however popular its tag is, and the posts of a tag never
meet in one task.  Bits are set in the map tasks and combined by a bitwise or, so a tag and bucket send one row
per task.  A bitmap forgets repeats; a post that carries a tag more than once is listed beside it with the number of
its further occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.binding import let

#: Bits of a bitmap, as Spark makes them.
BITS = 32_768


def _bucket(ids: Column) -> Column:
    return F.shiftright(ids, BITS.bit_length() - 1)


def _bit(ids: Column) -> Column:
    return ids.bitwiseAND(F.lit(BITS - 1))


def bitmap_postings(index: DataFrame) -> DataFrame:
    """``(tag_id, tag_name, bucket, posts, n_posts, n_rows, repeats)`` of ``(tag_id, tag_name, post_id)`` rows.

    ``posts`` has the bit of every post, ``n_rows`` counts repeats too, and ``repeats`` lists ``(post_id,
    more)`` for posts with more than one row, at most as many as a bucket has ids.  Null post ids are left
    out.
    """
    times = (
        index.filter("post_id IS NOT NULL")
        .groupBy("tag_id", "tag_name", "post_id")
        .agg(F.count("*").alias("times"))
    )
    more = F.when(F.col("times") > 1, F.struct("post_id", (F.col("times") - 1).alias("more")))
    return (
        times.withColumn("bucket", _bucket(F.col("post_id")))
        .groupBy("tag_id", "tag_name", "bucket")
        .agg(
            F.bitmap_construct_agg(_bit(F.col("post_id"))).alias("posts"),
            F.count("*").alias("n_posts"),
            F.sum("times").alias("n_rows"),
            F.sort_array(F.collect_list(more)).alias("repeats"),
        )
    )


def corpus_bitmaps(posts: DataFrame) -> DataFrame:
    """``(bucket, posts)``: the bits of all ids in ``posts (post_id)``."""
    return (
        posts.filter("post_id IS NOT NULL")
        .select(_bucket(F.col("post_id")).alias("bucket"), _bit(F.col("post_id")).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("posts"))
    )


def set_bits(bitmap: Column) -> Column:
    """The positions of the set bits, rising."""
    size = BITS // 8

    def bits(byte: Column) -> Column:
        value = F.conv(F.hex(F.substring(bitmap, byte + 1, F.lit(1))), 16, 10).cast("int")
        return let(
            value,
            lambda v: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(v, k) == 1),
                lambda k: byte * 8 + k,
            ),
        )

    used = F.filter(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda byte: F.substring(bitmap, byte + 1, F.lit(1)) != F.lit(bytearray(1)),
    )
    return F.flatten(F.transform(used, bits))


def decode_postings(postings: DataFrame) -> DataFrame:
    """``(tag_id, tag_name, post_id)``: the index rows, repeats included."""
    ids = F.transform(set_bits(F.col("posts")), lambda bit: F.col("bucket") * BITS + bit)
    again = F.flatten(
        F.transform("repeats", lambda r: F.array_repeat(r["post_id"], r["more"].cast("int")))
    )
    return postings.select("tag_id", "tag_name", F.explode(F.concat(ids, again)).alias("post_id"))


def posting_counts(postings: DataFrame) -> DataFrame:
    """``(tag_id, tag_name, n_posts, n_rows)`` over all buckets, from the counts alone."""
    return postings.groupBy("tag_id", "tag_name").agg(
        F.sum("n_posts").alias("n_posts"), F.sum("n_rows").alias("n_rows")
    )


def postings_in_corpus(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """The postings of the posts in ``corpus (post_id)``: the bits that both bitmaps have.

    The corpus has one row per bucket, whatever its number of posts.
    """
    known = corpus_bitmaps(corpus).withColumnRenamed("posts", "_corpus")
    met = postings.join(known, "bucket")
    common = (
        met.select("tag_id", "tag_name", "bucket", F.explode(F.array("posts", "_corpus")).alias("_bits"))
        .groupBy("tag_id", "tag_name", "bucket")
        .agg(F.bitmap_and_agg("_bits").alias("posts"))
    )
    kept = common.join(postings.drop("posts", "n_posts", "n_rows"), ["tag_id", "tag_name", "bucket"])
    inside = F.filter(
        "repeats", lambda r: F.array_contains(F.col("_ids"), _bit(r["post_id"]).cast("int"))
    )
    n = F.bitmap_count("posts")
    listed = kept.filter(n > 0).withColumn(
        "_ids", F.when(F.size("repeats") > 0, set_bits(F.col("posts")))
    )
    listed = listed.withColumn("repeats", F.when(F.size("repeats") > 0, inside).otherwise(F.col("repeats")))
    more = F.aggregate("repeats", F.lit(0).cast("bigint"), lambda acc, r: acc + r["more"])
    return listed.select(
        "tag_id", "tag_name", "bucket", "posts", n.alias("n_posts"), (n + more).alias("n_rows"), "repeats"
    )
