"""Input frames for the tag operators, derived from the given tables.

Documents become posts (first line is the title, language and source make the tags, the quality
label is the score), benchmark items become tag wiki excerpts, and raw pages become tag wikis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.tags import explode_tags
from tagloom.sources import Corpus, make_corpus, read_table


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None):
    return read_table(spark, f"{sf_dir}/{name}.parquet", columns=columns)


def _document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    pair = F.concat_ws("-", "lang", "source")
    untagged = F.col("doc_id") % 50
    tags = (
        F.when(untagged == 13, F.lit(None).cast("string"))
        .when(untagged == 7, F.lit(""))
        .when(F.col("doc_id") % 40 == 3, F.concat_ws("|", pair, F.col("lang"), pair))
        .otherwise(F.concat_ws("|", pair, F.col("lang")))
    )
    return documents.select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        tags.alias("tags"),
        F.lit(None).cast("bigint").alias("parent_id"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    scores = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("score"))
    scored = _document_posts(spark, sf_dir).join(scores, "id", "left")
    return scored.withColumn("score", F.coalesce("score", F.lit(0)))


def tag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag in use and some that are not; those ending in ``-src0`` are left out.

    An id is taken from the name's digest, so no global numbering is needed.
    """
    used = (
        explode_tags(_document_posts(spark, sf_dir).filter(F.col("tags") != ""))
        .groupBy("tag_name")
        .agg(F.count("*").alias("count"))
    )
    orphans = table(spark, sf_dir, "region", ["r_name"]).select(
        F.concat(F.lit("orphan-"), "r_name").alias("tag_name"),
        F.lit(0).cast("bigint").alias("count"),
    )
    tag_id = F.conv(F.substring(F.md5("tag_name"), 1, 12), 16, 10).cast("bigint")
    named = used.unionByName(orphans).filter(~F.col("tag_name").endswith("-src0"))
    return named.select(
        tag_id.alias("id"),
        "tag_name",
        "count",
        (1_000_000_000 + tag_id % 40).alias("excerpt_post_id"),
        (2_000_000_000 + tag_id % 50).alias("wiki_post_id"),
    )


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        (1_000_000_000 + F.col("item_id")).alias("id"), F.col("text").alias("body")
    )


def wikis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", ["page_id", "html"]).select(
        (2_000_000_000 + F.col("page_id")).alias("id"), F.col("html").alias("body")
    )


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return make_corpus(
        posts(spark, sf_dir),
        tag_table(spark, sf_dir),
        excerpts(spark, sf_dir),
        wikis(spark, sf_dir),
    )


def order_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """A second corpus with many short posts: orders.

    The part names of an order are its body, the distinct brands its tags, the number of its lines
    its score.
    """
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    parts = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    order_posts = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.array_join(F.sort_array(F.collect_list("p_name")), " ").alias("body"),
            F.array_join(F.sort_array(F.collect_set("p_brand")), "|").alias("tags"),
            F.count("*").cast("int").alias("score"),
        )
        .select(
            "id",
            F.concat(F.lit("order "), F.col("id").cast("string")).alias("title"),
            "body",
            "tags",
            F.lit(None).cast("bigint").alias("parent_id"),
            "score",
        )
    )
    brand_id = F.conv(F.substring(F.md5("tag_name"), 1, 12), 16, 10).cast("bigint")
    brands = parts.groupBy(F.col("p_brand").alias("tag_name")).agg(F.count("*").alias("count"))
    tags = brands.select(
        brand_id.alias("id"),
        "tag_name",
        "count",
        F.lit(None).cast("bigint").alias("excerpt_post_id"),
        F.lit(None).cast("bigint").alias("wiki_post_id"),
    )
    return make_corpus(
        order_posts, tags, excerpts(spark, sf_dir), wikis(spark, sf_dir)
    )
