"""Table sources: any Spark format, columns pruned at the scan, optional ordered row cap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.sources.selection import first_rows

POSTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("score", T.IntegerType()),
    ]
)
TAGS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tag_name", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("excerpt_post_id", T.LongType()),
        T.StructField("wiki_post_id", T.LongType()),
    ]
)
WIKI_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("body", T.StringType())]
)


def read_table(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    order_by: str = "id",
    **options: str,
) -> DataFrame:
    """Load one table through the named connector.

    ``columns`` is pushed into the scan.  ``limit`` caps the rows for a trial run; the cap follows
    ``order_by`` so that the same rows come back every time.
    """
    df = spark.read.format(fmt).options(**options).load(location)
    if columns is not None:
        df = df.select(*columns)
    return cap_rows(df, limit, order_by)


def cap_rows(df: DataFrame, limit: int | None, order_by: str = "id") -> DataFrame:
    """The first ``limit`` rows by ``order_by``; ``None`` keeps them all."""
    return df if limit is None else first_rows(df, limit, order_by)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the declared columns, ignoring anything else the table carries."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class CorpusConfig:
    """Where the four input tables are and how to read them."""

    posts: str
    tags: str
    excerpts: str
    wikis: str
    fmt: str = "parquet"
    limit: int | None = None
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Corpus:
    """The four input frames under their declared schemas; posts without tags are gone."""

    posts: DataFrame
    tags: DataFrame
    excerpts: DataFrame
    wikis: DataFrame


def load_corpus(spark: SparkSession, config: CorpusConfig) -> Corpus:
    """Read the four tables and keep the tagged posts."""

    def table(location: str, schema: T.StructType) -> DataFrame:
        df = read_table(
            spark, location, config.fmt, schema.fieldNames(), config.limit, **config.options
        )
        return conform(df, schema)

    return make_corpus(
        table(config.posts, POSTS_SCHEMA),
        table(config.tags, TAGS_SCHEMA),
        table(config.excerpts, WIKI_SCHEMA),
        table(config.wikis, WIKI_SCHEMA),
    )


def make_corpus(
    posts: DataFrame, tags: DataFrame, excerpts: DataFrame, wikis: DataFrame
) -> Corpus:
    """Corpus from frames that are already loaded."""
    from tagloom.operators.posts import tagged_posts

    return Corpus(
        posts=tagged_posts(conform(posts, POSTS_SCHEMA)),
        tags=conform(tags, TAGS_SCHEMA),
        excerpts=conform(excerpts, WIKI_SCHEMA),
        wikis=conform(wikis, WIKI_SCHEMA),
    )
