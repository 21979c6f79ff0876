from __future__ import annotations

import random

from pyspark.sql import functions as F

from tagloom.operators import posts as P
from tagloom.operators import tags as T
from tagloom.operators.joins import hot_keys, lookup_join, salted_join
from tagloom.sources import (
    POSTS_SCHEMA,
    TAGS_SCHEMA,
    WIKI_SCHEMA,
    CorpusConfig,
    cap_rows,
    load_corpus,
    make_corpus,
)

POSTS = [
    (1, "t1", "b1", "a|b", None, 3),
    (2, "t2", "b2", "a", None, 0),
    (3, None, "b3", "", None, 5),
    (4, "t4", None, None, None, 5),
    (5, "t5", "b5", "b|a|b", 1, None),
    (1_000_001, "t6", "b6", "a|unknown", None, 1),
]
TAGS = [(10, "a", 4, 100, 200), (20, "b", 2, 101, 201), (30, "orphan", 0, None, None)]


def corpus(spark):
    return make_corpus(
        spark.createDataFrame(POSTS, POSTS_SCHEMA),
        spark.createDataFrame(TAGS, TAGS_SCHEMA),
        spark.createDataFrame([(100, "excerpt a")], WIKI_SCHEMA),
        spark.createDataFrame([(200, "wiki a"), (201, None)], WIKI_SCHEMA),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tagged_posts_drops_null_and_empty(spark):
    assert [r["id"] for r in corpus(spark).posts.orderBy("id").collect()] == [1, 2, 5, 1_000_001]


def test_index_keeps_repeats_and_known_tags(spark):
    c = corpus(spark)
    want = [(10, "a", 1), (10, "a", 2), (10, "a", 5), (10, "a", 1_000_001)]
    want += [(20, "b", 1), (20, "b", 5), (20, "b", 5)]
    for small in (None, True, False):
        assert rows(T.tag_index(c.posts, c.tags, small=small)) == want


def test_lists_are_chunked_sorted_and_whole(spark):
    exploded = T.explode_tags(corpus(spark).posts)
    lists = T.tag_post_lists(exploded).collect()
    assert {(r["tag_name"], r["chunk"]): r["post_ids"] for r in lists} == {
        ("a", 0): [1, 2, 5],
        ("a", 1): [1_000_001],
        ("b", 0): [1, 5, 5],
        ("unknown", 1): [1_000_001],
    }
    narrow = T.tag_post_lists(exploded, ids_per_chunk=2)
    decoded = narrow.select("tag_name", F.explode("post_ids").alias("post_id"))
    assert rows(decoded) == rows(exploded.select("tag_name", "post_id"))
    assert narrow.filter(F.size("post_ids") > 4).count() == 0


def test_build_tag_post_and_decode(spark):
    c = corpus(spark)
    for small in (True, False, None):
        built = T.build_tag_post(c.posts, c.tags, small=small)
        assert rows(built) == [
            (10, "a", 4, 100, 200, 0, "1,2,5"),
            (10, "a", 4, 100, 200, 1, "1000001"),
            (20, "b", 2, 101, 201, 0, "1,5,5"),
        ]
    decoded = built.select(T.decode_post_ids(F.col("post_ids")).alias("ids"))
    assert dict(decoded.dtypes)["ids"] == "array<bigint>"
    assert rows(T.used_tags(c.posts, c.tags)) == [(10, "a", 4), (20, "b", 3)]


def test_post_text_filters(spark):
    c = corpus(spark)
    text = P.build_post_text(c.posts, c.excerpts, c.wikis)
    assert text.columns == ["post_id", "body", "title", "score"] and text.count() == 7
    assert sorted(r["post_id"] for r in P.drop_untitled(text).collect()) == [1, 2, 5, 1_000_001]
    assert sorted(r["post_id"] for r in P.min_score(text).collect()) == [1, 1_000_001]
    assert tuple(P.corpus_counts(T.used_tags(c.posts, c.tags), text).head()) == (2, 7)


def test_nonblank_after_cleaning(spark):
    texts = [
        (1, "ok body", "Fine title", 1, "kept"),
        (2, "ok body", "The", 1, "the title is a stop word"),
        (3, "<p> !!! </p>", "Fine title", 1, "the body is punctuation"),
        (4, "日本", "Fine title", 1, "the body is not ASCII"),
        (5, "ok body", "Fine title", 0, "low score"),
        (6, "ok body", "Fine title", None, "no score"),
        (7, "a", "b", 9, "stop words and a letter"),
    ]
    df = spark.createDataFrame(
        texts, "post_id bigint, body string, title string, score int, note string"
    )
    got = P.training_posts(df)
    assert rows(got.select("post_id", "body", "title")) == [(1, "ok body", "fine title")]
    assert got.columns == df.columns
    stemmed = P.preprocess_text(df.withColumn("body", F.lit("Running <b>dogs</b>")), stem=True)
    assert {r["body"] for r in stemmed.collect()} == {"run dog"}


def test_caps_are_ordered_and_off_by_default(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r["id"] for r in cap_rows(df, 3).collect()) == [0, 1, 2]
    assert cap_rows(df, None).count() == 100
    text = spark.range(9).selectExpr("id as post_id", "'x1' as body", "'y1' as title", "1 as score")
    assert sorted(r[0] for r in P.training_posts(text, max_posts=2).collect()) == [0, 1]


def test_corpus_from_files(spark, tmp_path):
    c = corpus(spark)
    names = ("posts", "tags", "excerpts", "wikis")
    for name in names:
        getattr(c, name).write.json(str(tmp_path / name))
    config = CorpusConfig(*(str(tmp_path / name) for name in names), fmt="json")
    loaded = load_corpus(spark, config)
    assert loaded.posts.schema == c.posts.schema
    assert rows(loaded.posts.select("id", "tags")) == rows(c.posts.select("id", "tags"))


def test_joins_agree_on_a_hot_key(spark):
    rng = random.Random(3)
    keys = ["hot"] * 400 + [rng.choice("abcdefgh") for _ in range(300)]
    facts = spark.createDataFrame(list(enumerate(keys)), "n int, key string")
    lookup = spark.createDataFrame(
        [("hot", 1), ("a", 2), ("a", 3), ("b", 4), ("z", 5)], "key string, v int"
    )
    want = rows(facts.join(lookup, "key"))
    hot = hot_keys(facts, "key", 2)  # over twice an average partition of eight
    assert [r["key"] for r in hot.collect()] == ["hot"]
    assert hot_keys(facts, "key").count() == 9  # all hold over a quarter of one
    assert rows(salted_join(facts, lookup, "key", "n", hot, spread=5)) == want
    assert rows(salted_join(facts, lookup, "key", "n")) == want
    assert rows(lookup_join(facts, lookup, "key", "n")) == want
    assert sorted(salted_join(facts, lookup, "key", "n", hot).columns) == ["key", "n", "v"]


def test_semi_join_keeps_multiplicity(spark):
    index = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "tag_id bigint, post_id bigint")
    corpus_posts = spark.createDataFrame([(5,)], "post_id bigint")
    assert T.in_corpus(index, corpus_posts).count() == 2
