"""The physical plans are the intended ones."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from suite import fixture
from suite import spark_queries as Q
from tagloom.operators import posts as P
from tagloom.operators import similarity as S
from tagloom.operators import tags as T
from tagloom.operators import terms as TM
from tagloom.operators import vectors as V
from tagloom.plans import fit_post_vectors

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def model(spark):
    return Q._model(spark, SF)


def training(spark):
    c = fixture.corpus(spark, SF)
    text = P.build_post_text(c.posts, c.excerpts, c.wikis, carry=["tags"])
    return P.training_posts(text).select("post_id", "tags", "body")


def test_wiki_branches_are_pruned_and_cleaning_stays_in_the_jvm(spark):
    text = plan(training(spark))
    # The node, as the tree lists it: the entity names in the expressions hold the word, too.
    union = re.compile(r"\bUnion \(\d+\)")
    c = fixture.corpus(spark, SF)
    assert union.search(plan(P.build_post_text(c.posts, c.excerpts, c.wikis)))
    assert not union.search(text) and "pages.parquet" not in text and "benchmark.parquet" not in text
    assert "Python" not in text
    # The score filter is below the cleaning, at the scan of the scores.
    assert re.search(r"DataFilters|quality.*>= 1", text)


def test_cleaning_runs_once_per_row(spark):
    # One Generate computes the cleaned pair; the filter on it stays above.
    text = plan(training(spark))
    assert text.count("Arguments: inline(") == 1
    assert not re.search(r"Condition : .*regexp_replace\(lower\(trim", text)


def test_scans_read_only_what_they_need(spark):
    c = fixture.corpus(spark, SF)
    text = plan(T.explode_tags(c.posts))
    schema = re.findall(r"ReadSchema: (.*)", text)
    # The label table is read for its key alone, the documents without their text.
    assert sorted(schema) == [
        "struct<doc_id:bigint,lang:string,source:string>",
        "struct<doc_id:bigint>",
    ]


def test_post_vectors_need_no_shuffle(spark):
    posts = Q._corpus_posts(spark, SF)
    vectors = fit_post_vectors(posts, stem=True).posts
    assert "Exchange" not in plan(vectors)
    tagged = vectors.withColumn("tag", F.lit("x"))
    summed = plan(V.sum_by_tag(tagged, "tag"))
    assert len(re.findall(r"\d+\) Exchange", summed)) == 1
    assert "partial_sum" in summed


def test_totals_combine_before_their_shuffle(spark):
    text = plan(TM.term_totals(TM.tokenize(Q._corpus_posts(spark, SF))))
    assert "partial_count" in text and len(re.findall(r"\d+\) Exchange", text)) == 1


def test_nothing_crosses(spark, model):
    frames = {
        "one": S.similar_tags(model.vectors, model.tags, "en"),
        "all": S.similar_tags_all(model.vectors, model.tags),
        "pairs": S.cosine_pairs(model.vectors, model.tags, 0.8),
        "index": Q.tag_index(spark, SF),
        "lists": Q.build_tag_post_df(spark, SF),
    }
    for df in frames.values():
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ranking_limits_before_it_sorts(spark, model):
    assert "TakeOrderedAndProject" in plan(S.similar_tags(model.vectors, model.tags, "en"))
    scored = plan(S.similarities_to(model.vectors, model.tags, "en"))
    assert "partial_sum" in scored and "Window" not in scored
    assert "WindowGroupLimit" in plan(S.similar_tags_all(model.vectors, model.tags, k=3))
