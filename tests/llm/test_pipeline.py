"""The pipeline's stages, and the registered queries against their SQL twins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import decontaminate, lines, pieces, simhash, toxicity
from tagloom.llm.common import table
from tagloom.llm.oracle import ORACLE
from tagloom.llm.queries import QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    toxic = {r.doc_id for r in toxicity.toxicity_report(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    kept = docs
    for (name, function), expected in zip(
        corpus_pipeline.STAGES, ["toxicity", "line dedup", "near dedup", "decontamination", "tokens"]
    ):
        assert name == expected
        before, kept = kept, function(spark, kept, SF).cache()
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {r.doc_id for r in docs.collect()} - toxic
        if name == "line dedup":
            texts = {r.doc_id: r.text for r in lines.dedup_lines(before).collect()}
            assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (t, len(t)) for i, t in texts.items()}
        if name == "near dedup":
            assert ids == {r.component_id for r in simhash.component_report(before).collect()}
        if name == "decontamination":
            report = decontaminate.contamination_report(before, table(spark, SF, "benchmark"))
            assert ids == {r.doc_id for r in report.filter("NOT contaminated").collect()}
        if name == "tokens":
            assert kept.count() == before.count() and set(kept.columns) == {"doc_id", *pieces.DIGESTS.names}
        else:
            assert kept.columns == columns
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, kept.collect()))


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are named like an operator's own come back as they were; ``n_chars`` may be missing."""
    names = "_score score _hit _n_words _items _row_key row_key _fp n_lines n_removed _others _ _text2".split()
    docs = table(spark, SF, "documents").drop("n_chars")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, SF)
        assert kept.columns == docs.columns
        wrong = [F.coalesce(F.col(n), F.lit("")) != F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names]
        assert 0 < kept.count() <= docs.count()
        assert kept.filter(F.greatest(*[w.cast("int") for w in wrong]) > 0).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_on_no_documents(spark):
    docs = table(spark, SF, "documents").filter("false")
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF)
        assert docs.count() == 0
