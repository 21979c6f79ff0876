"""Sentence and word tokens, with abbreviations and sentence starts learned from the texts themselves.

The statistics are those of Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection"
(2006).  An abbreviation is a type that has a period much more often than chance, weighed by its length, its
inner periods and its uses without one.  A sentence starter is a type that follows certain sentence ends
much more often than chance.  Each takes one aggregate over the corpus, of distinct words and of distinct
pairs around possible sentence ends, so the tests on characters run on distinct words only.

No types reach the driver, only totals.  A text meets the types of its own words by a join, in which a frequent
type is broadcast or salted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.binding import let
from tagloom.functions.tokenizing import (
    CLOSING,
    has_period,
    open_pairs,
    open_runs,
    raw_words,
    sentence_lines,
    treebank_tokens,
    word_type,
)
from tagloom.operators.joins import lookup_join
from tagloom.sources.staging import stage

# The counting function travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_ABBREVIATION = 0.3
MIN_STARTER = 30.0
#: How often an abbreviation's type has its period.
WITH_PERIOD = 0.99


def _word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``(word, n)`` of ``raw_words``, counted batch by batch before they are rows, then over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # What ASCII separates beyond its white space is made a space first.
            text = pc.replace_substring_regex(batch.column(0), pattern=r"[\x1c-\x1f]", replacement=" ")
            counts = pc.ascii_split_whitespace(text).flatten().value_counts()
            made = pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])
            yield made.filter(pc.not_equal(made.column(0), ""))

    counts = texts.select(column).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def type_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(type, n, n_period)`` of all types with a letter: their uses, and those with one period behind."""
    distinct = _word_counts(texts, column)
    typed = distinct.select(
        word_type(F.col("word")).alias("type"),
        F.col("n"),
        F.when(has_period(F.col("word")), F.col("n")).otherwise(0).alias("n_period"),
    )
    return (
        typed.filter(F.col("type").rlike(r"\p{L}"))
        .groupBy("type")
        .agg(F.sum("n").alias("n"), F.sum("n_period").alias("n_period"))
    )


def _times_log(count: Column, share: Column) -> Column:
    return F.when(count > 0, count * F.log(share)).otherwise(0.0)


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``(type, n, n_period, score)`` of the types that ever have a period.

    The score is the log-likelihood ratio of a period behind nearly every use to one by chance, times
    factors that favour short types, inner periods and few uses without a period.
    """
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_period").alias("n_period")).head()
    chance = (total["n_period"] or 0) / max(1, total["n"] or 0)
    n, with_period = F.col("n").cast("double"), F.col("n_period").cast("double")
    without = n - with_period
    by_chance = _times_log(with_period, F.lit(chance)) + _times_log(without, F.lit(1 - chance))
    nearly_all = with_period * F.log(F.lit(WITH_PERIOD)) + without * F.log(F.lit(1 - WITH_PERIOD))
    inner = F.length("type") - F.length(F.translate("type", ".", ""))
    letters = (F.length("type") - inner).cast("double")
    score = (
        -2 * (by_chance - nearly_all) * F.exp(-letters) * (inner + 1) * F.pow(letters, -without)
    )
    return counts.filter("n_period > 0").withColumn("score", score)


def abbreviations(counts: DataFrame, least: float = MIN_ABBREVIATION) -> DataFrame:
    """``(type)``: the types that are abbreviations."""
    return abbreviation_scores(counts).filter(F.col("score") >= least).select("type")


def starter_scores(
    texts: DataFrame, counts: DataFrame, abbreviated: DataFrame, column: str = "text"
) -> DataFrame:
    """``(type, n, n_start, score)`` of the types that ever follow a certain sentence end.

    Certain ends are ``?``, ``!``, and a single period that is neither an abbreviation's nor a single
    letter's.  The score is the log-likelihood ratio of the type depending on the end to it not doing so,
    negative where it is rarer there than elsewhere.
    """

    def ends(runs: Column) -> Column:
        return F.filter(open_pairs(runs), lambda p: p["following"].isNotNull())

    runs = open_runs(raw_words(F.col(column)))
    pairs = texts.select(F.explode(let(runs, ends)).alias("p")).select("p.*")
    pairs = pairs.groupBy("word", "following").agg(F.count("*").alias("n_start"))
    typed = pairs.select(
        F.col("word").rlike(rf"[?!]{CLOSING}\z").alias("sure"),
        word_type(F.col("word")).alias("before"),
        (has_period(F.col("word")) & (F.length(word_type(F.col("word"))) > 1)).alias("period"),
        word_type(F.col("following")).alias("type"),
        "n_start",
    ).filter("sure OR period")
    known = abbreviated.select(F.col("type").alias("before"), F.lit(True).alias("_known"))
    typed = typed.join(known, "before", "left").filter("sure OR _known IS NULL")
    starts = typed.groupBy("type").agg(F.sum("n_start").alias("n_start"))
    starts = stage(starts.join(counts.select("type", "n"), "type"), "starts")
    ends_ = float(starts.agg(F.sum("n_start")).head()[0] or 0)
    total = float(counts.agg(F.sum("n")).head()[0] or 0)
    both, uses = F.col("n_start").cast("double"), F.col("n").cast("double")
    rest = F.lit(total - ends_) - (uses - both)

    def likelihood(at_ends: Column, elsewhere: Column) -> Column:
        return (
            _times_log(both, at_ends)
            + _times_log(F.lit(ends_) - both, 1 - at_ends)
            + _times_log(uses - both, elsewhere)
            + _times_log(rest, 1 - elsewhere)
        )

    alike = uses / F.lit(max(total, 1.0))
    ratio = 2 * (
        likelihood(both / F.lit(max(ends_, 1.0)), (uses - both) / F.lit(max(total - ends_, 1.0)))
        - likelihood(alike, alike)
    )
    often = both * F.lit(total) > uses * F.lit(ends_)
    return starts.select("type", "n", "n_start", F.when(often, ratio).otherwise(-ratio).alias("score"))


def sentence_starters(scores: DataFrame, least: float = MIN_STARTER) -> DataFrame:
    """``(type)``: the types that often begin a sentence."""
    return scores.filter(F.col("score") >= least).select("type")


def word_tokens(
    texts: DataFrame, abbreviated: DataFrame, starters: DataFrame, column: str = "text"
) -> DataFrame:
    """``texts`` with ``sentences``, the sentences on lines, and ``tokens``, all their words in order.

    A null text has no sentence and no tokens.  Equal texts are looked up once.
    """

    def asked(runs: Column) -> Column:
        ends = F.filter(open_pairs(runs), lambda p: p["following"].isNotNull())
        return F.array_distinct(
            F.flatten(F.transform(ends, lambda p: F.array(word_type(p["word"]), word_type(p["following"]))))
        )

    keyed = texts.withColumn("_row", F.md5(F.coalesce(F.col(column), F.lit(""))))
    types = (
        keyed.select("_row", column)
        .dropDuplicates(["_row"])
        .select("_row", F.explode(let(open_runs(raw_words(F.col(column))), asked)).alias("type"))
    )
    kinds = abbreviated.select("type", F.lit(True).alias("short")).unionByName(
        starters.select("type", F.lit(False).alias("short"))
    )
    kinds = stage(kinds.distinct(), "kinds")
    # A text has as many types at most as words.
    found = (
        lookup_join(types, kinds, "type", salt_by="_row")
        .groupBy("_row")
        .agg(
            F.collect_set(F.when(F.col("short"), F.col("type"))).alias("_short"),
            F.collect_set(F.when(~F.col("short"), F.col("type"))).alias("_starts"),
        )
    )
    none = F.array().cast("array<string>")
    lines = sentence_lines(
        raw_words(F.col(column)), F.coalesce("_short", none), F.coalesce("_starts", none)
    )
    joined = keyed.join(found, "_row", "left")
    # Out of an explode, so that the lines are made once for both columns.
    made = joined.select(*texts.columns, F.explode(F.array(lines)).alias("sentences"))
    return made.withColumn("tokens", treebank_tokens(F.col("sentences")))
