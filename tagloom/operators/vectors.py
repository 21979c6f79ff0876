"""TF-IDF post vectors and their mean per tag.

A post's vector stays inside its row, as the parallel arrays ``term_idx`` and ``value``: counting,
weighting and normalising need no shuffle.  Both arrays are bounded by the vocabulary size.  The
only thing that travels is one sum per map task, tag and term.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.binding import let
from tagloom.operators.joins import salted_join
from tagloom.operators.terms import normal_forms, term_totals, tokenize, vocabulary
from tagloom.sources.staging import stage

FEATURE_SIZE = 1000
MAX_FORMS = 200_000
# Pseudo term that counts posts in the same pass that sums their weights.
POSTS = -1
_UNIT = "\x1f"


@dataclass(frozen=True)
class Vocabulary:
    """At most ``feature_size`` terms, in index order, and how words map to them.

    ``forms`` is ``(term, term_idx)`` over the surface words of every chosen term, or ``None`` when
    a word is its own term.
    """

    terms: tuple[str, ...]
    table: DataFrame
    forms: DataFrame | None = None


def fit_vocabulary(
    posts: DataFrame,
    feature_size: int = FEATURE_SIZE,
    stem: bool = False,
    lemmas: DataFrame | None = None,
) -> Vocabulary:
    """Choose the most frequent terms of ``posts.words``.

    With ``stem`` or ``lemmas`` the corpus is still counted by surface word, and the counts are
    added up per normal form.
    """
    totals = term_totals(tokenize(posts))
    if not stem and lemmas is None:
        table = vocabulary(totals, feature_size)
        rows = table.collect()  # at most feature_size rows
        return Vocabulary(_terms(rows), _frame(posts, rows))
    # Stemming shortens words ("aed" to "a"), so the token rule is applied to the normal form too.
    # Staged because the choice of terms and the list of their forms both read it.
    forms = stage(
        normal_forms(totals, stem, lemmas).filter(F.col("normal").rlike("^[a-z0-9]{2,}$")),
        "forms",
    )
    per_normal = forms.groupBy(F.col("normal").alias("term")).agg(F.sum("total").alias("total"))
    rows = vocabulary(per_normal, feature_size).collect()  # at most feature_size rows
    table = _frame(posts, rows)
    chosen = F.broadcast(table.select(F.col("term").alias("normal"), "term_idx"))
    return Vocabulary(_terms(rows), table, forms.join(chosen, "normal").select("term", "term_idx"))


def _terms(rows) -> tuple[str, ...]:
    return tuple(r["term"] for r in sorted(rows, key=lambda r: r["term_idx"]))


def _frame(posts: DataFrame, rows) -> DataFrame:
    return posts.sparkSession.createDataFrame(rows, "term string, total bigint, term_idx int")


def _literal(values: Sequence, kind: str) -> Column:
    """A constant array; the split of a constant is folded once, when the plan is optimised."""
    return F.split(F.lit(_UNIT.join(map(str, values))), _UNIT).cast(f"array<{kind}>")


def _count_words(df: DataFrame, words: Column, known: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: a struct of ``indices`` and ``values`` counting the ``known`` words."""
    model = CountVectorizerModel.from_vocabulary(
        list(known), inputCol="_words", outputCol="_counts"
    )
    counted = model.transform(df.withColumn("_words", words))
    return counted.withColumn(out, F.unwrap_udt("_counts")).drop("_words", "_counts")


def count_vectors(posts: DataFrame, vocab: Vocabulary, max_forms: int = MAX_FORMS) -> DataFrame:
    """Replace ``words`` by ``term_idx`` and ``value``, the counts of the vocabulary terms.

    Every post stays, with empty arrays if it has no known term.
    """
    keep = [c for c in posts.columns if c != "words"]
    if not vocab.terms:
        empty = [F.array().cast("array<int>"), F.array().cast("array<double>")]
        return posts.select(*keep, empty[0].alias("term_idx"), empty[1].alias("value"))
    words = F.col("words")
    if vocab.forms is not None:
        found = vocab.forms.limit(max_forms + 1).collect()
        if len(found) > max_forms:
            return _count_by_join(posts, vocab, keep)
        known = sorted((r["term"], r["term_idx"]) for r in found)
        term_of = _literal([vocab.terms[idx] for _, idx in known], "string")
        posts = _count_words(posts, words, [form for form, _ in known], "_forms")
        words = F.flatten(
            F.zip_with(
                F.col("_forms.indices"),
                F.col("_forms.values"),
                lambda i, n: F.array_repeat(F.get(term_of, i), n.cast("int")),
            )
        )
    counted = _count_words(posts, words, vocab.terms, "_vector")
    return counted.select(
        *keep, F.col("_vector.indices").alias("term_idx"), F.col("_vector.values").alias("value")
    )


def _count_by_join(posts: DataFrame, vocab: Vocabulary, keep: list[str]) -> DataFrame:
    """The same counts by joining tokens with the forms, for any number of forms.

    Frequent words are salted; a post's terms are regrouped into arrays no longer than the
    vocabulary.  A post id may repeat: counts follow from the words alone, so rows of one id are told
    apart by a digest of their words, and a pseudo term counts the rows that share both.
    """
    known = F.coalesce("words", F.array().cast("array<string>"))
    keyed = posts.withColumn("_words", known).withColumn(
        "_digest", F.md5(F.array_join("_words", " "))
    )
    words = keyed.select("post_id", "_digest", F.explode_outer("_words").alias("term"))
    joined = salted_join(
        words.filter(F.col("term").isNotNull()), vocab.forms, "term", salt_by="post_id"
    )
    rows = keyed.select("post_id", "_digest", F.lit(POSTS).alias("term_idx"))
    counts = (
        joined.select("post_id", "_digest", "term_idx")
        .unionByName(rows)
        .groupBy("post_id", "_digest", "term_idx")
        .agg(F.count("*").alias("_n"))
    )
    # The pseudo term is the smallest index, so it comes first.
    entry = F.sort_array(F.collect_list(F.struct("term_idx", "_n")))
    packed = counts.groupBy(F.col("post_id").alias("_id"), F.col("_digest").alias("_key")).agg(
        entry.alias("_entries")
    )
    same = keyed["post_id"].eqNullSafe(packed["_id"]) & (keyed["_digest"] == packed["_key"])
    found = keyed.join(packed, same).select(
        *keep,
        F.element_at("_entries", 1)["_n"].alias("_rows"),
        F.slice("_entries", F.lit(2), F.size("_entries")).alias("_entries"),
    )
    return found.select(
        *keep,
        F.col("_entries.term_idx").alias("term_idx"),
        F.transform("_entries", lambda e: (e["_n"] / F.col("_rows")).cast("double")).alias("value"),
    )


def document_frequencies(counted: DataFrame) -> DataFrame:
    """``(term_idx, df)``: in how many posts each term is; the pseudo term ``POSTS`` is in all."""
    return (
        counted.select(F.explode(F.array_append("term_idx", POSTS)).alias("term_idx"))
        .groupBy("term_idx")
        .agg(F.count("*").alias("df"))
    )


def smooth_idf(counted: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(term, term_idx, df, idf)``, idf being ``ln((1 + n) / (1 + df)) + 1`` for ``n`` posts.

    One pass over the counts.  The window and the frame, which is held by the driver, have one row per
    vocabulary term.
    """
    of_posts = F.max(F.when(F.col("term_idx") == POSTS, F.col("df"))).over(Window.partitionBy())
    n, df = F.coalesce("_n", F.lit(0)), F.coalesce("df", F.lit(0)).cast("bigint")
    rows = (
        vocab.table.select("term", "term_idx")
        .join(document_frequencies(counted), "term_idx", "full")
        .withColumn("_n", of_posts)
        .filter(F.col("term").isNotNull())
        .select("term", "term_idx", df.alias("df"), (F.log((1 + n) / (1 + df)) + 1).alias("idf"))
        .collect()
    )
    return counted.sparkSession.createDataFrame(
        sorted(rows, key=lambda r: r["term_idx"]), "term string, term_idx int, df bigint, idf double"
    )


def tfidf(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """Counts times the idf of ``smooth_idf``, which becomes one constant array."""
    rows = idf.select("term_idx", "idf").collect()  # one row per vocabulary term
    if not rows:
        return counted
    factors = _literal([repr(r["idf"]) for r in sorted(rows)], "double")
    weighted = F.zip_with("value", "term_idx", lambda tf, i: tf * F.get(factors, i))
    return counted.withColumn("value", weighted)


def unit_length(weighted: DataFrame) -> DataFrame:
    """Divide each vector by its Euclidean length; an empty or zero vector stays as it is."""
    squares = F.aggregate("value", F.lit(0.0), lambda acc, v: acc + v * v)
    length = F.when(squares > 0, F.sqrt(squares)).otherwise(1.0)
    return weighted.withColumn(
        "value", let(length, lambda by: F.transform("value", lambda v: v / by))
    )


def long_form(packed: DataFrame, key: str = "post_id", value: str = "weight") -> DataFrame:
    """``(key, term_idx, value)``, one row per vector entry.

    The outer explode and its filter keep the optimizer from computing the arrays a second time
    just to test their size.
    """
    exploded = packed.select(key, F.explode_outer(F.arrays_zip("term_idx", "value")).alias("_e"))
    return exploded.filter(F.col("_e").isNotNull()).select(
        key, F.col("_e.term_idx").alias("term_idx"), F.col("_e.value").alias(value)
    )


def sum_by_tag(tagged: DataFrame, tag: str) -> DataFrame:
    """``(tag, term_idx, total)``: weights added up per tag, plus the pseudo term ``POSTS``.

    ``tagged`` has one row per tag occurrence.  Sums are formed in each map task first, so a tag on
    a third of all posts sends one row per task and term, and the shuffle key includes the term.
    """
    with_count = tagged.select(
        tag,
        F.array_append("term_idx", POSTS).alias("term_idx"),
        F.array_append("value", 1.0).alias("value"),
    )
    entries = long_form(with_count, key=tag, value="value")
    return entries.groupBy(tag, "term_idx").agg(F.sum("value").alias("total"))


def mean_by_tag(sums: DataFrame) -> DataFrame:
    """``(tag_id, term_idx, weight, n_posts)``; the row of the pseudo term has a null weight.

    The window holds one tag's terms, at most the vocabulary size and one.
    """
    counted = F.when(F.col("term_idx") == POSTS, F.col("total"))
    n_posts = F.max(counted).over(Window.partitionBy("tag_id"))
    return (
        sums.withColumn("_n", n_posts)
        .select(
            "tag_id",
            "term_idx",
            F.when(F.col("term_idx") != POSTS, F.col("total") / F.col("_n")).alias("weight"),
            F.col("_n").cast("bigint").alias("n_posts"),
        )
    )


def vectors_of(means: DataFrame) -> DataFrame:
    """The real entries of ``mean_by_tag``: ``(tag_id, term_idx, weight)``."""
    return means.filter(F.col("term_idx") != POSTS).select("tag_id", "term_idx", "weight")


def tag_vectors(index: DataFrame, packed: DataFrame) -> DataFrame:
    """Mean vector per tag of any ``(tag_id, post_id)`` index, over the posts in ``packed``.

    A post listed twice for a tag counts twice.  Tags without a post in ``packed`` have no rows.
    """
    tagged = index.select("tag_id", "post_id").join(
        packed.select("post_id", "term_idx", "value"), "post_id"
    )
    return vectors_of(mean_by_tag(sum_by_tag(tagged, "tag_id")))


def coverage(tags: DataFrame, means: DataFrame) -> DataFrame:
    """``(tag_id, tag_name, n_posts)``; a tag without corpus posts has 0 and the zero vector."""
    counts = means.filter(F.col("term_idx") == POSTS).select("tag_id", "n_posts")
    return tags.join(counts, "tag_id", "left").select(
        "tag_id", "tag_name", F.coalesce("n_posts", F.lit(0)).cast("bigint").alias("n_posts")
    )
