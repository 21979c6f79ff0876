"""Terms: tokens, counts, the bounded vocabulary, and stems or lemmas per distinct term."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.cleaning import clean_tokens, tokens
from tagloom.functions.stemming import stem_word
from tagloom.operators.joins import lookup_join
from tagloom.sources.staging import stage

# The summary and block functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The text of a block that is rewritten at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def with_words(posts: DataFrame, column: str = "body", cleaned: bool = False) -> DataFrame:
    """Replace a text column by ``words``, the array of its tokens.

    ``cleaned`` says that the text comes from ``clean_text``, which makes it cheaper to split.
    """
    split = clean_tokens if cleaned else tokens
    return posts.withColumn("words", split(F.col(column))).drop(column)


def tokenize(posts: DataFrame) -> DataFrame:
    """``(post_id, term)``, one row per element of ``words``.

    The outer form and the filter after it give the rows of a plain explode.  A plain explode also
    makes the optimizer test the array's size below the projection, which computes words that are
    not staged a second time.
    """
    exploded = posts.select("post_id", F.explode_outer("words").alias("term"))
    return exploded.filter(F.col("term").isNotNull())


def term_frequencies(tokenized: DataFrame) -> DataFrame:
    """``(post_id, term, tf)`` over all terms."""
    return tokenized.groupBy("post_id", "term").agg(F.count("*").alias("tf"))


def term_totals(tokenized: DataFrame) -> DataFrame:
    """``(term, total)``: occurrences in the corpus, combined before the shuffle."""
    return tokenized.groupBy("term").agg(F.count("*").alias("total"))


def normal_forms(
    terms: DataFrame, stem: bool = True, lemmas: DataFrame | None = None
) -> DataFrame:
    """``terms`` with ``normal``: the stem of each term, then its lemma if the table has one.

    ``terms`` holds distinct terms, so each is stemmed once however often it occurs.  ``lemmas``
    is a ``(term, lemma)`` table; of several lemmas of a term the alphabetically first counts.
    """
    if stem:
        # Stemming costs far more per byte than a shuffle, and the few bytes of a term list would
        # be read by few tasks.  A fixed number of partitions keeps every core at work.  The stem
        # comes out of an explode, because a filter on a projected stem would be pushed down and
        # stem every term again, on the far side of the repartitioning.
        tasks = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stem_once = F.explode(F.array(stem_word(F.col("term")))).alias("normal")
        out = terms.repartition(tasks, "term").select("*", stem_once)
    else:
        out = terms.withColumn("normal", F.col("term"))
    if lemmas is None:
        return out
    table = lemmas.groupBy(F.col("term").alias("normal")).agg(F.min("lemma").alias("lemma"))
    return out.join(table, "normal", "left").select(
        *terms.columns, F.coalesce("lemma", "normal").alias("normal")
    )


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of texts between spaces; an empty text has one empty word, no other has any."""
    single = pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=" {2,}", replacement=" ")
    return pc.split_pattern(pc.utf8_trim(single, characters=" "), pattern=" ")


def _in_blocks(texts: DataFrame, columns: list[str]) -> DataFrame:
    """``texts`` with ``_block``: neighbouring rows with about ``BLOCK_BYTES`` of text have the same."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        done = 0
        for batch in batches:
            sizes = (pc.fill_null(pc.binary_length(batch.column(c)), 0) for c in columns)
            ends = done + np.cumsum(sum(s.to_numpy(zero_copy_only=False).astype(np.int64) for s in sizes))
            done = int(ends[-1]) if len(ends) else done
            block = pa.array(task + ends // BLOCK_BYTES, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, block], [*batch.schema.names, "_block"])

    return texts.mapInArrow(dealt, T.StructType([*texts.schema.fields, T.StructField("_block", T.LongType())]))


def _block_terms(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """``(_block, term)``: the words of each block, once for each batch that holds a part of it."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(blocks)], strict=True):
                part = batch.slice(start, end - start)
                words = [_words(column).flatten() for column in part.columns[1:]]
                terms = pc.unique(pa.chunked_array(words))
                terms = terms.filter(pc.not_equal(terms, ""))
                block = pa.array(np.full(len(terms), blocks[start]), pa.int64())
                yield pa.RecordBatch.from_arrays([block, terms], ["_block", "term"])

    return blocks.select("_block", *columns).mapInArrow(listed, "_block long, term string")


def normal_text(
    texts: DataFrame, columns: list[str], stem: bool = True, lemmas: DataFrame | None = None
) -> DataFrame:
    """``texts`` with every word of the space-separated ``columns`` replaced by its normal form.

    Words stay in their order; null gives an empty text.  Each distinct word is stemmed and looked up
    once.  Texts are dealt in blocks of a few megabytes; a block meets those of its distinct words that
    change, so no row is made for every word, and a frequent word is one row per block at most.
    """

    def rewritten(block: pa.Table, changed: pa.Table) -> pa.Table:
        old, new = changed["term"].combine_chunks(), changed["normal"].combine_chunks()
        for number, name in enumerate(block.column_names):
            if name in columns:
                listed = _words(block[name].combine_chunks())
                coded = listed.flatten().dictionary_encode()
                found = new.take(pc.index_in(coded.dictionary, value_set=old))
                forms = pc.coalesce(found, coded.dictionary).take(coded.indices)
                joined = pc.binary_join(pa.ListArray.from_arrays(listed.offsets, forms), " ")
                block = block.set_column(number, name, joined)
        return block.drop_columns(["_block"])

    blocks = stage(_in_blocks(texts, columns), "blocks")
    places = _block_terms(blocks, columns).groupBy("term").agg(F.collect_set("_block").alias("_blocks"))
    changed = (
        normal_forms(places, stem, lemmas)
        .filter(F.col("normal") != F.col("term"))
        .select(F.explode("_blocks").alias("_block"), "term", "normal")
    )
    return (
        blocks.groupBy("_block")
        .cogroup(changed.groupBy("_block"))
        .applyInArrow(rewritten, texts.schema)
    )


def _summary(posts: DataFrame, kept: int) -> DataFrame:
    """``(term, n, missed)``: per task at most ``kept`` terms with counts, and what any count may miss.

    After each batch the counts beyond the ``kept`` largest are taken off: the next largest is subtracted
    from all, as in the summary of Misra and Gries, and added to ``missed``, which stands in a row without
    a term.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        missed = 0
        for batch in batches:
            counts.update(batch.column(0).flatten().to_pylist())
            if len(counts) > kept:
                over = sorted(counts.values(), reverse=True)[kept]
                missed += over
                counts = Counter({t: n - over for t, n in counts.items() if n > over})
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*counts, None], pa.string()),
                pa.array([*counts.values(), None], pa.int64()),
                pa.array([None] * len(counts) + [missed], pa.int64()),
            ],
            ["term", "n", "missed"],
        )

    return posts.select("words").filter("words IS NOT NULL").mapInArrow(
        summarise, "term string, n long, missed long"
    )


def vocabulary_by_summary(posts: DataFrame, size: int = 1000, kept: int | None = None) -> DataFrame:
    """``vocabulary`` of ``posts.words``, without shuffling a row for every distinct term.

    A first pass sends at most ``kept`` terms per task, by default sixteen times ``size``.  Their counts
    are too small by ``missed`` at most, over all tasks.  If the ``size``-th largest is above that, every
    term of the vocabulary is among them, and only terms that can reach it are counted, exactly, in a second
    pass.  Otherwise nothing is proven and all terms are counted.
    """
    kept = kept or 16 * size
    summary = stage(_summary(posts, kept), "summary")
    missed = summary.agg(F.sum("missed")).head()[0] or 0
    least = summary.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    least = stage(least, "least_counts")
    if not missed:  # no task had more terms than it kept: the counts are exact
        return vocabulary(least.withColumnRenamed("n", "total"), size)
    last = least.orderBy(F.desc("n")).limit(size).agg(F.min("n"), F.count("*")).head()
    counted = tokenize(posts)
    if last[1] == size and last[0] > missed:
        candidates = least.filter(F.col("n") + missed >= last[0]).select("term")
        counted = lookup_join(counted, candidates, "term", salt_by="post_id")
    return vocabulary(term_totals(counted), size)


def vocabulary(totals: DataFrame, size: int = 1000) -> DataFrame:
    """``(term, total, term_idx)``: the ``size`` most frequent terms, numbered alphabetically.

    Terms with equal totals are taken in alphabetical order.  The numbering window sees at most
    ``size`` rows.
    """
    top = totals.orderBy(F.desc("total"), "term").limit(size)
    position = F.row_number().over(Window.orderBy("term")) - 1
    return top.select("term", "total", position.cast("int").alias("term_idx"))
