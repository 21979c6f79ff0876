from __future__ import annotations

import math
import random
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagloom.operators import terms as TM
from tagloom.operators import vectors as V
from tagloom.operators.posts import preprocess_text
from tagloom.plans import (
    detect_communities,
    fit_post_vectors,
    fit_tag_vectors,
    load_model,
    save_model,
)
from tagloom.sources import (
    POSTS_SCHEMA,
    TAGS_SCHEMA,
    WIKI_SCHEMA,
    load_tag_dim,
    load_vectors,
    make_corpus,
    new_location,
    save_tag_dim,
    save_vectors,
    scratch_space,
    shared_dir,
)

WORDS = "apple apples banana bananas cherry running runs run quick quicker zebra".split()


def random_posts(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.choice(WORDS) for _ in range(rng.randrange(0, 12))]) for i in range(n)]


def brute_force(posts, size):
    """Terms and unit vectors by the textbook formulas."""
    totals = Counter(w for _, words in posts for w in words)
    terms = sorted(sorted(totals, key=lambda t: (-totals[t], t))[:size])
    position = {t: i for i, t in enumerate(terms)}
    df = Counter(t for _, words in posts for t in set(words) if t in position)
    vectors = {}
    for post, words in posts:
        tf = Counter(w for w in words if w in position)
        weights = {
            position[t]: c * (math.log((1 + len(posts)) / (1 + df[t])) + 1) for t, c in tf.items()
        }
        length = math.sqrt(sum(w * w for w in weights.values()))
        vectors[post] = {i: w / length for i, w in weights.items()}
    return terms, vectors


def as_dicts(packed):
    rows = packed.collect()
    return {r["post_id"]: dict(zip(r["term_idx"], r["value"], strict=True)) for r in rows}


@pytest.mark.parametrize("size", [3, 1000])
def test_post_vectors_match_brute_force(spark, size):
    posts = random_posts()
    df = spark.createDataFrame(posts, "post_id bigint, words array<string>").repartition(3)
    model = fit_post_vectors(df, feature_size=size)
    terms, want = brute_force(posts, size)
    got = as_dicts(model.posts)
    assert list(model.vocabulary.terms) == terms and got.keys() == want.keys()
    for post in want:
        assert got[post] == pytest.approx(want[post])
        if got[post]:
            assert sum(w * w for w in got[post].values()) == pytest.approx(1)


STEM_OF = {"apples": "appl", "apple": "appl", "bananas": "banana", "cherry": "cherri"}
STEM_OF |= {"running": "run", "runs": "run"}


def test_stems_and_lemmas_change_the_terms(spark):
    posts = random_posts(seed=2)
    df = spark.createDataFrame(posts, "post_id bigint, words array<string>")
    stemmed = [(i, [STEM_OF.get(w, w) for w in words]) for i, words in posts]
    terms, want = brute_force(stemmed, 4)
    model = fit_post_vectors(df, feature_size=4, stem=True)
    assert list(model.vocabulary.terms) == terms
    assert as_dicts(model.posts) == {p: pytest.approx(v) for p, v in want.items()}

    lemma_of = {"quicker": "quick", "run": "go"}
    lemmas = spark.createDataFrame(list(lemma_of.items()), "term string, lemma string")
    both = [(i, [lemma_of.get(w, w) for w in words]) for i, words in stemmed]
    model = fit_post_vectors(df, feature_size=5, stem=True, lemmas=lemmas)
    terms, want = brute_force(both, 5)
    assert list(model.vocabulary.terms) == terms
    assert as_dicts(model.posts) == {p: pytest.approx(v) for p, v in want.items()}


def test_many_forms_are_counted_by_join_with_the_same_result(spark):
    df = spark.createDataFrame(random_posts(seed=4), "post_id bigint, words array<string>")
    vocab = V.fit_vocabulary(df, 4, stem=True)
    in_row = as_dicts(V.count_vectors(df, vocab))
    joined = as_dicts(V.count_vectors(df, vocab, max_forms=2))
    assert joined == in_row and any(not v for v in joined.values())


def test_both_ways_of_counting_allow_repeated_ids(spark):
    posts = [(1, ["run", "runs"]), (1, ["run"]), (1, ["run"]), (2, ["run"]), (2, []), (None, ["run"])]
    df = spark.createDataFrame(posts, "post_id bigint, words array<string>")
    vocab = V.fit_vocabulary(df, 4, stem=True)

    def rows(packed):
        found = packed.select("post_id", "term_idx", "value").collect()
        return sorted((r["post_id"] or 0, list(r["term_idx"]), list(r["value"])) for r in found)

    in_row = rows(V.count_vectors(df, vocab))
    assert in_row == rows(V.count_vectors(df, vocab, max_forms=1))
    assert [v for _, _, v in in_row] == [[1.0], [1.0], [1.0], [2.0], [], [1.0]]


def test_idf_is_a_column(spark):
    df = spark.createDataFrame([(1, ["aa", "bb"]), (2, ["aa"])], "post_id bigint, words array<string>")
    idf = fit_post_vectors(df).idf.orderBy("term_idx").collect()
    assert [(r["term"], r["term_idx"], r["df"]) for r in idf] == [("aa", 0, 2), ("bb", 1, 1)]
    assert [r["idf"] for r in idf] == pytest.approx([1.0, math.log(3 / 2) + 1])


def test_words_are_rewritten_in_place(spark):
    texts = [(1, "cats running cats", None), (1, "cats running cats", None), (2, "", "dogs"), (3, "a b", "")]
    df = spark.createDataFrame(texts, "post_id bigint, body string, title string")
    # Of two lemmas of a word the alphabetically first counts.
    lemmas = spark.createDataFrame([("cat", "feline"), ("cat", "zz")], "term string, lemma string")
    got = TM.normal_text(df, ["title", "body"], stem=True, lemmas=lemmas)
    assert got.columns == df.columns
    first = (1, "feline run feline", "")
    assert sorted(tuple(r) for r in got.collect()) == [first, first, (2, "", "dog"), (3, "a b", "")]
    assert TM.normal_text(df.limit(0), ["body"], lemmas=lemmas).count() == 0


def test_words_are_rewritten_block_by_block(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(300)] + ["ünï", "x" * 400]
    lemmas = {n: rng.choice([n.upper(), "", "two words"]) for n in names[::3]}
    spaced = lambda: rng.choice(["", " "]) + rng.choice([" ", "  "]).join(rng.choices(names, k=rng.randint(0, 80)))
    texts = [(i, rng.choice([None, "", " ", spaced(), spaced(), spaced()]), spaced()) for i in range(300)]
    df = spark.createDataFrame(texts, "post_id bigint, title string, body string").repartition(3)
    table = spark.createDataFrame(list(lemmas.items()), "term string, lemma string")

    def brute(text):
        return " ".join(lemmas.get(w, w) for w in (text or "").split(" ") if w)

    expected = {(i, brute(title), brute(body)) for i, title, body in texts}
    for size in (1, 2000, 1 << 22):
        monkeypatch.setattr(TM, "BLOCK_BYTES", size, raising=False)
        with scratch_space(spark) as folder:
            got = TM.normal_text(df, ["title", "body"], stem=False, lemmas=table)
            assert {tuple(r) for r in got.collect()} == expected
            # What is staged has a row for each text, none for each word.
            local = Path(folder.removeprefix("file:"))
            staged = [p for p in local.glob("*/*") if p.parent.name != "checkpoints"]
            assert sum(spark.read.parquet(str(p)).count() for p in staged) == len(texts)


def test_preprocessed_posts_make_no_row_for_every_word(spark):
    text = "<p>The dogs &amp; the cats were running, all %d of them</p>"
    rows = [(i, text % i if i % 9 else None, f"Cats {i}", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "post_id bigint, body string, title string, score int")
    lemmas = spark.createDataFrame([("cat", "feline")], "term string, lemma string")
    with scratch_space(spark) as folder:
        got = preprocess_text(df, stem=True, lemmas=lemmas)
        expected = {(i, f"dog feline run {i}", f"feline {i}", 1) for i in range(200) if i % 9}
        assert got.columns == df.columns and {tuple(r) for r in got.collect()} == expected
        local = Path(folder.removeprefix("file:"))
        staged = [p for p in local.glob("*/*") if p.parent.name != "checkpoints"]
        assert sum(spark.read.parquet(str(p)).count() for p in staged) == len(expected)


def test_scratch_space_leaves_nothing_behind(spark, tmp_path):
    with scratch_space(spark) as folder:
        model = fit_tag_vectors(small_corpus(spark), stem=False)
        assert detect_communities(model.vectors, model.tags, min_similarity=0.5).count() == 3
        save_model(model, str(tmp_path / "model"))
        local = Path(folder.removeprefix("file:"))
        assert local.is_dir() and any(local.rglob("*.parquet")) and any(local.rglob("rdd-*"))
    assert not local.exists()
    assert load_model(spark, str(tmp_path / "model")).tags.count() == 3
    assert not new_location(spark, "t").startswith(folder)


def test_empty_corpus_and_words_outside_the_vocabulary(spark):
    none = spark.createDataFrame([], "post_id bigint, words array<string>")
    assert fit_post_vectors(none).posts.count() == 0
    blank = spark.createDataFrame([(1, [])], "post_id bigint, words array<string>")
    assert as_dicts(fit_post_vectors(blank).posts) == {1: {}}
    df = spark.createDataFrame(
        [(1, ["aa", "aa"]), (2, ["bb"])], "post_id bigint, words array<string>"
    )
    assert as_dicts(fit_post_vectors(df, feature_size=1).posts) == {1: {0: 1.0}, 2: {}}


def test_vocabulary_breaks_ties_by_term(spark):
    totals = spark.createDataFrame(
        [("d", 1), ("c", 5), ("b", 1), ("a", 1)], "term string, total bigint"
    )
    got = [tuple(r) for r in TM.vocabulary(totals, 3).orderBy("term_idx").collect()]
    assert got == [("a", 1, 0), ("b", 1, 1), ("c", 5, 2)]


def small_corpus(spark):
    posts = [
        (1, "one", "apple banana", "a|b", None, 1),
        (2, "two", "apple apple", "a|a", None, 2),
        (3, "three", "cherry", "b", None, 1),
        (4, "four", "durian", "c", None, 0),
        (5, "five", "x", "b|gone", None, 7),
    ]
    tags = [(i, n, 1, None, None) for i, n in ((10, "a"), (20, "b"), (30, "c"), (40, "never"))]
    wiki = spark.createDataFrame([(9, "apple")], WIKI_SCHEMA)
    return make_corpus(
        spark.createDataFrame(posts, POSTS_SCHEMA),
        spark.createDataFrame(tags, TAGS_SCHEMA),
        wiki,
        wiki,
    )


def test_tag_vectors_are_means_with_multiplicity(spark):
    model = fit_tag_vectors(small_corpus(spark), stem=False)
    _, posts = brute_force(
        [(1, ["apple", "banana"]), (2, ["apple"] * 2), (3, ["cherry"]), (5, [])], 1000
    )
    want = defaultdict(float)
    # Tag a: post 1 once and post 2 twice. Tag b: posts 1, 3 and 5, the last without any term.
    for tag, members in ((10, [1, 2, 2]), (20, [1, 3, 5])):
        for post in members:
            for term, weight in posts[post].items():
                want[tag, term] += weight / len(members)
    got = {(r["tag_id"], r["term_idx"]): r["weight"] for r in model.vectors.collect()}
    assert got == pytest.approx(dict(want))
    # Tag c has posts, but none in the corpus; a tag nobody uses is no tag of the model.
    assert sorted(tuple(r) for r in model.tags.collect()) == [
        (10, "a", 3),
        (20, "b", 3),
        (30, "c", 0),
    ]


def test_index_join_gives_the_same_tag_vectors(spark):
    posts = spark.createDataFrame(random_posts(seed=5), "post_id bigint, words array<string>")
    model = fit_post_vectors(posts)
    index = posts.select((F.col("post_id") % 7).alias("tag_id"), "post_id")
    index = index.unionByName(index.filter("post_id % 3 = 0"))
    tagged = model.posts.join(index, "post_id")
    direct = V.vectors_of(V.mean_by_tag(V.sum_by_tag(tagged, "tag_id")))
    key = ["tag_id", "term_idx"]
    one = direct.orderBy(key).collect()
    two = V.tag_vectors(index, model.posts).orderBy(key).collect()
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in two])


def test_stores_give_back_what_they_got(spark):
    vectors = spark.createDataFrame(
        [(1, 0, 0.1), (2, 5, 1 / 3)], "tag_id bigint, term_idx int, weight double"
    )
    path = new_location(spark, "v")
    save_vectors(vectors, path)
    assert sorted(load_vectors(spark, path).collect()) == sorted(vectors.collect())
    tags = spark.createDataFrame([(7, "x")], "tag_id bigint, tag_name string")
    path = new_location(spark, "d")
    save_tag_dim(tags, path)
    assert [tuple(r) for r in load_tag_dim(spark, path).collect()] == [(7, "7", "x")]


def test_staging_uses_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    where = new_location(spark, "t")
    assert where.startswith((named or shared_dir(spark)).rstrip("/") + "/")
    assert where != new_location(spark, "t")


@pytest.mark.parametrize("kept", [8, 20, 1000])
def test_vocabulary_by_summary_is_the_vocabulary(spark, kept):
    rng = random.Random(kept)
    names = [f"t{i:03d}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, rng.choices(names, weights, k=rng.randint(0, 40))) for i in range(600)] + [(601, None)]
    posts = spark.createDataFrame(rows, "post_id bigint, words array<string>").repartition(5)
    for size in (1, 5, 400):
        expected = TM.vocabulary(TM.term_totals(TM.tokenize(posts)), size).collect()
        assert sorted(TM.vocabulary_by_summary(posts, size, kept).collect()) == sorted(expected)
    flat = spark.createDataFrame([(i, [f"u{i}"]) for i in range(500)], "post_id bigint, words array<string>")
    assert sorted(TM.vocabulary_by_summary(flat, 5, 8).collect()) == sorted(TM.vocabulary(TM.term_totals(TM.tokenize(flat)), 5).collect())
    summary = TM._summary(posts, 8).filter("term IS NOT NULL")
    assert summary.count() <= 8 * posts.rdd.getNumPartitions() + 8
