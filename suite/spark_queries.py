"""One registered query per operator, each over the whole given tables.

List columns are joined into strings and weights rounded, so that results compare by value;
similarities are rounded by the operators themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite import fixture
from tagloom import functions as TF
from tagloom.operators import (
    graph,
    lemmas,
    postings,
    posts,
    sentences,
    similarity,
    tags,
    terms,
    vectors,
)
from tagloom.plans import (
    TagModel,
    detect_communities,
    fit_post_vectors,
    fit_tag_vectors,
    load_model,
    save_model,
    staged,
)
from tagloom.sources import load_corpus as load_tables
from tagloom.sources import (
    CorpusConfig,
    cap_rows,
    load_keyed,
    load_tag_dim,
    load_vectors,
    new_location,
    save_keyed,
    save_tag_dim,
    save_vectors,
    stage,
    tag_dim,
)

QUERY_TAG = "en"
ORDER_TAG = "Brand#11"
MIN_SIMILARITY = 0.8
SCAN_LIMIT = 100
#: The cap of a trial run, which is what that query shows.
MAX_POSTS = 50
#: The cap of ``tag_graph``, which shows it.
COMPLETE_TAGS = 30

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and sinks


@query
def scan_posts(spark, sf_dir):
    return fixture.posts(spark, sf_dir)


@query
def scan_limited(spark, sf_dir):
    return cap_rows(fixture.posts(spark, sf_dir), SCAN_LIMIT)


@query
def load_corpus(spark, sf_dir):
    """The four corpus tables as files, read by the loader; their texts come back."""
    path = new_location(spark, "corpus")
    made = fixture.corpus(spark, sf_dir)
    for name in ("posts", "tags", "excerpts", "wikis"):
        getattr(made, name).write.parquet(f"{path}/{name}")
    files = (f"{path}/{name}" for name in ("posts", "tags", "excerpts", "wikis"))
    corpus = load_tables(spark, CorpusConfig(*files, fmt="parquet"))
    return posts.build_post_text(corpus.posts, corpus.excerpts, corpus.wikis, carry=["tags"])


@query
def vector_store_roundtrip(spark, sf_dir):
    path = new_location(spark, "vectors")
    save_vectors(_plain_tag_vectors(spark, sf_dir), path)
    return _rounded(load_vectors(spark, path), "weight")


@query
def tag_dim_store(spark, sf_dir):
    path = new_location(spark, "tag_dim")
    save_tag_dim(fixture.tag_table(spark, sf_dir).withColumnRenamed("id", "tag_id"), path)
    return load_tag_dim(spark, path)


QUERIES["tag_dim"] = lambda spark, sf_dir: tag_dim(
    fixture.tag_table(spark, sf_dir).withColumnRenamed("id", "tag_id")
)


# Filters


@query
def tagged_posts(spark, sf_dir):
    return posts.tagged_posts(fixture.posts(spark, sf_dir)).select("id", "tags", "score")


def _post_text(spark, sf_dir) -> DataFrame:
    corpus = fixture.corpus(spark, sf_dir)
    return posts.build_post_text(corpus.posts, corpus.excerpts, corpus.wikis)


@query
def drop_untitled(spark, sf_dir):
    return posts.drop_untitled(_post_text(spark, sf_dir)).select("post_id", "title", "score")


@query
def min_score(spark, sf_dir):
    return posts.min_score(_post_text(spark, sf_dir)).select("post_id", "title", "score")


@query
def nonblank_text(spark, sf_dir):
    return posts.nonblank_text(posts.preprocess_text(_post_text(spark, sf_dir))).select(
        "post_id", "title", "score"
    )


@query
def training_posts(spark, sf_dir):
    return posts.training_posts(_post_text(spark, sf_dir))


@query
def training_posts_capped(spark, sf_dir):
    return posts.training_posts(_post_text(spark, sf_dir), max_posts=MAX_POSTS)


@query
def corpus_semi_join(spark, sf_dir):
    corpus = fixture.corpus(spark, sf_dir)
    index = tags.tag_index(corpus.posts, corpus.tags)
    return tags.in_corpus(index, posts.training_posts(_post_text(spark, sf_dir))).select(
        "tag_id", "tag_name", "post_id"
    )


# Tag index and post text


@query
def split_tags(spark, sf_dir):
    split = fixture.corpus(spark, sf_dir).posts.select(
        "id", tags.split_tags(F.col("tags")).alias("tags")
    )
    return split.select(
        "id", F.size("tags").alias("n_tags"), F.array_join("tags", ",").alias("tags")
    )


@query
def explode_tags(spark, sf_dir):
    return tags.explode_tags(fixture.corpus(spark, sf_dir).posts)


@query
def tag_index(spark, sf_dir):
    corpus = fixture.corpus(spark, sf_dir)
    return tags.tag_index(corpus.posts, corpus.tags)


@query
def tag_post_lists(spark, sf_dir):
    lists = tags.tag_post_lists(tags.explode_tags(fixture.corpus(spark, sf_dir).posts))
    return lists.select(
        "tag_name",
        "chunk",
        F.size("post_ids").alias("n_posts"),
        tags.encode_post_ids(F.col("post_ids")).alias("post_ids"),
    )


def _postings(spark, sf_dir) -> DataFrame:
    corpus = fixture.corpus(spark, sf_dir)
    return postings.bitmap_postings(tags.tag_index(corpus.posts, corpus.tags))


@query
def tag_bitmaps(spark, sf_dir):
    """The tag index as bitmaps, decoded again: the rows of ``tag_index``."""
    return postings.decode_postings(stage(_postings(spark, sf_dir), "postings"))


@query
def tag_bitmap_counts(spark, sf_dir):
    return postings.posting_counts(_postings(spark, sf_dir))


@query
def tag_bitmaps_in_corpus(spark, sf_dir):
    """The rows of ``corpus_semi_join``, by the bits that tags and corpus have in common."""
    texts = posts.training_posts(_post_text(spark, sf_dir))
    inside = postings.postings_in_corpus(_postings(spark, sf_dir), texts)
    return postings.decode_postings(stage(inside, "postings"))


@query
def tag_post_ids_csv(spark, sf_dir):
    lists = tags.tag_post_lists(tags.explode_tags(fixture.corpus(spark, sf_dir).posts))
    return lists.select(
        "tag_name", "chunk", tags.encode_post_ids(F.col("post_ids")).alias("post_ids")
    )


@query
def decode_post_ids(spark, sf_dir):
    corpus = fixture.corpus(spark, sf_dir)
    encoded = tags.build_tag_post(corpus.posts, corpus.tags)
    return encoded.select(
        "tag_id", F.explode(tags.decode_post_ids(F.col("post_ids"))).alias("post_id")
    )


@query
def build_tag_post_df(spark, sf_dir):
    corpus = fixture.corpus(spark, sf_dir)
    return tags.build_tag_post(corpus.posts, corpus.tags)


@query
def build_post_text_df(spark, sf_dir):
    return _post_text(spark, sf_dir)


@query
def corpus_counts(spark, sf_dir):
    corpus = fixture.corpus(spark, sf_dir)
    return posts.corpus_counts(
        tags.used_tags(corpus.posts, corpus.tags), _post_text(spark, sf_dir)
    )


# Cleaning


def _document_text(spark, sf_dir, text) -> DataFrame:
    documents = fixture.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return documents.select("doc_id", text(F.col("text")).alias("text"))


def _page_text(spark, sf_dir, text) -> DataFrame:
    pages = fixture.table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return pages.select("page_id", text(F.concat_ws(" ", "html", "url")).alias("text"))


@query
def strip_markup(spark, sf_dir):
    return _page_text(spark, sf_dir, TF.strip_markup)


@query
def strip_punct(spark, sf_dir):
    return _document_text(spark, sf_dir, TF.strip_punctuation)


@query
def ascii_fold(spark, sf_dir):
    return _document_text(spark, sf_dir, TF.ascii_fold)


@query
def normalize_text(spark, sf_dir):
    return _document_text(spark, sf_dir, TF.normalize_text)


@query
def strip_urls(spark, sf_dir):
    return _page_text(spark, sf_dir, TF.strip_urls)


@query
def drop_stopwords(spark, sf_dir):
    return _document_text(spark, sf_dir, TF.drop_stopwords)


@query
def clean_text(spark, sf_dir):
    return _document_text(spark, sf_dir, TF.clean_text)


@query
def clean_text_sql(spark, sf_dir):
    """``clean_text`` as a SQL user writes it."""
    TF.create_functions(spark, prefix="tagloom_")
    documents = fixture.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return spark.sql(
        "SELECT doc_id, tagloom_clean_text(text) AS text FROM {documents}", documents=documents
    )


@query
def clean_pages_sql(spark, sf_dir):
    """``clean_pages`` as a SQL user writes it."""
    TF.create_functions(spark, prefix="tagloom_")
    pages = fixture.table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return spark.sql(
        "SELECT page_id, tagloom_clean_text(concat_ws(' ', html, url)) AS text FROM {pages}", pages=pages
    )


@query
def clean_pages(spark, sf_dir):
    return _page_text(spark, sf_dir, TF.clean_text)


@query
def preprocess_text(spark, sf_dir):
    return posts.preprocess_text(_post_text(spark, sf_dir))


def _cleaned_totals(documents: DataFrame) -> DataFrame:
    words = terms.with_words(
        documents.withColumnRenamed("doc_id", "post_id"), "text", cleaned=True
    )
    return terms.term_totals(terms.tokenize(words))


def _document_totals(spark, sf_dir) -> DataFrame:
    return _cleaned_totals(_document_text(spark, sf_dir, TF.clean_text))


@query
def stem_terms(spark, sf_dir):
    return terms.normal_forms(_document_totals(spark, sf_dir)).select("term", "total", "normal")


def _plurals(totals: DataFrame) -> DataFrame:
    """A lemma table found in the data: terms whose form without a final "s" is a term too."""
    singular = F.substring("term", F.lit(1), F.length("term") - 1)
    candidates = totals.filter(F.col("term").endswith("s")).select(
        "term", singular.alias("lemma")
    )
    return candidates.join(totals.select(F.col("term").alias("lemma")), "lemma", "left_semi")


@query
def clean_text_full(spark, sf_dir):
    """The whole cleaner: markup to stop words, then stems, then lemmas, word by word in place."""
    documents = stage(_document_text(spark, sf_dir, TF.clean_text), "cleaned")
    plurals = _plurals(stage(_cleaned_totals(documents), "totals"))
    return terms.normal_text(documents, ["text"], stem=True, lemmas=plurals)


@query
def preprocess_text_full(spark, sf_dir):
    plurals = _plurals(stage(_document_totals(spark, sf_dir), "totals"))
    return posts.preprocess_text(_post_text(spark, sf_dir), stem=True, lemmas=plurals)


@query
def lemma_terms(spark, sf_dir):
    totals = stage(_document_totals(spark, sf_dir), "totals")
    return terms.normal_forms(totals, stem=False, lemmas=_plurals(totals)).select(
        "term", "total", "normal"
    )


def _dictionary(totals: DataFrame) -> DataFrame:
    """Terms that occur at least twice."""
    return totals.filter("total >= 2").select(F.col("term").alias("form"))


def _exceptions(spark, sf_dir) -> DataFrame:
    """Words of the benchmark that end in ``e``, with what is left without it."""
    words = fixture.table(spark, sf_dir, "benchmark").select(
        F.explode(TF.tokens(F.col("text"))).alias("term")
    )
    shorter = F.substring("term", F.lit(1), F.length("term") - 1)
    return words.filter(F.col("term").endswith("e")).select("term", shorter.alias("lemma")).distinct()


@query
def rule_lemmas(spark, sf_dir):
    """Lemmas of all distinct words by detachment rules, exceptions and a dictionary."""
    totals = stage(_document_totals(spark, sf_dir), "totals")
    found = lemmas.lemmas_by_rules(totals, _dictionary(totals), _exceptions(spark, sf_dir))
    return terms.normal_forms(totals, stem=False, lemmas=found)


@query
def rule_lemmas_of_stems(spark, sf_dir):
    """The same after stemming: stems are looked up among the terms."""
    totals = stage(_document_totals(spark, sf_dir), "totals")
    stems = terms.normal_forms(totals).select(F.col("normal").alias("term"))
    found = lemmas.lemmas_by_rules(stems, _dictionary(totals), _exceptions(spark, sf_dir))
    return terms.normal_forms(totals, lemmas=found)


def _plain_texts(spark, sf_dir) -> DataFrame:
    return fixture.table(spark, sf_dir, "documents", ["doc_id", "text"])


@query
def abbreviation_scores(spark, sf_dir):
    counts = sentences.type_counts(_plain_texts(spark, sf_dir))
    return _rounded(sentences.abbreviation_scores(stage(counts, "types")), "score")


def _sentence_model(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Abbreviations of the documents, and the scores of sentence starters."""
    texts = _plain_texts(spark, sf_dir)
    counts = stage(sentences.type_counts(texts), "types")
    short = stage(sentences.abbreviations(counts), "abbreviations")
    return short, sentences.starter_scores(texts, counts, short)


@query
def sentence_starters(spark, sf_dir):
    return _rounded(_sentence_model(spark, sf_dir)[1], "score")


@query
def word_tokens(spark, sf_dir):
    """All documents in sentences and word tokens, by the statistics of the documents."""
    short, scores = _sentence_model(spark, sf_dir)
    made = sentences.word_tokens(
        _plain_texts(spark, sf_dir), short, sentences.sentence_starters(scores)
    )
    return made.select(
        "doc_id",
        F.when(F.col("sentences") == "", 0)
        .otherwise(F.size(F.split("sentences", "\n")))
        .alias("n_sentences"),
        F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", " ").alias("text"),
    )


# TF-IDF


def _documents(spark, sf_dir) -> DataFrame:
    documents = fixture.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return terms.with_words(documents.withColumnRenamed("doc_id", "post_id"), "text")


@query
def tokenize_docs(spark, sf_dir):
    return terms.tokenize(_documents(spark, sf_dir))


@query
def term_freq(spark, sf_dir):
    return terms.term_frequencies(terms.tokenize(_documents(spark, sf_dir)))


@query
def vocabulary(spark, sf_dir):
    return terms.vocabulary(terms.term_totals(terms.tokenize(_training_words(spark, sf_dir))))


@query
def vocabulary_by_summary(spark, sf_dir):
    """The same vocabulary from a bounded summary and an exact count of its candidates."""
    return terms.vocabulary_by_summary(stage(_training_words(spark, sf_dir), "words"))


def _training_words(spark, sf_dir) -> DataFrame:
    corpus = posts.training_posts(_post_text(spark, sf_dir))
    return terms.with_words(corpus.select("post_id", "body"), cleaned=True)


def _corpus_posts(spark, sf_dir) -> DataFrame:
    return stage(_training_words(spark, sf_dir), "training_posts")


@query
def smooth_idf(spark, sf_dir):
    model = fit_post_vectors(_corpus_posts(spark, sf_dir))
    return _rounded(model.idf.select("term", "term_idx", "idf"), "idf")


@query
def tfidf_raw(spark, sf_dir):
    corpus = _corpus_posts(spark, sf_dir)
    vocab = vectors.fit_vocabulary(corpus)
    counted = vectors.count_vectors(corpus, vocab)
    weighted = vectors.tfidf(counted, vectors.smooth_idf(counted, vocab))
    return _rounded(vectors.long_form(weighted), "weight")


@query
def tfidf_l2(spark, sf_dir):
    model = fit_post_vectors(_corpus_posts(spark, sf_dir))
    return _rounded(vectors.long_form(model.posts), "weight")


def _plain_tag_vectors(spark, sf_dir) -> DataFrame:
    """Tag vectors over unstemmed terms, through the general index join."""
    corpus = fixture.corpus(spark, sf_dir)
    model = fit_post_vectors(_corpus_posts(spark, sf_dir))
    return vectors.tag_vectors(tags.tag_index(corpus.posts, corpus.tags), model.posts)


@query
def tag_vectors(spark, sf_dir):
    return _rounded(_plain_tag_vectors(spark, sf_dir), "weight")


@query
def tag_vector_coverage(spark, sf_dir):
    return _model(spark, sf_dir).tags


def _model(spark, sf_dir) -> TagModel:
    return fit_tag_vectors(fixture.corpus(spark, sf_dir))


@query
def stemmed_vocabulary(spark, sf_dir):
    return _model(spark, sf_dir).terms


@query
def lemma_tag_vectors(spark, sf_dir):
    plurals = _plurals(stage(_document_totals(spark, sf_dir), "totals"))
    model = fit_tag_vectors(fixture.corpus(spark, sf_dir), stem=False, lemmas=plurals)
    return _rounded(model.vectors, "weight")


QUERIES["fit_tag_vectors"] = lambda spark, sf_dir: _rounded(
    _model(spark, sf_dir).vectors, "weight"
)


# Similarity


@query
def similar_tags(spark, sf_dir):
    model = _model(spark, sf_dir)
    return similarity.similar_tags(model.vectors, model.tags, QUERY_TAG)


@query
def similar_tags_ranking(spark, sf_dir):
    model = _model(spark, sf_dir)
    return similarity.similar_tags(model.vectors, model.tags, QUERY_TAG, k=None)


@query
def similar_tags_from_store(spark, sf_dir):
    path = new_location(spark, "model")
    save_model(_model(spark, sf_dir), path)
    model = load_model(spark, path)
    return similarity.similar_tags(model.vectors, model.tags, QUERY_TAG, include_self=False)


@query
def similar_tags_from_keyed_store(spark, sf_dir):
    """The ranking from a store in buckets: vectors meet their tags without a shuffle."""
    path = new_location(spark, "keyed")
    model = _model(spark, sf_dir)
    save_keyed(model.vectors, model.tags, path)
    stored_vectors, stored_tags = load_keyed(spark, path)
    return similarity.similar_tags(stored_vectors, stored_tags, QUERY_TAG)


@query
def similar_tags_all(spark, sf_dir):
    model = _model(spark, sf_dir)
    return similarity.similar_tags_all(model.vectors, model.tags)


@query
def pairwise_cosine(spark, sf_dir):
    model = _model(spark, sf_dir)
    return similarity.pairwise_cosine(model.vectors, model.tags)


@query
def pairwise_cosine_all(spark, sf_dir):
    """The matrix of as many tags as there are."""
    model = _model(spark, sf_dir)
    return similarity.pairwise_cosine(model.vectors, model.tags, model.tags.count())


@query
def similarity_edges(spark, sf_dir):
    model = _model(spark, sf_dir)
    return graph.similarity_edges(model.vectors, model.tags, MIN_SIMILARITY)


# Graph


def _graph(spark, sf_dir) -> graph.TagGraph:
    model = _model(spark, sf_dir)
    return staged(graph.tag_graph(model.vectors, model.tags, min_similarity=MIN_SIMILARITY))


@query
def tag_graph(spark, sf_dir):
    """The complete graph over the first ``COMPLETE_TAGS`` tags, as vertices with their edges."""
    model = _model(spark, sf_dir)
    complete = graph.tag_graph(
        model.vectors, model.tags, COMPLETE_TAGS, min_similarity=None
    )
    return complete.vertices.withColumnRenamed("id", "src").join(complete.edges, "src")


@query
def dangling_edges(spark, sf_dir):
    """All edges, checked against vertices that lack the language tags: those dangle."""
    whole = _graph(spark, sf_dir)
    named = whole.vertices.filter(F.col("name").contains("-"))
    return graph.dangling_edges(graph.TagGraph(named, whole.edges))


@query
def connected_components(spark, sf_dir):
    return graph.connected_components(_graph(spark, sf_dir))


@query
def components_with_dangling(spark, sf_dir):
    """Both algorithms on the graph of ``dangling_edges``: dangling edges connect nothing."""
    whole = _graph(spark, sf_dir)
    named = whole.vertices.filter(F.col("name").contains("-"))
    part = graph.TagGraph(named, whole.edges)
    labels = graph.label_propagation(part).select("id", "label")
    return graph.connected_components(part).join(labels, "id")


@query
def cc_count(spark, sf_dir):
    groups = graph.connected_components(_graph(spark, sf_dir))
    return groups.agg(F.countDistinct("component").alias("components"))


@query
def label_propagation(spark, sf_dir):
    return graph.label_propagation(_graph(spark, sf_dir))


@query
def lpa_count(spark, sf_dir):
    groups = graph.label_propagation(_graph(spark, sf_dir))
    return groups.agg(F.countDistinct("label").alias("labels"))


@query
def community_summary(spark, sf_dir):
    whole = _graph(spark, sf_dir)
    return graph.community_summary(
        graph.connected_components(whole), graph.label_propagation(whole)
    )


QUERIES["detect_communities"] = lambda spark, sf_dir: _communities(
    _model(spark, sf_dir)
)


def _communities(model: TagModel) -> DataFrame:
    return detect_communities(model.vectors, model.tags, min_similarity=MIN_SIMILARITY)


@query
def complete_graph_communities(spark, sf_dir):
    """Communities of the complete graph over all tags, from its vertices alone."""
    model = _model(spark, sf_dir)
    return detect_communities(model.vectors, model.tags, min_similarity=None)


@query
def complete_graph_communities_all(spark, sf_dir):
    """The same communities, from all edges."""
    model = _model(spark, sf_dir)
    whole = staged(
        graph.tag_graph(model.vectors, model.tags, model.tags.count(), min_similarity=None)
    )
    labels = graph.label_propagation(whole).select("id", "label")
    return graph.connected_components(whole).join(labels, "id")


# The same operators over orders: many short posts, few large tags


def _order_model(spark, sf_dir) -> TagModel:
    return fit_tag_vectors(fixture.order_corpus(spark, sf_dir), stem=False)


@query
def order_tag_vectors(spark, sf_dir):
    return _rounded(_order_model(spark, sf_dir).vectors, "weight")


@query
def order_similar_tags(spark, sf_dir):
    model = _order_model(spark, sf_dir)
    return similarity.similar_tags(model.vectors, model.tags, ORDER_TAG)
