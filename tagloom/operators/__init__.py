from tagloom.operators.graph import (
    TagGraph,
    community_summary,
    complete_components,
    complete_edges,
    complete_label_propagation,
    connected_components,
    dangling_edges,
    label_propagation,
    similarity_edges,
    tag_graph,
)
from tagloom.operators.joins import hot_keys, is_small, lookup_join, salted_join
from tagloom.operators.lemmas import lemmas_by_rules
from tagloom.operators.postings import (
    bitmap_postings,
    decode_postings,
    posting_counts,
    postings_in_corpus,
)
from tagloom.operators.posts import (
    build_post_text,
    corpus_counts,
    drop_untitled,
    min_score,
    nonblank_text,
    preprocess_text,
    tagged_posts,
    training_posts,
)
from tagloom.operators.sentences import (
    abbreviation_scores,
    abbreviations,
    sentence_starters,
    starter_scores,
    type_counts,
    word_tokens,
)
from tagloom.operators.similarity import (
    close_pairs,
    cosine_pairs,
    pairwise_cosine,
    similar_tags,
    similar_tags_all,
    similarities_to,
)
from tagloom.operators.tags import (
    build_tag_post,
    decode_post_ids,
    encode_post_ids,
    explode_tags,
    in_corpus,
    split_tags,
    tag_index,
    tag_post_lists,
    used_tags,
)
from tagloom.operators.terms import (
    normal_forms,
    term_frequencies,
    term_totals,
    tokenize,
    vocabulary,
    vocabulary_by_summary,
    with_words,
)
from tagloom.operators.vectors import (
    Vocabulary,
    count_vectors,
    coverage,
    fit_vocabulary,
    long_form,
    mean_by_tag,
    smooth_idf,
    sum_by_tag,
    tag_vectors,
    tfidf,
    unit_length,
    vectors_of,
)

__all__ = [
    "TagGraph",
    "Vocabulary",
    "abbreviation_scores",
    "abbreviations",
    "bitmap_postings",
    "build_post_text",
    "build_tag_post",
    "close_pairs",
    "community_summary",
    "complete_components",
    "complete_edges",
    "complete_label_propagation",
    "connected_components",
    "corpus_counts",
    "cosine_pairs",
    "count_vectors",
    "coverage",
    "dangling_edges",
    "decode_post_ids",
    "decode_postings",
    "drop_untitled",
    "encode_post_ids",
    "explode_tags",
    "fit_vocabulary",
    "hot_keys",
    "in_corpus",
    "is_small",
    "label_propagation",
    "lemmas_by_rules",
    "long_form",
    "lookup_join",
    "mean_by_tag",
    "min_score",
    "nonblank_text",
    "normal_forms",
    "pairwise_cosine",
    "posting_counts",
    "postings_in_corpus",
    "preprocess_text",
    "salted_join",
    "sentence_starters",
    "similar_tags",
    "similar_tags_all",
    "similarities_to",
    "similarity_edges",
    "smooth_idf",
    "split_tags",
    "starter_scores",
    "sum_by_tag",
    "tag_graph",
    "tag_index",
    "tag_post_lists",
    "tag_vectors",
    "tagged_posts",
    "term_frequencies",
    "term_totals",
    "tfidf",
    "tokenize",
    "training_posts",
    "type_counts",
    "unit_length",
    "used_tags",
    "vectors_of",
    "vocabulary",
    "vocabulary_by_summary",
    "with_words",
    "word_tokens",
]
