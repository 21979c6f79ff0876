from tagloom.functions.cleaning import (
    ascii_fold,
    clean_text,
    clean_tokens,
    decode_entities,
    drop_stopwords,
    kept_words,
    normalize_text,
    strip_markup,
    strip_punctuation,
    strip_urls,
    tokens,
    words,
)
from tagloom.functions.sql import create_functions
from tagloom.functions.stemming import stem_text, stem_word, stem_words
from tagloom.functions.wordlists import ENGLISH_STOP_WORDS, HTML_ENTITIES

__all__ = [
    "ENGLISH_STOP_WORDS",
    "HTML_ENTITIES",
    "ascii_fold",
    "clean_text",
    "clean_tokens",
    "create_functions",
    "decode_entities",
    "drop_stopwords",
    "kept_words",
    "normalize_text",
    "stem_text",
    "stem_word",
    "stem_words",
    "strip_markup",
    "strip_punctuation",
    "strip_urls",
    "tokens",
    "words",
]
