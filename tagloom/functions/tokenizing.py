"""Sentences and word tokens as column expressions.

Words are split off as in the Penn Treebank: punctuation, brackets and quotes stand alone, a period only
at the end of a sentence, and contractions come apart.  Sentences are told by their last character, by what
follows, and by two lists: abbreviations, whose period ends no sentence by itself, and words that often
begin one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.binding import let
from tagloom.functions.cleaning import SPACES

# The contractions that the Penn Treebank takes apart, with the length of their first part.
CONTRACTIONS = {
    "cannot": 3,
    "d'ye": 1,
    "gimme": 3,
    "gonna": 3,
    "gotta": 3,
    "lemme": 3,
    "more'n": 4,
    "'tis": 2,
    "'twas": 2,
    "wanna": 3,
}
#: Quotes and brackets that may follow the end of a sentence.
CLOSING = r"[)\"'\]}>]*"
#: What a type of word is stripped of at either end.
NOT_IN_TYPE = r"[^\p{L}\p{N}]"

# Pairs of pattern and replacement, in order; sentences are lines here.  A pattern starts with what it sets
# apart and looks around from there, so that most characters cost one comparison.
SPLITS = (
    (r"\"(?<![^ \n(\[{<]\")", " `` "),
    (r"[,:.;@#$%&?!](?:(?<=[;@#$%&?!])|(?<=[,:])(?![0-9])|(?<=\.)\.\.)", " $0 "),
    # The period that ends a sentence, a closing apostrophe, brackets, dashes.
    (
        r"[.'\[\](){}<>-](?:(?<=[\[\](){}<>])|(?<=[^.\n]\.)(?=[\])}>\"']* *(?:\n|\z))"
        r"|(?<=[^']')(?=[ \n]|\z|\.[\])}>\"']* *(?:\n|\z))|(?<=-)-)",
        " $0 ",
    ),
    (r"\"", " '' "),
    # A short ending may stand behind a long one, as in "he'll's".
    (
        r"['nN](?<=[^' \n].)(?:(?<=')[sSmMdD](?=[ \n]|\z)"
        r"|(?:(?<=')(?:ll|LL|re|RE|ve|VE)|(?<=n)'t|(?<=N)'T)(?=(?:'[sSmMdD])?(?:[ \n]|\z)))",
        " $0",
    ),
    # The first part of a contraction that is a whole token; only ASCII letters have those in lower case.
    (
        "(?i)[%s](?<![^ \\n].)(?:%s)"
        % (
            "".join(sorted({word[0] for word in CONTRACTIONS})),
            "|".join(
                rf"(?<={word[0]}){word[1:n]}(?={word[n:]}(?![^ \n]))" for word, n in CONTRACTIONS.items()
            ),
        ),
        "$0 ",
    ),
)


def raw_words(text: Column) -> Column:
    """The words of a text between white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def core(word: Column) -> Column:
    """A word in lower case without signs around it, but with its periods behind."""
    return F.lower(
        F.regexp_replace(word, rf"^{NOT_IN_TYPE}+|[^\p{{L}}\p{{N}}.]+\z", "")
    )


def has_period(word: Column) -> Column:
    """Whether the word ends in one period, signs aside; an ellipsis is none."""
    return core(word).rlike(r"[^.]\.\z")


def word_type(word: Column) -> Column:
    """The word as statistics count it: lower case, no signs around it, no periods behind."""
    return F.regexp_replace(core(word), r"[.]+\z", "")


def ends_open(word: Column) -> Column:
    """Whether a sentence may end with the word, if its period is not an abbreviation's."""
    return word.rlike(rf"[.?!]{CLOSING}\z")


def open_runs(words: Column) -> Column:
    """The words in runs, joined by spaces; all runs but the last end with a word that ``ends_open``."""
    ends = F.regexp_replace(F.array_join(words, " "), rf"([.?!]{CLOSING}) ", "$1\n")
    return F.split(ends, "\n")


def open_pairs(runs: Column) -> Column:
    """``(word, following)`` for each of ``open_runs``: its last word and the next run's first, null at the end."""

    def pair(run: Column, behind: Column) -> Column:
        word = F.substring_index(run, " ", -1).alias("word")
        return F.struct(word, F.substring_index(behind, " ", 1).alias("following"))

    return F.zip_with(runs, F.slice(runs, F.lit(2), F.size(runs)), pair)


def _upper_first(word: Column) -> Column:
    return word.rlike(rf"^{NOT_IN_TYPE}*\p{{Lu}}")


def boundary(word: Column, following: Column, abbreviations: Column, starters: Column) -> Column:
    """Whether a sentence ends between two words.

    ``?`` and ``!`` end one, an ellipsis does before a capital.  So does a single period, unless its type
    is among ``abbreviations`` or a single letter: then only before a capitalised word of ``starters``.
    """
    known = let(
        word_type(word),
        lambda t: F.array_contains(abbreviations, t) | ((F.length(t) == 1) & t.rlike(r"\p{L}")),
    )
    starts = _upper_first(following) & F.array_contains(starters, word_type(following))
    return (
        F.when(~ends_open(word), F.lit(False))
        .when(word.rlike(rf"[?!]{CLOSING}\z"), F.lit(True))
        .when(word.rlike(rf"\.\.{CLOSING}\z"), _upper_first(following))
        .otherwise(~known | starts)
    )


def sentence_lines(words: Column, abbreviations: Column, starters: Column) -> Column:
    """The words joined by spaces, with a line feed behind each sentence but the last."""

    def place(run: Column, pair: Column) -> Column:
        ends = boundary(pair["word"], pair["following"], abbreviations, starters)
        return F.when(pair["following"].isNull(), run).otherwise(
            F.concat(run, F.when(ends, F.lit("\n")).otherwise(F.lit(" ")))
        )

    # Only where a sentence may end is anything decided.
    return let(
        open_runs(words), lambda runs: F.array_join(F.zip_with(runs, open_pairs(runs), place), "")
    )


def treebank_tokens(lines: Column) -> Column:
    """The tokens of sentences that stand on lines of their own."""
    text = lines
    for pattern, replacement in SPLITS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.array_remove(F.split(text, "[ \n]+"), "")
