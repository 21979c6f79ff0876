"""The Porter stemmer as a chain of array transforms.

The steps follow M. F. Porter, "An algorithm for suffix stripping" (1980), with the published NLTK
extensions that are that library's default.  A step reads its word many times, so each one is its
own ``transform`` pass: the lambda variable is bound once and the expression stays linear in size.

Run it over distinct terms (``operators.terms.normal_forms``), never over every word of a corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is [C](VC){m}[V].  "y" is a vowel after a consonant and a consonant elsewhere, so a run of
# them alternates.  The consonants among them are written "Y" while the steps run: whether a letter is
# one depends on the letters before it alone, and no step changes those.
C = "[^aeiouy]"
V = "[aeiouy]"
M_GT_0 = f"^{C}*{V}+{C}"
M_EQ_1 = f"^{C}*{V}+{C}+{V}*$"
M_GT_1 = f"^{C}*{V}+{C}+{V}+{C}"
HAS_VOWEL = V
# Consonant-vowel-consonant at the end, the last not w, x or y; or a two-letter vowel-consonant.
CVC = f"{C}{V}[^aeiouywxY]$|^{V}{C}$"
# A consonant twice, l, s and z apart; of two "y" at the end the last may be the consonant.
DOUBLE = "(?:([^aeiouylsz])\\1|yY)$"

# The published suffix rules, in the order they are tried.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("bli", "ble"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
    ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
)
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)
# Words whose stem is listed instead of computed.
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}


def _cut(w: Column, n: int) -> Column:
    """``w`` without its last ``n`` characters."""
    return F.substring(w, F.lit(1), F.length(w) - n)


def _first_suffix(w: Column, rules, otherwise: Column) -> Column:
    """The first listed suffix decides, whether or not its condition then holds."""
    branches = [
        (w.endswith(suffix), F.when(condition(_cut(w, len(suffix))), result).otherwise(w))
        for suffix, result, condition in rules
    ]
    chain = F.when(*branches[0])
    for branch in branches[1:]:
        chain = chain.when(*branch)
    return chain.otherwise(otherwise)


def _always(stem: Column) -> Column:
    return F.lit(True)


def _m_gt_0(stem: Column) -> Column:
    return stem.rlike(M_GT_0)


def _m_gt_1(stem: Column) -> Column:
    return stem.rlike(M_GT_1)


def _replaced(w: Column, rules, condition) -> list:
    return [
        (suffix, F.concat(_cut(w, len(suffix)), F.lit(new)), condition) for suffix, new in rules
    ]


def _step_1a(w: Column) -> Column:
    short_ies = w.endswith("ies") & (F.length(w) == 4)
    return F.when(short_ies, _cut(w, 1)).otherwise(
        _first_suffix(w, _replaced(w, STEP_1A, _always), w)
    )


def _step_1b(w: Column) -> Column:
    """``ed`` and ``ing`` leave the bare stem marked with "|" for the clean-up pass."""
    bare = [(s, F.concat(_cut(w, len(s)), F.lit("|")), HAS_VOWEL) for s in ("ed", "ing")]
    chain = (
        F.when(w.endswith("ied") & (F.length(w) == 4), _cut(w, 1))
        .when(w.endswith("ied"), _cut(w, 2))
        .when(w.endswith("eed"), F.when(_m_gt_0(_cut(w, 3)), _cut(w, 1)).otherwise(w))
    )
    for suffix, result, needed in bare:
        chain = chain.when(w.endswith(suffix) & _cut(w, len(suffix)).rlike(needed), result)
    return chain.otherwise(w)


def _step_1b_clean(w: Column) -> Column:
    stem = _cut(w, 1)
    return (
        F.when(~w.endswith("|"), w)
        .when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(DOUBLE), _cut(w, 2))
        .when(stem.rlike("(?:ll|ss|zz)$"), stem)
        .when(stem.rlike(M_EQ_1) & stem.rlike(CVC), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _step_1c(w: Column) -> Column:
    stem = _cut(w, 1)
    # The letter before the y must be a consonant, and not be the first letter.
    consonant_end = stem.rlike(f"{C}$") & (F.length(stem) > 1)
    return F.when(w.endswith("y") & consonant_end, F.concat(stem, F.lit("i"))).otherwise(w)


def _step_2_alli(w: Column) -> Column:
    stem = _cut(w, 4)
    return F.when(w.endswith("alli") & _m_gt_0(stem), F.concat(stem, F.lit("al"))).otherwise(w)


def _step_2(w: Column) -> Column:
    rules = _replaced(w, STEP_2, _m_gt_0)
    # For "logi" the "l" counts as part of the stem, so short stems such as "geo" qualify.
    logi = F.when(w.endswith("logi") & _m_gt_0(_cut(w, 3)), _cut(w, 1)).otherwise(w)
    return _first_suffix(w, rules, logi)


def _step_3(w: Column) -> Column:
    return _first_suffix(w, _replaced(w, STEP_3, _m_gt_0), w)


def _step_4(w: Column) -> Column:
    def condition(suffix: str):
        if suffix == "ion":
            return lambda stem: _m_gt_1(stem) & stem.rlike("[st]$")
        return _m_gt_1

    return _first_suffix(w, [(s, _cut(w, len(s)), condition(s)) for s in STEP_4], w)


def _step_5a(w: Column) -> Column:
    stem = _cut(w, 1)
    drop = _m_gt_1(stem) | (stem.rlike(M_EQ_1) & ~stem.rlike(CVC))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _step_5b(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("ll") & _m_gt_1(stem), stem).otherwise(w)


_STEPS = (
    lambda w: F.regexp_replace(F.regexp_replace(w, "(^|[aeiou])y", "$1Y"), "yy", "yY"),
    _step_1a,
    _step_1b,
    _step_1b_clean,
    _step_1c,
    _step_2_alli,
    _step_2,
    _step_3,
    _step_4,
    _step_5a,
    _step_5b,
    lambda w: F.translate(w, "Y", "y"),
)


def _listed_or(word: Column, computed: Column) -> Column:
    chain = F.when(F.length(word) <= 2, word)
    for form, stem in IRREGULAR.items():
        chain = chain.when(word == form, F.lit(stem))
    return chain.otherwise(computed)


def stem_words(array: Column) -> Column:
    """Stem every element of an array of lower-case words."""
    computed = reduce(lambda words, step: F.transform(words, step), _STEPS, array)
    return F.zip_with(array, computed, _listed_or)


def stem_word(word: Column) -> Column:
    """Stem one lower-case word."""
    return F.element_at(stem_words(F.array(word)), 1)


def stem_text(text: Column) -> Column:
    """Stem every word of a space-separated text, in place.

    Row-local, so it needs no shuffle, but it stems each occurrence anew; to count stems over a
    corpus use ``operators.terms.normal_forms``.
    """
    return F.array_join(stem_words(F.filter(F.split(text, " "), lambda w: w != "")), " ")
