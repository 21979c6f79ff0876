"""Lemmas by detachment rules and a dictionary, per distinct term.

A form that the dictionary knows is a lemma of a term if it is the term itself or comes out of it by replacing
an ending.  Listed exceptions go first.  Where no form is known, the rules are applied to the forms again;
of the known forms of one round the shortest wins.  Terms and forms are joined as distinct rows, so the
work grows with the vocabulary, not with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.joins import lookup_join
from tagloom.sources.staging import stage

# The endings of English nouns that WordNet's morphology detaches, and what takes their place.
NOUN_RULES = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)


def detached(form: Column, rules: Sequence[tuple[str, str]] = NOUN_RULES) -> Column:
    """The forms that each rule makes of ``form``, without empty ones."""
    made = [
        F.when(
            form.endswith(old),
            F.concat(F.substring(form, F.lit(1), F.length(form) - len(old)), F.lit(new)),
        )
        for old, new in rules
    ]
    return F.array_distinct(F.filter(F.array(*made), lambda f: f.isNotNull() & (f != "")))


def lemmas_by_rules(
    terms: DataFrame,
    dictionary: DataFrame,
    exceptions: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = NOUN_RULES,
) -> DataFrame:
    """``(term, lemma)`` of the ``terms (term)`` that have a lemma; others stay as they are.

    ``dictionary`` has the known forms in ``form``.  A term of ``exceptions (term, lemma)`` has the
    shortest of itself and its listed lemmas that the dictionary knows, and no other.  Of equally short forms the
    alphabetically first wins.  The number of rounds is that of endings that can be detached in turn.
    Every rule should shorten a form or end in what no rule detaches.
    """
    known = stage(dictionary.select("form").filter("form IS NOT NULL").distinct(), "dictionary")
    asked = terms.select("term").filter("term IS NOT NULL").distinct()
    answers = []
    if exceptions is None:
        first = asked.select("term", F.lit(None).cast("array<string>").alias("_listed"))
    else:
        listed = exceptions.groupBy("term").agg(F.collect_set("lemma").alias("_listed"))
        first = asked.join(listed, "term", "left")
    itself = F.array("term")
    forms = F.when(F.col("_listed").isNull(), F.array_union(itself, detached(F.col("term"), rules)))
    forms = forms.otherwise(F.array_union(itself, F.coalesce("_listed", itself)))
    tried = first.select("term", F.col("_listed").isNotNull().alias("_only"), F.explode(forms).alias("form"))
    while True:
        tried = stage(tried, "forms")
        best = F.min(F.struct(F.length("form").alias("n"), "form"))
        found = stage(
            lookup_join(tried, known, "form", salt_by="term").groupBy("term").agg(best.alias("best")),
            "lemmas",
        )
        answers.append(found.select("term", F.col("best.form").alias("lemma")))
        rest = tried.filter("NOT _only").join(found.select("term"), "term", "left_anti")
        following = rest.filter(F.col("form") != F.col("term")).select(
            "term", "_only", F.explode(detached(F.col("form"), rules)).alias("form")
        )
        tried = following.distinct()
        if tried.isEmpty():
            break
    out = answers[0]
    for answer in answers[1:]:
        out = out.unionByName(answer)
    return out
