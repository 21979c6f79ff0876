"""Word tokens, sentences and lemmas by rules against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tagloom.functions import tokenizing as TZ
from tagloom.functions.tokenizing import CONTRACTIONS, raw_words, sentence_lines, treebank_tokens
from tagloom.operators import sentences
from tagloom.operators.lemmas import NOUN_RULES, lemmas_by_rules

SPACE = "[\\x09-\\x0d\\x1c-\\x20]+"
CLOSE = "[)\"'\\]}>]*"


def core(word):
    return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+\Z", "", word).lower()


def kind(word):
    return core(word).rstrip(".")


def period(word):
    return bool(regex.search(r"[^.]\.\Z", core(word)))


def upper(word):
    return bool(regex.match(r"[^\p{L}\p{N}]*\p{Lu}", word))


def brute_boundary(word, following, short, starts):
    end = regex.search(rf"[.?!]{CLOSE}\Z", word)
    if not end:
        return False
    if end.group()[0] in "?!":
        return True
    if regex.search(rf"\.\.{CLOSE}\Z", word):
        return upper(following)
    abbreviated = kind(word) in short or regex.fullmatch(r"\p{L}", kind(word))
    return not abbreviated or (upper(following) and kind(following) in starts)


def brute_sentences(text, short, starts):
    words = [w for w in regex.split(SPACE, text or "") if w]
    out, current = [], []
    for i, word in enumerate(words):
        current.append(word)
        if i + 1 < len(words) and brute_boundary(word, words[i + 1], short, starts):
            out.append(" ".join(current))
            current = []
    return out + [" ".join(current)] if current else out


def brute_tokens(sentence):
    """Character by character: what stands alone, then quotes and apostrophes word by word."""
    s = regex.sub(r"(^|[ (\[{<])\"", r"\1 `` ", sentence)
    out = ""
    i = 0
    while i < len(s):
        if s[i] in ",:" and not s[i + 1 : i + 2].isdigit():
            out += f" {s[i]} "
        elif s[i : i + 3] == "...":
            out += " ... "
            i += 2
        elif s[i] in ";@#$%&":
            out += f" {s[i]} "
        else:
            out += s[i]
        i += 1
    final = regex.search(r"([^.])\.([\])}>\"']*) *\Z", out)
    if final:
        out = out[: final.start()] + final.group(1) + " . " + final.group(2)
    out = regex.sub("[?!]", r" \g<0> ", out)
    out = regex.sub("([^'])'( |\\Z)", r"\1 ' \2", out)
    out = regex.sub(r"[\]\[(){}<>]", r" \g<0> ", out).replace("--", " -- ").replace('"', " '' ")
    tokens = []
    for word in out.split(" "):
        for ending in ("'s", "'m", "'d", "'S", "'M", "'D"):
            if word.endswith(ending) and len(word) > 2 and word[-3] != "'":
                word = word[:-2] + " " + word[-2:]
                break
        parts = word.split(" ")
        for ending in ("'ll", "'LL", "'re", "'RE", "'ve", "'VE", "n't", "N'T"):
            last = parts[-1]
            if last.endswith(ending) and len(last) > 3 and last[-4] != "'":
                parts[-1:] = [last[:-3], last[-3:]]
                break
        tokens += [p for p in parts if p]
    cut = []
    for t in tokens:
        n = CONTRACTIONS.get(t.lower())
        cut += [t[:n], t[n:]] if n else [t]
    return cut


KNOWN = {
    "They'll save and invest more.": "They 'll save and invest more .",
    "hi, my name can't hello,": "hi , my name ca n't hello ,",
    "Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\nThanks.": (
        "Good muffins cost $ 3.88 in New York . Please buy me two of them . Thanks ."
    ),
    '"We cannot," she said, "wanna go (now)..."': "`` We can not , '' she said , `` wan na go ( now ) ... ''",
    "It's 1,000 at 3:15: the dogs' -- ok?!": "It 's 1,000 at 3:15 : the dogs ' -- ok ? !",
    "'tis Mr. Smith": "'t is Mr. Smith",
}


def split(spark, texts, short=(), starts=()):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lists = [F.array(*(F.lit(x) for x in s)).cast("array<string>") for s in (short, starts)]
    lines = df.select("id", sentence_lines(raw_words(F.col("text")), *lists).alias("lines"))
    found = lines.select("id", "lines", treebank_tokens(F.col("lines")).alias("tokens")).collect()
    return {r.id: (r.lines, r.tokens) for r in found}


def test_known_sentences(spark):
    found = split(spark, list(KNOWN), short=["mr"])
    assert [" ".join(found[i][1]) for i in range(len(KNOWN))] == list(KNOWN.values())


def test_random_texts(spark):
    rng = random.Random(3)
    parts = ["dr.", "Dr.", "He", "he", "it's", "can't", "cannot", "end.", "end!\"", "(so", "well)...", "1,5", "a:b", "J.", "\"x", "y\"",
             "dogs'", "--", "we're", "é.", "Ü", "...", "?", "u.s.", "[z]", "gonna", ",", "$3", "O'Neil's", "N'T", "'", "x..", "\u2028q."]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["", None, " ", "word " * 3000 + "end."]
    short, starts = {"dr", "u.s"}, {"he", "it's"}
    found = split(spark, texts, sorted(short), sorted(starts))
    for i, text in enumerate(texts):
        expected = brute_sentences(text, short, starts)
        assert found[i][0] == "\n".join(expected), text
        assert found[i][1] == [t for s in expected for t in brute_tokens(s)], text


#: One pass for each rule, in order.
PASSES = (
    (r'(^|[ \n(\[{<])"', r"\1 `` "),
    (r"[,:](?![0-9])", r" \g<0> "),
    (r"\.\.\.", " ... "),
    (r"[;@#$%&]", r" \g<0> "),
    (r"([^.\n])\.([\])}>\"']*) *(\n|\Z)", r"\1 . \2\3"),
    (r"[?!]", r" \g<0> "),
    (r"([^'])'( |\n|\Z)", r"\1 ' \2"),
    (r"[\]\[(){}<>]", r" \g<0> "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"([^' \n])('[sSmMdD])( |\n|\Z)", r"\1 \2\3"),
    (r"([^' \n])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)( |\n|\Z)", r"\1 \2\3"),
)


def test_joined_passes_give_what_single_ones_give(spark):
    rng = random.Random(9)
    parts = ["'", "'", "''", "s", "ll", "n't", "N'T", "'VE", "n", ".", ".", "...", "?", ")", "(", "]", '"', '"', " ", " ", "\n", "--", ",",
             "1", "é", "\U0001f600", "cannot", "d'ye", "'tis", "GIMME", "more'n", "x'.", "'.)"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += ["x'.", "he'll's", "a'.') ", "....''", "a' '", ".N'T's'"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for i, tokens in df.select("id", treebank_tokens(F.col("text"))).collect():
        out = texts[i]
        for pattern, new in PASSES:
            out = regex.sub(pattern, new, out)
        cut = []
        for t in regex.split("[ \n]+", out):
            n = CONTRACTIONS.get(t.lower(), 0)
            cut += [x for x in (t[:n], t[n:]) if x]
        assert tokens == cut, texts[i]


def test_work_is_done_at_possible_ends_only(spark):
    texts = ["", None, " a  b ", "a. b?) c", "x... y.' z. ", "dr. who (ok.) . ?", "a.b c\u2028. d"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = df.select("id", TZ.open_runs(raw_words(F.col("text"))).alias("runs")).collect()
    for i, runs in made:
        words = [w for w in regex.split(SPACE, texts[i] or "") if w]
        ends = [j for j, w in enumerate(words[:-1]) if regex.search(rf"[.?!]{CLOSE}\Z", w)]
        cuts = [0, *(j + 1 for j in ends), len(words)]
        assert runs == [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])], texts[i]
    # No function is called for every token.
    tokens = df.select(treebank_tokens(F.col("text")))
    assert "lambda" not in tokens._jdf.queryExecution().optimizedPlan().toString()


def corpus(rng):
    names = ["alpha", "beta", "gamma", "delta"]
    texts = []
    for _ in range(400):
        words = [rng.choice(["dr.", "approx."]) if rng.random() < 0.1 else rng.choice(names) for _ in range(30)]
        texts.append(" ".join([*words, "alpha"]) + ". However " + " ".join(words[:9]) + "! Then e.g. " + rng.choice(names) + ".")
    return texts


def test_statistics(spark):
    texts = corpus(random.Random(5))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    counts = sentences.type_counts(df).cache()
    uses, dotted = Counter(), Counter()
    for t in texts:
        for w in t.split():
            uses[kind(w)] += 1
            dotted[kind(w)] += period(w)
    assert {r.type: (r.n, r.n_period) for r in counts.collect()} == {k: (uses[k], dotted[k]) for k in uses}
    chance = sum(dotted.values()) / sum(uses.values())
    expected = {}
    for k, n in dotted.items():
        if n:
            without = uses[k] - n
            chances = n * math.log(chance) + (without * math.log(1 - chance) if without else 0)
            ratio = -2 * (chances - n * math.log(0.99) - without * math.log(0.01))
            letters = len(k.replace(".", ""))
            expected[k] = ratio * math.exp(-letters) * (k.count(".") + 1) * letters**-without
    found = {r.type: r.score for r in sentences.abbreviation_scores(counts).collect()}
    assert found == pytest.approx(expected)
    short = sentences.abbreviations(counts)
    known = {r.type for r in short.collect()}
    assert {"dr", "e.g"} <= known and not known & {"alpha", "beta", "gamma", "delta"}
    scores = sentences.starter_scores(df, counts, short)
    starts = {r.type for r in sentences.sentence_starters(scores).collect()}
    assert starts == {"however", "then"}
    made = {r.text: (r.sentences, r.tokens) for r in sentences.word_tokens(df, short, sentences.sentence_starters(scores)).collect()}
    assert made[None] == ("", []) and made[""] == ("", [])
    for t in texts[:50]:
        lines = brute_sentences(t, known, starts)
        assert made[t] == ("\n".join(lines), [x for s in lines for x in brute_tokens(s)])


def brute_lemma(term, known, exceptions):
    if term in exceptions:
        hits = [f for f in {term, *exceptions[term]} if f in known]
        return min(hits, key=lambda f: (len(f), f), default=None)
    apply = lambda forms: {f[: len(f) - len(a)] + b for f in forms for a, b in NOUN_RULES if f.endswith(a)} - {""}
    forms, first = apply({term}), {term}
    while forms or first:
        hits = [f for f in forms | first if f in known]
        if hits:
            return min(hits, key=lambda f: (len(f), f))
        forms, first = apply(forms - {term}), set()
    return None


def test_lemmas_by_rules(spark):
    rng = random.Random(6)
    ends = ["s", "ses", "ves", "xes", "zes", "ches", "shes", "men", "ies", "y", "man", "ss", "sss", "f", ""]
    terms = sorted({rng.choice(["bo", "wi", "s", "ca", "la", ""]) + rng.choice(ends) + rng.choice(ends) for _ in range(400)} - {""})
    known = set(rng.sample(terms, len(terms) // 4)) | {"bo", "wif", "boy", "man"}
    exceptions = {t: {rng.choice(terms), "nowhere"} for t in terms[::15]}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = [(t, x) for t, listed in exceptions.items() for x in listed]
    found = lemmas_by_rules(
        frame([(t,) for t in terms + terms[:5] + [None]], "term string"),
        frame([(f,) for f in known] + [("boy",), (None,)], "form string"),
        frame(rows, "term string, lemma string"),
    ).collect()
    expected = {t: brute_lemma(t, known, exceptions) for t in terms}
    assert len(found) == len({r.term for r in found})
    assert {r.term: r.lemma for r in found} == {t: f for t, f in expected.items() if f is not None}
    none = frame([], "term string")
    assert lemmas_by_rules(none, frame([("a",)], "form string")).count() == 0
