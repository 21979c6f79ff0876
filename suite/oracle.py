"""DuckDB SQL for every registered query, over the given tables.

Statements are put together from common table expressions.  Regular expressions are written for
RE2, which has no possessive quantifiers and no back-references.
"""

from __future__ import annotations

from suite.spark_queries import (
    COMPLETE_TAGS,
    MAX_POSTS,
    MIN_SIMILARITY,
    ORDER_TAG,
    QUERY_TAG,
    SCAN_LIMIT,
)
from tagloom.functions.stemming import IRREGULAR, STEP_1A, STEP_2, STEP_3, STEP_4
from tagloom.functions.tokenizing import CONTRACTIONS
from tagloom.functions.wordlists import (
    C1_CONTROLS,
    C1_READ_AS,
    ENGLISH_STOP_WORDS,
    HTML_ENTITIES,
)
from tagloom.operators.lemmas import NOUN_RULES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Text expressions

WS = r"\x09-\x0d\x1c-\x20"
MARKUP = (
    r"(?is)<(?:!--.*?(?:-->|\z)|!\[CDATA\[(.*?)\]\]>"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|template\b[^>]*>.*?(?:</template\s*>|\z)"
    r"|/?[a-z](?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*>|/?[a-z][^>]*>|[!?][^>]*>)"
)
ENTITY_MAP = (
    "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in HTML_ENTITIES.items()) + "}"
)


def markup(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), {lit(MARKUP)}, '\\1', 'g')"
    ref = "regexp_extract(p, '^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9.-]*)')"
    rest = f"regexp_replace(p[length({ref}) + 1:], '^;', '')"
    number = (
        f"CASE WHEN regexp_matches({ref}, '^#[xX]') "
        f"THEN TRY_CAST('0x' || substr({ref}, 3) AS BIGINT) "
        f"ELSE TRY_CAST(substr({ref}, 2) AS BIGINT) END"
    )
    valid = f"({number} <= 1114111 AND NOT {number} BETWEEN 55296 AND 57343)"
    char = f"translate(chr(CAST({number} AS INTEGER)), {lit(C1_CONTROLS)}, {lit(C1_READ_AS)})"
    piece = (
        f"CASE WHEN {ref} = '' THEN '&' || p "
        f"WHEN {ref}[1] = '#' THEN (CASE WHEN {valid} THEN {char} ELSE chr(65533) END) || {rest} "
        f"ELSE coalesce({ENTITY_MAP}[{ref}], '&' || {ref}) || {rest} END"
    )
    return (
        f"array_to_string(list_transform(string_split({bare}, '&'), "
        f"lambda p, i: CASE WHEN i = 1 THEN p ELSE {piece} END), '')"
    )


def punct(x: str) -> str:
    return f"regexp_replace({x}, '[!-/:-@\\[-`{{-~]', '', 'g')"


def fold(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7f]', ' ', 'g')"


def urls(x: str) -> str:
    return f"regexp_replace({x}, 'http[^{WS}]+', '', 'g')"


def stops(x: str) -> str:
    listed = ", ".join(lit(w) for w in ENGLISH_STOP_WORDS)
    return (
        f"array_to_string(list_filter(regexp_split_to_array({x}, '[{WS}]+'), "
        f"lambda w: w <> '' AND w NOT IN ({listed})), ' ')"
    )


def normal(x: str) -> str:
    spaces = (
        r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    )
    return fold(punct(f"lower(regexp_replace({x}, '^[{spaces}]+|[{spaces}]+$', '', 'g'))"))


def clean(x: str) -> str:
    return stops(urls(normal(markup(x))))


# Input frames

FIXTURE = """
posts AS (
  SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS body,
         CASE WHEN d.doc_id % 50 = 13 THEN NULL
              WHEN d.doc_id % 50 = 7 THEN ''
              WHEN d.doc_id % 40 = 3
                THEN d.lang || '-' || d.source || '|' || d.lang || '|' || d.lang || '-' || d.source
              ELSE d.lang || '-' || d.source || '|' || d.lang END AS tags,
         CAST(NULL AS BIGINT) AS parent_id, coalesce(l.quality, 0) AS score
  FROM documents d LEFT JOIN labels l USING (doc_id)),
tagged AS (SELECT * FROM posts WHERE tags <> ''),
post_tags AS (SELECT id AS post_id, unnest(string_split(tags, '|')) AS tag_name FROM tagged),
named AS (
  SELECT tag_name, count(*) AS n FROM post_tags GROUP BY tag_name
  UNION ALL SELECT 'orphan-' || r_name, 0 FROM region),
tags AS (
  SELECT CAST('0x' || substr(md5(tag_name), 1, 12) AS BIGINT) AS id, tag_name,
         CAST(n AS BIGINT) AS count
  FROM named WHERE tag_name NOT LIKE '%-src0'),
text AS (
  SELECT id AS post_id, body, title, score FROM tagged
  UNION ALL SELECT 1000000000 + item_id, text, NULL, NULL FROM benchmark
  UNION ALL SELECT 2000000000 + page_id, html, NULL, NULL FROM pages)
"""

INDEX = """
tag_index AS (
  SELECT t.id AS tag_id, t.tag_name, p.post_id FROM post_tags p JOIN tags t USING (tag_name))
"""

ORDERS = """
order_posts AS (
  SELECT l_orderkey AS post_id, array_to_string(list_sort(list(p_name)), ' ') AS raw,
         list(DISTINCT p_brand) AS brands
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
post_tags AS (SELECT post_id, unnest(brands) AS tag_name FROM order_posts),
tags AS (
  SELECT DISTINCT CAST('0x' || substr(md5(p_brand), 1, 12) AS BIGINT) AS id, p_brand AS tag_name
  FROM part)
"""


def cleaned() -> str:
    return (
        f"clean AS (SELECT post_id, {clean('body')} AS body, {clean('title')} AS title, score "
        "FROM text WHERE title IS NOT NULL AND body IS NOT NULL)"
    )


TRAINING = (
    "training AS (SELECT * FROM clean WHERE score >= 1 AND trim(title) <> '' AND trim(body) <> '')"
)
ORDER_TRAINING = f"training AS (SELECT post_id, {clean('raw')} AS body FROM order_posts)"

TOKENS = (
    "surface AS (SELECT post_id, unnest(regexp_extract_all(body, '[a-z0-9]{2,}')) AS word "
    "FROM training)"
)
PLAIN = f"{TOKENS}, tokens AS (SELECT post_id, word AS term FROM surface)"


# The suffix-stripping stemmer over distinct words

# Consonantal "y" is written "Y".
C = "[^aeiouy]+"
V = "[aeiouy]+"
CONS = "[^aeiouy]"
GT0 = f"^[^aeiouy]*{V}{C}"
EQ1 = f"^[^aeiouy]*{V}{C}(?:{V})?$"
GT1 = f"^[^aeiouy]*{V}{C}{V}{C}"
CVC = f"(?:{CONS}[aeiouy][^aeiouwxyY]$|^[aeiouy][^aeiouy]$)"
TWIN = "(?:" + "|".join(x * 2 for x in "bcdfghjkmnpqrtvwx0123456789") + "|yY)$"


def cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def has(n: int, pattern: str) -> str:
    return f"regexp_matches({cut(n)}, '{pattern}')"


def ends(suffix: str) -> str:
    return f"ends_with(w, '{suffix}')"


def suffixes(rules, condition, otherwise: str = "w") -> str:
    arms = " ".join(
        f"WHEN {ends(s)} THEN CASE WHEN {condition(s)} THEN {cut(len(s))} || '{new}' ELSE w END"
        for s, new in rules
    )
    return f"CASE {arms} ELSE {otherwise} END"


def stem_steps() -> list[str]:
    gt0 = lambda s: has(len(s), GT0)
    gt1 = lambda s: has(len(s), GT1) + (
        f" AND regexp_matches({cut(3)}, '[st]$')" if s == "ion" else ""
    )
    logi = f"CASE WHEN {ends('logi')} AND {has(3, GT0)} THEN {cut(1)} ELSE w END"
    return [
        "regexp_replace(regexp_replace(w, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')",
        f"CASE WHEN {ends('ies')} AND length(w) = 4 THEN {cut(1)} "
        f"ELSE {suffixes(STEP_1A, lambda s: 'true')} END",
        f"CASE WHEN {ends('ied')} AND length(w) = 4 THEN {cut(1)} WHEN {ends('ied')} THEN {cut(2)} "
        f"WHEN {ends('eed')} THEN CASE WHEN {has(3, GT0)} THEN {cut(1)} ELSE w END "
        f"WHEN {ends('ed')} AND {has(2, '[aeiou]|[^aeiouy]y')} THEN {cut(2)} || '|' "
        f"WHEN {ends('ing')} AND {has(3, '[aeiou]|[^aeiouy]y')} THEN {cut(3)} || '|' ELSE w END",
        f"CASE WHEN NOT {ends('|')} THEN w WHEN {has(1, '(?:at|bl|iz)$')} THEN {cut(1)} || 'e' "
        f"WHEN {has(1, TWIN)} THEN {cut(2)} WHEN {has(1, '(?:ll|ss|zz)$')} THEN {cut(1)} "
        f"WHEN {has(1, EQ1)} AND {has(1, CVC)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN {ends('y')} AND length(w) > 2 AND {has(1, CONS + '$')} "
        f"THEN {cut(1)} || 'i' ELSE w END",
        f"CASE WHEN {ends('alli')} AND {has(4, GT0)} THEN {cut(2)} ELSE w END",
        suffixes(STEP_2, gt0, logi),
        suffixes(STEP_3, gt0),
        suffixes([(s, "") for s in STEP_4], gt1),
        f"CASE WHEN {ends('e')} AND ({has(1, GT1)} OR ({has(1, EQ1)} AND NOT {has(1, CVC)})) "
        f"THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {has(1, GT1)} THEN {cut(1)} ELSE w END",
        "replace(w, 'Y', 'y')",
    ]


def stems(words: str) -> str:
    """CTEs ending in ``stems (word, stem)`` over the distinct words of ``words``."""
    ctes = [f"stem0 AS (SELECT DISTINCT word, word AS w FROM {words})"]
    steps = stem_steps()
    for i, step in enumerate(steps, 1):
        ctes.append(f"stem{i} AS (SELECT word, {step} AS w FROM stem{i - 1})")
    listed = " ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    ctes.append(
        f"stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word {listed} ELSE w END AS stem "
        f"FROM stem{len(steps)})"
    )
    return ", ".join(ctes)


STEMMED = (
    f"{TOKENS}, {stems('surface')}, "
    "tokens AS (SELECT post_id, stem AS term FROM surface JOIN stems USING (word) "
    "WHERE length(stem) >= 2)"
)

DOC_WORDS = (
    f"doc_text AS MATERIALIZED (SELECT doc_id, {clean('text')} AS text FROM documents), "
    "doc_words AS (SELECT unnest(regexp_extract_all(text, '[a-z0-9]{2,}')) AS word FROM doc_text), "
    "doc_totals AS MATERIALIZED (SELECT word, count(*) AS total FROM doc_words GROUP BY word)"
)
PLURALS = (
    "plurals AS MATERIALIZED (SELECT p.word, s.word AS lemma FROM doc_totals p "
    "JOIN doc_totals s ON p.word = s.word || 's')"
)
LEMMATIZED = (
    f"{DOC_WORDS}, {PLURALS}, {TOKENS}, "
    "tokens AS (SELECT post_id, coalesce(lemma, word) AS term FROM surface LEFT JOIN plurals "
    "USING (word) WHERE length(coalesce(lemma, word)) >= 2)"
)




def rewritten(pieces: str) -> str:
    """CTEs ending in ``full_text (key, text)``: stems, then lemmas, of ``pieces (key, text)``."""
    return (
        f"texts AS MATERIALIZED ({pieces}), "
        "placed AS (SELECT key, unnest(string_split(text, ' ')) AS word, "
        "generate_subscripts(string_split(text, ' '), 1) AS pos FROM texts), "
        f"{stems('placed')}, "
        "full_text AS (SELECT key, string_agg(coalesce(p.lemma, s.stem), ' ' ORDER BY pos) AS text "
        "FROM placed JOIN stems s USING (word) LEFT JOIN plurals p ON p.word = s.stem GROUP BY key)"
    )


# Lemmas by rules

DICTIONARY = """
dictionary AS MATERIALIZED (SELECT word AS form FROM doc_totals WHERE total >= 2),
exceptions AS MATERIALIZED (
  SELECT term, list(DISTINCT left(term, length(term) - 1)) AS listed FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark)
  WHERE ends_with(term, 'e') GROUP BY term)
"""


def detached(x: str) -> str:
    arms = ", ".join(
        f"CASE WHEN ends_with({x}, '{old}') THEN left({x}, length({x}) - {len(old)}) || '{new}' END"
        for old, new in NOUN_RULES
    )
    return f"list_filter([{arms}], lambda f: f IS NOT NULL AND f <> '')"


def rule_lemmas(asked: str) -> str:
    """CTEs ending in ``rule_lemmas (term, lemma)`` of the terms of ``asked``."""
    return (
        f"asked AS MATERIALIZED (SELECT DISTINCT a.term, e.listed FROM {asked} a "
        "LEFT JOIN exceptions e USING (term)), "
        "tried AS (SELECT term, listed IS NOT NULL AS by_list, 1 AS level, unnest(list_distinct("
        f"list_concat([term], coalesce(listed, {detached('term')})))) AS form FROM asked "
        f"UNION SELECT term, by_list, level + 1, unnest({detached('form')}) FROM tried "
        "WHERE NOT by_list AND form <> term), "
        "rule_lemmas AS (SELECT term, form AS lemma FROM tried JOIN dictionary USING (form) "
        "QUALIFY row_number() OVER (PARTITION BY term ORDER BY level, length(form), form) = 1)"
    )


# Sentences and word tokens

CLOSING = r"[)\"'\]}>]*"


def word_type(x: str) -> str:
    return f"regexp_replace({core(x)}, '[.]+\\z', '')"


def core(x: str) -> str:
    return f"lower(regexp_replace({x}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}.]+\\z', '', 'g'))"


def closes(x: str, ends: str) -> str:
    return f"regexp_matches({x}, {lit(ends + CLOSING + chr(92) + 'z')})"


def times_log(count: str, share: str) -> str:
    return f"(CASE WHEN {count} > 0 THEN {count} * ln({share}) ELSE 0 END)"


SENTENCES = rf"""
raw AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[{WS}]+'),
                             lambda w: w <> '') AS words
  FROM documents),
types AS MATERIALIZED (
  SELECT type, CAST(sum(n) AS BIGINT) AS n,
         CAST(sum(CASE WHEN period THEN n ELSE 0 END) AS BIGINT) AS n_period
  FROM (SELECT {word_type('word')} AS type, regexp_matches({core('word')}, '[^.][.]\z') AS period, n
        FROM (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM raw) GROUP BY word))
  WHERE regexp_matches(type, '\p{{L}}') GROUP BY type),
chance AS (SELECT sum(n_period) / sum(n) AS c, CAST(sum(n) AS DOUBLE) AS total FROM types),
scored AS MATERIALIZED (
  SELECT type, n, n_period,
         -2 * ({times_log('n_period', 'c')} + {times_log('(n - n_period)', '(1 - c)')}
               - n_period * ln(0.99) - (n - n_period) * ln(0.01))
         * exp(-letters) * (length(type) - letters + 1) * pow(letters, -(n - n_period)) AS score
  FROM (SELECT *, CAST(length(replace(type, '.', '')) AS DOUBLE) AS letters FROM types), chance
  WHERE n_period > 0),
short AS MATERIALIZED (SELECT type FROM scored WHERE score >= 0.3),
pairs AS (
  SELECT word, following, count(*) AS n FROM (
    SELECT unnest(words) AS word,
           unnest(list_concat(words[2:], CAST([NULL] AS VARCHAR[]))) AS following FROM raw)
  WHERE following IS NOT NULL AND {closes('word', '[.?!]')} GROUP BY word, following),
starts AS MATERIALIZED (
  SELECT {word_type('following')} AS type, CAST(sum(n) AS DOUBLE) AS n_start FROM pairs
  WHERE {closes('word', '[?!]')}
     OR (regexp_matches({core('word')}, '[^.][.]\z') AND length({word_type('word')}) > 1
         AND {word_type('word')} NOT IN (SELECT type FROM short))
  GROUP BY ALL),
starters AS MATERIALIZED (
  SELECT type, n, CAST(n_start AS BIGINT) AS n_start,
         CASE WHEN n_start * total > n * ends THEN ratio ELSE -ratio END AS score
  FROM (
    SELECT *, 2 * (
      {times_log('n_start', 'n_start / ends')} + {times_log('(ends - n_start)', '(1 - n_start / ends)')}
      + {times_log('(n - n_start)', '((n - n_start) / (total - ends))')}
      + {times_log('(total - ends - n + n_start)', '(1 - (n - n_start) / (total - ends))')}
      - {times_log('n_start', 'n / total')} - {times_log('(ends - n_start)', '(1 - n / total)')}
      - {times_log('(n - n_start)', 'n / total')}
      - {times_log('(total - ends - n + n_start)', '(1 - n / total)')}) AS ratio
    FROM (SELECT s.type, n, n_start, total, sum(n_start) OVER () AS ends
          FROM starts s JOIN types t USING (type), chance)))
"""


def split_words(x: str) -> str:
    """The replacements of the word tokenizer; the digits after a comma or colon protect it."""
    steps = [
        (r"(^|[ \n(\[{<])\"", r"\1 `` "),
        (r",([0-9])", "\x01\\1"),
        (r":([0-9])", "\x02\\1"),
        (r"[,:]", r" \0 "),
        ("\x01", ","),
        ("\x02", ":"),
        (r"\.\.\.", " ... "),
        (r"[;@#$%&]", r" \0 "),
        (r"([^.\n])\.([\])}>\"']*) *(\n|\z)", r"\1 . \2\3"),
        (r"[?!]", r" \0 "),
        (r"([^'])'( |\n|\z)", r"\1 ' \2"),
        (r"[\]\[(){}<>]", r" \0 "),
        (r"--", " -- "),
        (r"\"", " '' "),
        (r"([^' \n])('[sSmMdD])( |\n|\z)", r"\1 \2\3"),
        (r"([^' \n])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)( |\n|\z)", r"\1 \2\3"),
    ]
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"
    arms = " ".join(
        f"WHEN {lit(w)} THEN [t[:{n}], t[{n + 1}:]]" for w, n in CONTRACTIONS.items()
    )
    return (
        f"flatten(list_transform(list_filter(regexp_split_to_array({x}, '[ \\n]+'), lambda t: t <> ''), "
        f"lambda t: CASE lower(t) {arms} ELSE [t] END))"
    )


UPPER = "regexp_matches(words[i + 1], '^[^\\p{L}\\p{N}]*\\p{Lu}')"
LINES = rf"""
lists AS (SELECT (SELECT list(type) FROM short) AS shorts,
                 (SELECT list(type) FROM starters WHERE score >= 30) AS begins),
lines AS MATERIALIZED (
  SELECT doc_id, array_to_string(list_transform(words, lambda w, i: CASE WHEN i = len(words) THEN w
    WHEN CASE WHEN NOT {closes('w', '[.?!]')} THEN false WHEN {closes('w', '[?!]')} THEN true
              WHEN {closes('w', '[.][.]')} THEN {UPPER}
              ELSE NOT (list_contains(coalesce(shorts, []), {word_type('w')})
                        OR regexp_matches({word_type('w')}, '^\p{{L}}\z'))
                   OR ({UPPER} AND list_contains(coalesce(begins, []), {word_type('words[i + 1]')})) END
      THEN w || chr(10) ELSE w || ' ' END), '') AS sentences
  FROM raw, lists)
"""


# TF-IDF, similarity, graph

VOCAB = """
vocab AS (
  SELECT term, total, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx
  FROM (SELECT term, count(*) AS total FROM tokens GROUP BY term
        ORDER BY total DESC, term LIMIT 1000)),
tf AS (
  SELECT post_id, term_idx, count(*) AS n FROM tokens JOIN vocab USING (term)
  GROUP BY post_id, term_idx),
idf AS (
  SELECT term_idx, ln((1 + (SELECT count(*) FROM training)) / (1.0 + count(*))) + 1 AS idf
  FROM tf GROUP BY term_idx),
raw AS (SELECT post_id, term_idx, n * idf AS w FROM tf JOIN idf USING (term_idx)),
l2 AS (
  SELECT post_id, term_idx, w / sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS w FROM raw)
"""
MEANS = """
uses AS (
  SELECT t.id AS tag_id, p.post_id FROM post_tags p JOIN tags t USING (tag_name)
  JOIN training USING (post_id)),
sizes AS (SELECT tag_id, count(*) AS n FROM uses GROUP BY tag_id),
vectors AS (
  SELECT u.tag_id, l.term_idx, sum(l.w) / any_value(s.n) AS weight
  FROM uses u JOIN l2 l USING (post_id) JOIN sizes s USING (tag_id) GROUP BY u.tag_id, l.term_idx),
used AS (
  SELECT t.id AS tag_id, t.tag_name, coalesce(s.n, 0) AS n_posts
  FROM tags t LEFT JOIN sizes s ON s.tag_id = t.id
  WHERE t.tag_name IN (SELECT tag_name FROM post_tags))
"""
COSINES = """
unit AS (
  SELECT tag_id, term_idx, weight / sqrt(sum(weight * weight) OVER (PARTITION BY tag_id)) AS w
  FROM vectors),
dots AS (
  SELECT a.tag_id AS a, b.tag_id AS b, sum(a.w * b.w) AS dot
  FROM unit a JOIN unit b USING (term_idx) GROUP BY a.tag_id, b.tag_id),
cosines AS (
  SELECT x.tag_id AS a, y.tag_id AS b, round(coalesce(dot, 0), 9) AS similarity
  FROM used x CROSS JOIN used y LEFT JOIN dots ON dots.a = x.tag_id AND dots.b = y.tag_id)
"""
ONE = """
unit AS (
  SELECT tag_id, term_idx, weight / sqrt(sum(weight * weight) OVER (PARTITION BY tag_id)) AS w
  FROM vectors),
dots AS (
  SELECT b.tag_id, sum(a.w * b.w) AS dot FROM unit a JOIN unit b USING (term_idx)
  WHERE a.tag_id = (SELECT tag_id FROM used WHERE tag_name = {name}) GROUP BY b.tag_id),
ranking AS (
  SELECT u.tag_id, u.tag_name, round(coalesce(dot, 0), 9) AS similarity
  FROM used u LEFT JOIN dots USING (tag_id))
"""
VERTICES = "vertices AS (SELECT tag_id AS id, tag_name AS name FROM used)"
EDGES = (
    "edges AS (SELECT a AS src, b AS dst, similarity AS weight FROM cosines "
    "WHERE a IN (SELECT id FROM vertices) AND b IN (SELECT id FROM vertices) "
    f"AND a < b AND similarity >= {MIN_SIMILARITY})"
)
NAMED_VERTICES = (
    "vertices AS (SELECT tag_id AS id, tag_name AS name FROM used WHERE tag_name LIKE '%-%')"
)
FIRST_VERTICES = (
    "vertices AS (SELECT tag_id AS id, tag_name AS name FROM used "
    f"ORDER BY id LIMIT {COMPLETE_TAGS})"
)
COMPLETE = (
    "edges AS (SELECT a AS src, b AS dst, similarity AS weight FROM cosines "
    "WHERE a IN (SELECT id FROM vertices) AND b IN (SELECT id FROM vertices))"
)
COMPONENTS = """
links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
reach AS (
  SELECT id, id AS other FROM vertices
  UNION SELECT r.id, l.dst FROM reach r JOIN links l ON l.src = r.other),
components AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
"""
LABELS = "label0 AS (SELECT id, id AS label FROM vertices), " + ", ".join(
    f"""label{i} AS (
  SELECT v.id, coalesce(h.label, v.label) AS label FROM label{i - 1} v LEFT JOIN (
    SELECT id, label FROM (
      SELECT l.dst AS id, p.label,
             row_number() OVER (PARTITION BY l.dst ORDER BY count(*) DESC, p.label) AS r
      FROM links l JOIN label{i - 1} p ON p.id = l.src GROUP BY l.dst, p.label)
    WHERE r = 1) h USING (id))"""
    for i in range(1, 6)
)


def sql(*parts: str) -> str:
    *ctes, final = parts
    body = ", ".join(c.strip() for c in ctes)
    return (f"WITH RECURSIVE {body} " if ctes else "") + final


CORPUS = (FIXTURE, cleaned(), TRAINING)
MODEL = (*CORPUS, STEMMED, VOCAB, MEANS)
GRAPH = (*MODEL, COSINES, VERTICES, EDGES)
ORDER_MODEL = (ORDERS, ORDER_TRAINING, PLAIN, VOCAB, MEANS)

ROUND_VECTORS = "SELECT tag_id, term_idx, round(weight, 6) AS weight FROM vectors"
TAG_DIM = "SELECT id AS tag_id, CAST(id AS VARCHAR) AS tag_key, tag_name FROM tags"
LISTS = """
lists AS (
  SELECT tag_name, post_id // 1000000 AS chunk, CAST(count(*) AS INTEGER) AS n_posts,
         array_to_string(list_sort(list(post_id)), ',') AS post_ids
  FROM post_tags GROUP BY tag_name, post_id // 1000000)
"""
TOP_20 = (
    "SELECT tag_id, tag_name, similarity, CAST(rank AS INTEGER) AS rank "
    "FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, tag_id) AS rank FROM ranking) "
    "WHERE rank <= 20"
)
BOTH = (
    "SELECT v.id, v.name, c.component, l.label FROM vertices v JOIN components c USING (id) "
    "JOIN label5 l USING (id)"
)


def page(expression) -> str:
    both = expression("html || ' ' || url")
    return f"SELECT page_id, {both} AS text FROM pages"


def document(expression) -> str:
    return f"SELECT doc_id, {expression('text')} AS text FROM documents"


DOC_TOKENS = (
    "tokens AS (SELECT doc_id AS post_id, "
    "unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents)"
)

ORACLE: dict[str, str] = {
    "scan_posts": sql(FIXTURE, "SELECT * FROM posts"),
    "scan_limited": sql(FIXTURE, f"SELECT * FROM posts ORDER BY id LIMIT {SCAN_LIMIT}"),
    "vector_store_roundtrip": sql(*CORPUS, PLAIN, VOCAB, MEANS, ROUND_VECTORS),
    "tag_dim_store": sql(FIXTURE, TAG_DIM),
    "tag_dim": sql(FIXTURE, TAG_DIM),
    "tagged_posts": sql(FIXTURE, "SELECT id, tags, score FROM tagged"),
    "drop_untitled": sql(
        FIXTURE,
        "SELECT post_id, title, score FROM text WHERE title IS NOT NULL AND body IS NOT NULL",
    ),
    "min_score": sql(FIXTURE, "SELECT post_id, title, score FROM text WHERE score >= 1"),
    "nonblank_text": sql(
        FIXTURE,
        cleaned(),
        "SELECT post_id, title, score FROM clean WHERE trim(title) <> '' AND trim(body) <> ''",
    ),
    "training_posts": sql(*CORPUS, "SELECT * FROM training"),
    "training_posts_capped": sql(
        *CORPUS, f"SELECT * FROM training ORDER BY post_id LIMIT {MAX_POSTS}"
    ),
    "load_corpus": sql(
        FIXTURE,
        "SELECT t.*, CASE WHEN t.title IS NOT NULL OR p.id IS NOT NULL THEN p.tags END AS tags "
        "FROM text t LEFT JOIN tagged p ON p.id = t.post_id",
    ),
    "corpus_semi_join": sql(
        *CORPUS,
        INDEX,
        "SELECT * FROM tag_index WHERE post_id IN (SELECT post_id FROM training)",
    ),
    "split_tags": sql(
        FIXTURE,
        "SELECT id, CAST(len(string_split(tags, '|')) AS INTEGER) AS n_tags, "
        "array_to_string(string_split(tags, '|'), ',') AS tags FROM tagged",
    ),
    "explode_tags": sql(FIXTURE, "SELECT * FROM post_tags"),
    "tag_index": sql(FIXTURE, INDEX, "SELECT * FROM tag_index"),
    "tag_bitmaps": sql(FIXTURE, INDEX, "SELECT * FROM tag_index"),
    "tag_bitmap_counts": sql(
        FIXTURE,
        INDEX,
        "SELECT tag_id, tag_name, count(DISTINCT post_id) AS n_posts, count(*) AS n_rows "
        "FROM tag_index GROUP BY tag_id, tag_name",
    ),
    "tag_bitmaps_in_corpus": sql(
        *CORPUS,
        INDEX,
        "SELECT * FROM tag_index WHERE post_id IN (SELECT post_id FROM training)",
    ),
    "tag_post_lists": sql(FIXTURE, LISTS, "SELECT * FROM lists"),
    "tag_post_ids_csv": sql(FIXTURE, LISTS, "SELECT tag_name, chunk, post_ids FROM lists"),
    "decode_post_ids": sql(FIXTURE, INDEX, "SELECT tag_id, post_id FROM tag_index"),
    "build_tag_post_df": sql(
        FIXTURE,
        LISTS,
        "SELECT t.id AS tag_id, t.tag_name, t.count, 1000000000 + t.id % 40 AS excerpt_post_id, "
        "2000000000 + t.id % 50 AS wiki_post_id, l.chunk, l.post_ids "
        "FROM tags t JOIN lists l USING (tag_name)",
    ),
    "build_post_text_df": sql(FIXTURE, "SELECT * FROM text"),
    "corpus_counts": sql(
        FIXTURE,
        "SELECT (SELECT count(*) FROM tags WHERE tag_name IN (SELECT tag_name FROM post_tags)) "
        "AS n_tags, (SELECT count(*) FROM text) AS n_posts",
    ),
    "strip_markup": page(markup),
    "strip_punct": document(punct),
    "ascii_fold": document(fold),
    "normalize_text": document(normal),
    "strip_urls": page(urls),
    "drop_stopwords": document(stops),
    "clean_text": document(clean),
    "clean_text_sql": document(clean),
    "clean_pages_sql": page(clean),
    "clean_pages": page(clean),
    "preprocess_text": sql(FIXTURE, cleaned(), "SELECT * FROM clean"),
    "stem_terms": sql(
        DOC_WORDS,
        stems("doc_totals"),
        "SELECT word AS term, total, stem AS normal FROM doc_totals JOIN stems USING (word)",
    ),
    "clean_text_full": sql(
        DOC_WORDS,
        PLURALS,
        rewritten("SELECT doc_id AS key, text FROM doc_text"),
        "SELECT doc_id, f.text FROM documents LEFT JOIN full_text f ON f.key = doc_id",
    ),
    "preprocess_text_full": sql(
        FIXTURE,
        cleaned(),
        DOC_WORDS,
        PLURALS,
        rewritten(
            "SELECT 'b' || post_id AS key, body AS text FROM clean "
            "UNION ALL SELECT 't' || post_id, title FROM clean"
        ),
        "SELECT post_id, b.text AS body, t.text AS title, score FROM clean "
        "JOIN full_text b ON b.key = 'b' || post_id JOIN full_text t ON t.key = 't' || post_id",
    ),
    "lemma_terms": sql(
        DOC_WORDS,
        PLURALS,
        "SELECT word AS term, total, coalesce(lemma, word) AS normal "
        "FROM doc_totals LEFT JOIN plurals USING (word)",
    ),
    "rule_lemmas": sql(
        DOC_WORDS,
        DICTIONARY,
        rule_lemmas("(SELECT word AS term FROM doc_totals)"),
        "SELECT word AS term, total, coalesce(lemma, word) AS normal "
        "FROM doc_totals LEFT JOIN rule_lemmas ON term = word",
    ),
    "rule_lemmas_of_stems": sql(
        DOC_WORDS,
        stems("doc_totals"),
        DICTIONARY,
        rule_lemmas("(SELECT stem AS term FROM stems)"),
        "SELECT word AS term, total, coalesce(lemma, stem) AS normal "
        "FROM doc_totals JOIN stems USING (word) LEFT JOIN rule_lemmas r ON r.term = stem",
    ),
    "abbreviation_scores": sql(
        SENTENCES, "SELECT type, n, n_period, round(score, 6) AS score FROM scored"
    ),
    "sentence_starters": sql(
        SENTENCES, "SELECT type, n, n_start, round(score, 6) AS score FROM starters"
    ),
    "word_tokens": sql(
        SENTENCES,
        LINES,
        f"tokens AS MATERIALIZED (SELECT doc_id, sentences, {split_words('sentences')} AS tokens FROM lines)",
        "SELECT doc_id, CAST(CASE WHEN sentences = '' THEN 0 "
        "ELSE len(string_split(sentences, chr(10))) END AS INTEGER) AS n_sentences, "
        "CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS text FROM tokens",
    ),
    "tokenize_docs": sql(DOC_TOKENS, "SELECT * FROM tokens"),
    "term_freq": sql(
        DOC_TOKENS, "SELECT post_id, term, count(*) AS tf FROM tokens GROUP BY post_id, term"
    ),
    "vocabulary": sql(*CORPUS, PLAIN, VOCAB, "SELECT term, total, term_idx FROM vocab"),
    "vocabulary_by_summary": sql(*CORPUS, PLAIN, VOCAB, "SELECT term, total, term_idx FROM vocab"),
    "smooth_idf": sql(
        *CORPUS,
        PLAIN,
        VOCAB,
        "SELECT term, term_idx, round(idf, 6) AS idf FROM vocab JOIN idf USING (term_idx)",
    ),
    "tfidf_raw": sql(
        *CORPUS, PLAIN, VOCAB, "SELECT post_id, term_idx, round(w, 6) AS weight FROM raw"
    ),
    "tfidf_l2": sql(
        *CORPUS, PLAIN, VOCAB, "SELECT post_id, term_idx, round(w, 6) AS weight FROM l2"
    ),
    "tag_vectors": sql(*CORPUS, PLAIN, VOCAB, MEANS, ROUND_VECTORS),
    "tag_vector_coverage": sql(*MODEL, "SELECT * FROM used"),
    "stemmed_vocabulary": sql(*CORPUS, STEMMED, VOCAB, "SELECT term, total, term_idx FROM vocab"),
    "lemma_tag_vectors": sql(*CORPUS, LEMMATIZED, VOCAB, MEANS, ROUND_VECTORS),
    "fit_tag_vectors": sql(*MODEL, ROUND_VECTORS),
    "similar_tags": sql(*MODEL, ONE.format(name=lit(QUERY_TAG)), TOP_20),
    "similar_tags_from_keyed_store": sql(*MODEL, ONE.format(name=lit(QUERY_TAG)), TOP_20),
    "similar_tags_ranking": sql(
        *MODEL,
        ONE.format(name=lit(QUERY_TAG)),
        "SELECT tag_id, tag_name, similarity, "
        "CAST(row_number() OVER (ORDER BY similarity DESC, tag_id) AS INTEGER) AS rank FROM ranking",
    ),
    "similar_tags_from_store": sql(
        *MODEL,
        ONE.format(name=lit(QUERY_TAG)).replace(
            "LEFT JOIN dots USING (tag_id))",
            f"LEFT JOIN dots USING (tag_id) WHERE u.tag_name <> {lit(QUERY_TAG)})",
        ),
        TOP_20,
    ),
    "similar_tags_all": sql(
        *MODEL,
        COSINES,
        "SELECT query_id, tag_id, similarity, "
        "CAST(rank AS INTEGER) AS rank FROM (SELECT a AS query_id, b AS tag_id, similarity, "
        "row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM cosines) "
        "WHERE rank <= 20",
    ),
    "pairwise_cosine": sql(
        *MODEL,
        COSINES,
        "SELECT a AS src, b AS dst, similarity FROM cosines WHERE a < b AND similarity > 0",
    ),
    "pairwise_cosine_all": sql(
        *MODEL,
        COSINES,
        "SELECT a AS src, b AS dst, similarity FROM cosines WHERE a < b AND similarity > 0",
    ),
    "similarity_edges": sql(
        *MODEL,
        COSINES,
        "SELECT a AS src, b AS dst, similarity AS weight FROM cosines "
        f"WHERE a < b AND similarity >= {MIN_SIMILARITY}",
    ),
    "tag_graph": sql(
        *MODEL,
        COSINES,
        FIRST_VERTICES,
        COMPLETE,
        "SELECT src, name, dst, weight FROM edges JOIN vertices ON id = src",
    ),
    "dangling_edges": sql(
        *GRAPH,
        "SELECT src, dst, weight FROM edges "
        "WHERE src NOT IN (SELECT id FROM vertices WHERE name LIKE '%-%') "
        "OR dst NOT IN (SELECT id FROM vertices WHERE name LIKE '%-%')",
    ),
    "connected_components": sql(
        *GRAPH, COMPONENTS, "SELECT id, name, component FROM vertices JOIN components USING (id)"
    ),
    "components_with_dangling": sql(
        *MODEL, COSINES, NAMED_VERTICES, EDGES, COMPONENTS, LABELS, BOTH
    ),
    "cc_count": sql(
        *GRAPH, COMPONENTS, "SELECT count(DISTINCT component) AS components FROM components"
    ),
    "label_propagation": sql(
        *GRAPH, COMPONENTS, LABELS, "SELECT id, name, label FROM vertices JOIN label5 USING (id)"
    ),
    "lpa_count": sql(
        *GRAPH, COMPONENTS, LABELS, "SELECT count(DISTINCT label) AS labels FROM label5"
    ),
    "community_summary": sql(
        *GRAPH,
        COMPONENTS,
        LABELS,
        "SELECT 'connected_components' AS method, count(DISTINCT component) AS communities "
        "FROM components UNION ALL "
        "SELECT 'label_propagation', count(DISTINCT label) FROM label5",
    ),
    "detect_communities": sql(*GRAPH, COMPONENTS, LABELS, BOTH),
    "complete_graph_communities": sql(
        *MODEL, COSINES, VERTICES, COMPLETE, COMPONENTS, LABELS, BOTH
    ),
    "complete_graph_communities_all": sql(
        *MODEL, COSINES, VERTICES, COMPLETE, COMPONENTS, LABELS, BOTH
    ),
    "order_tag_vectors": sql(*ORDER_MODEL, ROUND_VECTORS),
    "order_similar_tags": sql(*ORDER_MODEL, ONE.format(name=lit(ORDER_TAG)), TOP_20),
}
