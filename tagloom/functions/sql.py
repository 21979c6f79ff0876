"""The cleaner's stages as functions of a SQL session.

Each is a temporary SQL function, so a query that uses it runs as the same JVM expressions as the column
functions, without Python.  Patterns and word lists are those of the column functions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from tagloom.functions import cleaning
from tagloom.functions.wordlists import (
    C1_CONTROLS,
    C1_READ_AS,
    ENGLISH_STOP_WORDS,
    HTML_ENTITIES,
)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _decoded(piece: str, names: str) -> str:
    """What stands for one ``piece`` of text after an ``&``; as in ``cleaning.decode_entities``."""
    digits = "ltrim('0', regexp_replace(ref, '^#[xX]?', ''))"
    number = f"concat('0', {digits})"
    is_hex = "(ref RLIKE '^#[xX]')"
    code = f"CAST(CASE WHEN {is_hex} THEN conv({number}, 16, 10) ELSE {number} END AS INT)"
    character = (
        "CASE WHEN code <= 1114111 AND NOT code BETWEEN 55296 AND 57343 THEN "
        f"translate(decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32'), {quoted(C1_CONTROLS)}, {quoted(C1_READ_AS)}) "
        "ELSE '�' END"
    )
    numeric = (
        f"CASE WHEN length({digits}) <= CASE WHEN {is_hex} THEN 6 ELSE 7 END "
        f"THEN {_bound(code, 'code', character)} ELSE '�' END"
    )
    after = f"substring({piece}, length(ref) + 1, length({piece}))"
    rest = f"CASE WHEN startswith({after}, ';') THEN substring({after}, 2, 1073741824) ELSE {after} END"
    named = f"coalesce(element_at(element_at({names}, substring(ref, 1, 1)), ref), concat('&', ref))"
    chosen = (
        f"CASE WHEN ref = '' THEN concat('&', {piece}) "
        f"WHEN startswith(ref, '#') THEN concat({numeric}, {rest}) ELSE concat({named}, {rest}) END"
    )
    return _bound(f"regexp_extract({piece}, {quoted(cleaning.REFERENCE)}, 0)", "ref", chosen)


def _tree_text(text: str) -> str:
    """The fold of ``cleaning.tree_text``."""
    hidden = ", ".join(quoted(n) for n in cleaning.HIDDEN_ELEMENTS)
    alone = ", ".join(quoted(n) for n in (*cleaning.VOID_ELEMENTS, "script", "style"))
    name = f"lower(regexp_extract(e, {quoted(r'(?i)^</?([a-z][^\s/>\x00]*)')}, 1))"
    back = f"CAST(array_position(reverse(s.open), {name}) AS INT)"
    now = (
        f"CASE WHEN NOT (startswith(e, '<') AND {name} <> '') THEN s.open "
        f"WHEN startswith(e, '</') THEN CASE WHEN {back} > 0 THEN slice(s.open, 1, size(s.open) - {back}) "
        f"ELSE s.open END WHEN {name} IN ({alone}) OR endswith(e, '/>') THEN s.open "
        f"ELSE concat(s.open, array({name})) END"
    )
    said = (
        "CASE WHEN NOT startswith(e, '<') OR e = '<' THEN e "
        f"WHEN e RLIKE {quoted(r'(?i)^<!\[CDATA\[')} "
        f"THEN regexp_extract(e, {quoted(r'(?is)^<!\[CDATA\[(.*)\]\]>$')}, 1) ELSE '' END"
    )
    seen = f"CASE WHEN exists(s.open, n -> n IN ({hidden})) THEN s.seen ELSE concat(s.seen, {said}) END"
    start = "named_struct('open', CAST(array() AS ARRAY<STRING>), 'seen', '')"
    return (
        f"aggregate(regexp_extract_all({text}, {quoted(cleaning.EVENTS)}, 0), {start}, "
        f"(s, e) -> named_struct('open', {now}, 'seen', {seen}), s -> s.seen)"
    )


def _strip_markup(entities: Mapping[str, str]) -> str:
    table: dict[str, dict[str, str]] = {}
    for name, character in entities.items():
        table.setdefault(name[:1], {})[name] = character
    names = f"from_json({quoted(json.dumps(table))}, 'map<string,map<string,string>>')"
    decoded = (
        "concat(element_at(pieces, 1), array_join(transform(slice(pieces, 2, size(pieces)), "
        f"piece -> {_decoded('piece', names)}), ''))"
    )
    given = "coalesce(text, '')"
    bare = (
        f"CASE WHEN NOT contains({given}, '<') THEN {given} "
        f"WHEN {given} RLIKE {quoted(cleaning.NESTED)} THEN {_tree_text(given)} "
        f"ELSE regexp_replace({given}, {quoted(cleaning.MARKUP)}, '$1') END"
    )
    split = _bound("split(bare, '&')", "pieces", decoded)
    return _bound(bare, "bare", f"CASE WHEN contains(bare, '&') THEN {split} ELSE bare END")


def definitions(
    prefix: str = "",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    entities: Mapping[str, str] = HTML_ENTITIES,
) -> dict[str, str]:
    """The body of each function of one string, ``text``, by its name; ``prefix`` stands before the names."""
    spaces, ends = cleaning.SPACES, cleaning.UNICODE_SPACES
    listed = ", ".join(quoted(w) for w in [*stop_words, ""])
    stripped = f"regexp_replace(text, {quoted(f'^[{ends}]+|[{ends}]+$')}, '')"
    bodies = {
        "strip_markup": _strip_markup(entities),
        "strip_punctuation": f"regexp_replace(text, {quoted(cleaning.PUNCTUATION)}, '')",
        "ascii_fold": f"regexp_replace(text, {quoted('[^' + chr(92) + 'x00-' + chr(92) + 'x7f]')}, ' ')",
        "strip_urls": f"regexp_replace(text, {quoted(f'http[^{spaces}]+')}, '')",
        "drop_stopwords": (
            f"array_join(filter(split(text, {quoted(f'[{spaces}]+')}), w -> NOT w IN ({listed})), ' ')"
        ),
        "normalize_text": f"{prefix}ascii_fold({prefix}strip_punctuation(lower({stripped})))",
        "clean_text": (
            f"{prefix}drop_stopwords({prefix}strip_urls({prefix}normalize_text({prefix}strip_markup(text))))"
        ),
    }
    return {prefix + name: body for name, body in bodies.items()}


def create_functions(
    spark: SparkSession,
    prefix: str = "",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    entities: Mapping[str, str] = HTML_ENTITIES,
) -> list[str]:
    """Create the cleaner's functions in the session; their names, in the order of creation."""
    made = definitions(prefix, stop_words, entities)
    for name, body in made.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS STRING RETURN {body}"
        )
    return list(made)
