"""Text cleaning as column expressions: no Python runs per row.

Every function takes a string column and returns one.  ``clean_text`` composes them in the fixed
order markup, ends, case, punctuation, non-ASCII, URLs, stop words.  Punctuation goes before URLs
and stop words on purpose: URLs are matched in their squashed form (``httpsabcom``), and stop words
spelled with an apostrophe never match.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.binding import let
from tagloom.functions.wordlists import (
    C1_CONTROLS,
    C1_READ_AS,
    ENGLISH_STOP_WORDS,
    HTML_ENTITIES,
)

# ASCII white space as Python's ``str.split`` and ``\s`` see it.  Written out, because the regex
# dialects disagree on vertical tab and on the four separator controls.
SPACES = r"\x09-\x0d\x1c-\x20"

# Characters that folding turns into spaces, and the control characters that it leaves alone.
NON_ASCII = r"\x80-\x{10FFFF}"
CONTROLS = r"[\x00-\x08\x0e-\x1b\x7f]"
PUNCTUATION = r"[!-/:-@\[-`{-~]+"

# One left-to-right pass over everything that is not text.  The alternatives start at the same
# "<", so whichever construct opens first wins: a tag inside a comment is comment, a comment inside
# a script is script.  Quantifiers over groups are possessive, which keeps the matcher iterative on
# very long attributes.  A CDATA section is text, hence the one captured group.
MARKUP = (
    r"(?is)<(?:"
    r"!--.*?(?:-->|\z)"
    r"|!\[CDATA\[(.*?)\]\]>"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|template\b[^>]*>.*?(?:</template\s*>|\z)"
    r"|/?[a-z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
    r"|/?[a-z][^>]*>"
    r"|[!?][^>]*>"
    r")"
)
# What a fold over nested markup goes along: whole constructs without a tree of their own, tags, text.
EVENTS = (
    r"(?is)<(?:"
    r"!--.*?(?:-->|\z)"
    r"|!\[CDATA\[.*?\]\]>"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|/?[a-z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
    r"|/?[a-z][^>]*>"
    r"|[!?][^>]*>"
    r")|[^<]++|<"
)
# Fixed values of HTML: elements without an end, and those whose text is not text of the document.
VOID_ELEMENTS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
    "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track",
    "wbr",
)
HIDDEN_ELEMENTS = ("template", "rt", "rp")
NESTED = r"(?i)<(?:" + "|".join(HIDDEN_ELEMENTS) + r")\b"
REFERENCE = r"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9.-]*)"


def _decode_reference(piece: Column, names: Column) -> Column:
    """``piece`` is what followed one ``&``; give back what the reader would see."""

    def numeric(ref: Column) -> Column:
        is_hex = ref.rlike("^#[xX]")
        digits = F.ltrim(F.regexp_replace(ref, "^#[xX]?", ""), F.lit("0"))
        number = F.concat(F.lit("0"), digits)
        code = F.when(is_hex, F.conv(number, 16, 10)).otherwise(number).cast("int")
        # No code point has more than six hexadecimal or seven decimal digits.
        in_range = F.length(digits) <= F.when(is_hex, 6).otherwise(7)
        return F.when(in_range, let(code, character)).otherwise("\ufffd")

    def character(code: Column) -> Column:
        text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.translate(text, C1_CONTROLS, C1_READ_AS)).otherwise("\ufffd")

    def decoded(ref: Column) -> Column:
        after = F.substring(piece, F.length(ref) + 1, F.length(piece))
        rest = F.when(after.startswith(";"), F.substring(after, 2, 2**30)).otherwise(after)
        same_letter = F.element_at(names, F.substring(ref, 1, 1))
        named = F.coalesce(F.element_at(same_letter, ref), F.concat(F.lit("&"), ref))
        return (
            F.when(ref == "", F.concat(F.lit("&"), piece))
            .when(ref.startswith("#"), F.concat(numeric(ref), rest))
            .otherwise(F.concat(named, rest))
        )

    return let(F.regexp_extract(piece, REFERENCE, 0), decoded)


def decode_entities(text: Column, entities: Mapping[str, str] | None = None) -> Column:
    """Replace character references: decimal, hexadecimal, and the names in ``entities``.

    An unknown name stays as text without its semicolon.  Rows without ``&`` skip the work.
    """
    # By first letter, because a map is searched from its start.
    table: dict[str, dict[str, str]] = {}
    for name, character in (HTML_ENTITIES if entities is None else entities).items():
        table.setdefault(name[:1], {})[name] = character
    # A constant JSON text is folded into one literal map when the plan is optimised.
    names = F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")

    def decode(bare: Column) -> Column:
        return let(
            F.split(bare, "&"),
            lambda pieces: F.concat(
                F.element_at(pieces, 1),
                F.array_join(
                    F.transform(
                        F.slice(pieces, F.lit(2), F.size(pieces)),
                        lambda piece: _decode_reference(piece, names),
                    ),
                    "",
                ),
            ),
        )

    return let(
        text, lambda bare: F.when(F.contains(bare, F.lit("&")), decode(bare)).otherwise(bare)
    )


def tree_text(text: Column, separator: str = "") -> Column:
    """The text of nested markup that a reader of the tree sees, references not yet decoded.

    A fold over tags and text keeps the names of the open elements.  A start tag opens one, unless it is void
    or closes itself; an end tag closes the last one of its name and all inside it, or nothing if there is none.
    Text inside an open template or ruby annotation is left out, however deep it is.
    """

    def step(state: Column, event: Column) -> Column:
        opened, seen = state["open"], state["seen"]
        name = F.lower(F.regexp_extract(event, r"(?i)^</?([a-z][^\s/>\x00]*)", 1))
        is_tag = event.startswith("<") & (name != "")
        is_end = event.startswith("</")
        alone = name.isin(*VOID_ELEMENTS, "script", "style") | event.endswith("/>")
        # Behind the last of that name, counted from the end; zero if there is none.
        back = F.array_position(F.reverse(opened), name)
        closed = F.when(
            back > 0, F.slice(opened, F.lit(1), F.size(opened) - back.cast("int"))
        ).otherwise(opened)
        now = F.when(
            is_tag, F.when(is_end, closed).when(alone, opened).otherwise(F.concat(opened, F.array(name)))
        ).otherwise(opened)
        data = F.regexp_extract(event, r"(?is)^<!\[CDATA\[(.*)\]\]>$", 1)
        said = (
            F.when(~event.startswith("<") | (event == "<"), event)
            .when(event.rlike(r"(?i)^<!\[CDATA\["), F.concat(data, F.lit(separator)))
            .otherwise(separator)
        )
        hidden = F.exists(opened, lambda n: n.isin(*HIDDEN_ELEMENTS))
        shown = F.when(hidden, seen).otherwise(F.concat(seen, said))
        return F.struct(now.alias("open"), shown.alias("seen"))

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("seen"))
    events = F.regexp_extract_all(text, F.lit(EVENTS), F.lit(0))
    return F.aggregate(events, start, step, lambda state: state["seen"])


def strip_markup(
    text: Column, separator: str = "", entities: Mapping[str, str] | None = None
) -> Column:
    """The text nodes of an HTML fragment; null gives ``""``.

    Text nodes are glued with ``separator``, by default nothing, so ``<p>a</p><p>b</p>`` gives
    ``ab``.  Comments, declarations, scripts, styles, templates and ruby annotations are left out.  Most
    texts have neither of the last two, which may be nested, and need one pattern only; the others are
    folded by ``tree_text``.
    """
    text = F.coalesce(text, F.lit(""))
    flat = F.regexp_replace(text, MARKUP, "$1" + re.sub(r"([\\$])", r"\\\1", separator))
    bare = (
        F.when(~F.contains(text, F.lit("<")), text)
        .when(text.rlike(NESTED), tree_text(text, separator))
        .otherwise(flat)
    )
    return decode_entities(bare, entities)


def strip_punctuation(text: Column) -> Column:
    """Delete the 32 ASCII punctuation characters; no space is left behind."""
    return F.regexp_replace(text, PUNCTUATION, "")


def ascii_fold(text: Column) -> Column:
    """Replace every non-ASCII character by one space."""
    return F.regexp_replace(text, r"[^\x00-\x7f]", " ")


def strip_urls(text: Column) -> Column:
    """Delete ``http`` and the non-space characters after it, also inside a word."""
    return F.regexp_replace(text, f"http[^{SPACES}]+", "")


def words(text: Column) -> Column:
    """Split on runs of white space; no empty words."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def _kept_words(text: Column, stop_words: Sequence[str] | None, separators: str) -> Column:
    stops = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words) + [""]
    return F.filter(F.split(text, f"[{separators}]+"), lambda w: ~w.isin(stops))


def kept_words(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """The words that are not stop words, in order."""
    return _kept_words(text, stop_words, SPACES)


def drop_stopwords(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Drop exact matches and rejoin the other words with one space."""
    return F.array_join(kept_words(text, stop_words), " ")


#: All characters that Unicode counts as white space, and the four ASCII separators.
UNICODE_SPACES = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def normalize_text(text: Column) -> Column:
    """No white space at the ends, lower case, no punctuation, ASCII only."""
    bare = F.regexp_replace(text, f"^[{UNICODE_SPACES}]+|[{UNICODE_SPACES}]+$", "")
    return ascii_fold(strip_punctuation(F.lower(bare)))


def clean_text(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Markup to normalised, space-separated words without stop words.

    Gives what the single stages give one after the other.  The folding of non-ASCII characters to
    spaces has no pass of its own: URLs end at them and words are split at them.
    """

    def without_urls(bare: Column) -> Column:
        cut = F.regexp_replace(bare, f"http[^{SPACES}{NON_ASCII}]+", "")
        return F.when(F.contains(bare, F.lit("http")), cut).otherwise(bare)

    bare = let(strip_punctuation(F.lower(F.trim(strip_markup(text)))), without_urls)
    return F.array_join(_kept_words(bare, stop_words, SPACES + NON_ASCII), " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more ASCII letters or digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def clean_tokens(cleaned: Column) -> Column:
    """``tokens`` of a text that ``clean_text`` made.

    Its words hold letters, digits and, rarely, control characters.  Without the latter the words
    of two or more characters are the tokens, and a plain split finds them.
    """

    def split(text: Column) -> Column:
        plain = F.filter(F.split(text, " "), lambda w: F.length(w) >= 2)
        return F.when(text.rlike(CONTROLS), tokens(text)).otherwise(plain)

    return let(cleaned, split)
