"""Text normalisation and HTML text/tag extraction as column expressions."""

from __future__ import annotations

import html as html_lib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is not visible, and attributes that a
# translation may change freely.
HIDDEN_TEXT_TAGS = ["head", "style", "script", "noscript", "template", "title"]
IGNORED_ATTRIBUTES = [
    "alt", "aria-description", "aria-label", "content", "lang", "placeholder", "title",
]
ONE_LETTER_WORDS = ["a", "i"]

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
RAW_TEXT_BODY = r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>|\z)"
TAG = r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG_WITH_TEXT = TAG + r"(?:[^<]++|<(?![a-zA-Z/]))*+"
DECLARATION = r"<[!?][^>]*>"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?"""
WORD = r"[\p{L}\p{N}]+"

# Entities decoded by plain replacement; any other entity sends the row to the
# exact (Arrow) path. &amp; stays last so that it never creates a new entity.
ENTITIES = [
    ("&nbsp;", " "), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'),
    ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
]
OTHER_ENTITY = r"&(?!(?:nbsp|copy|middot|quot|apos|#39|lt|gt|amp);)#?[a-zA-Z0-9]+"


def _plain(code: int) -> bool:
    """True if lower() already equals NFKC + casefold for this code point."""
    char = chr(code)
    if char in "ß ­":
        return True
    return (
        unicodedata.normalize("NFKC", char) == char
        and char.casefold() == char.lower()
        and len(char.lower()) == 1
        and unicodedata.combining(char) == 0
        and unicodedata.category(char) not in ("Cn", "Cs", "Co")
    )


@lru_cache(maxsize=1)
def needs_exact_pattern() -> str:
    """Character class of everything outside the blocks where lower() is proven exact."""
    blocks = [(0x00, 0x24F), (0x1EA0, 0x1EF9), (0x2010, 0x203F)]
    parts: list[str] = []
    for low, high in blocks:
        start = None
        for code in range(low, high + 2):
            good = code <= high and (code < 0x80 or _plain(code))
            if good and start is None:
                start = code
            elif not good and start is not None:
                parts.append(f"\\u{start:04X}-\\u{code - 1:04X}")
                start = None
    return "[^" + "".join(parts) + "]"


def keep_token(token: str) -> bool:
    if len(token) == 1 and not token.isdigit() and token not in ONE_LETTER_WORDS:
        return False
    return not (len(token) <= 2 and not any(ch.isascii() for ch in token))


def exact_tokens(text: str, entities: bool = True) -> list[str]:
    """Entity decoding, NFKC, casefold and word split for one text (Arrow path helper)."""
    text = unicodedata.normalize("NFKC", html_lib.unescape(text) if entities else text)
    text = text.replace("\u00ad", "").replace("\u2011", "-")
    return [t.casefold() for t in re.findall(r"[^\W_]+", text)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exact_html_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: exact_tokens(t) if t is not None else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exact_text_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: exact_tokens(t, entities=False) if t is not None else None)


def strip_markup(html: Column) -> Column:
    """Visible text of an HTML page; elements and comments become blanks."""
    out = F.regexp_replace(html, COMMENT, " ")
    for tags in (("script", "style"), tuple(HIDDEN_TEXT_TAGS)):
        names = "|".join(tags)
        out = F.regexp_replace(out, rf"(?is)<({names})\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    out = F.regexp_replace(out, TAG, " ")
    return F.regexp_replace(out, DECLARATION, " ")


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def word_tokens(text: Column, *, entities: bool = False) -> Column:
    """Array of normalised word tokens.

    Rows made only of characters where lower() equals NFKC + casefold stay in the
    JVM; the other rows (and only their text) go through one
    Arrow UDF, so results are the same for any script."""
    decoded = decode_entities(text) if entities else text
    decoded = F.replace(decoded, F.lit("\u00ad"), F.lit(""))
    folded = F.replace(F.lower(decoded), F.lit("\u00df"), F.lit("ss"))
    plain = F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))
    odd = text.rlike(needs_exact_pattern())
    if entities:
        odd = odd | text.rlike(OTHER_ENTITY)
    exact = _exact_html_tokens if entities else _exact_text_tokens
    return F.filter(F.coalesce(exact(F.when(odd, text)), plain), _keep)


def _keep(token: Column) -> Column:
    size = F.length(token)
    lone = (size == 1) & ~token.rlike(r"^\p{Nd}$") & ~token.isin(ONE_LETTER_WORDS)
    foreign = (size <= 2) & ~token.rlike(r"[\x00-\x7F]")
    return ~lone & ~foreign


def visible_words(html: Column) -> Column:
    return word_tokens(strip_markup(html), entities=True)


def without_raw_text(html: Column) -> Column:
    """Drop comments and script/style bodies so that tag patterns cannot match inside."""
    return F.regexp_replace(F.regexp_replace(html, COMMENT, " "), RAW_TEXT_BODY, "$1$3")


def tag_kind(tag: Column) -> Column:
    return (
        F.when(tag.startswith("</"), F.lit("end"))
        .when(tag.endswith("/>"), F.lit("startend"))
        .otherwise(F.lit("start"))
    )


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))


def tag_attributes(tag: Column) -> Column:
    """Sorted array of (name, value) without the attributes a translation may change."""
    body = F.regexp_replace(tag, r"^</?[a-zA-Z][^\s/>]*|/?>$", "")
    names = F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(2))
    pairs = F.zip_with(
        names,
        values,
        lambda n, v: F.struct(
            F.lower(n).alias("name"),
            decode_entities(F.regexp_replace(v, r"""^["']|["']$""", "")).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["name"].isin(IGNORED_ATTRIBUTES))
    return F.when(tag.startswith("</"), F.array().cast(pairs_type())).otherwise(F.array_sort(kept))


def pairs_type() -> T.ArrayType:
    return T.ArrayType(
        T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
    )


def attributes_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), " ")


def tag_array(html: Column) -> Column:
    return F.regexp_extract_all(without_raw_text(html), F.lit(TAG), F.lit(0))


def strip(text: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def slugify(text: Column) -> Column:
    base = F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("book"))


def title_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def page_key(page: Column) -> Column:
    return F.format_string("page_%04d", page.cast("bigint"))


def canonical_id(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
