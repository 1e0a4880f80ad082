"""Text columns: cleaning, tokens, fingerprints, sentences, encoded passages.

All but the Unicode folding are native expressions.  Patterns are ASCII on
purpose where a result has to be the same in every engine.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[ \t\n\r\f\x0B]+"


def strip_html(html: Column) -> Column:
    """Text of markup: blocks that hold no text, comments and tags become spaces; the common named entities are decoded."""
    out = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<(script|style|template)[^>]*>.*?</(script|style|template)>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def normalize_text(text: Column) -> Column:
    """Printable ASCII and Latin letters of the range U+00C0-U+024F; everything else is white space, which collapses."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20-\\x7E\\u00C0-\\u024F]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def unique_words(text: Column) -> Column:
    return F.size(F.array_distinct(tokens(F.lower(text)))).cast("long")


def lexical_diversity(text: Column) -> Column:
    return F.coalesce(F.try_divide(unique_words(text), word_count(text)), F.lit(0.0))


def fingerprint(text: Column) -> Column:
    """MD5 of the lower-case text without white space."""
    return F.md5(F.regexp_replace(F.lower(text), SPACE, ""))


def collapsed_fingerprint(text: Column) -> Column:
    """SHA-256 of the folded text with collapsed white space."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), SPACE, " ")), 256)


def token_fingerprint(text: Column) -> Column:
    """SHA-256 of the word tokens joined by spaces; null where there is no token, so that blank texts never match."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)
    return F.when(F.size(found) > 0, F.sha2(F.array_join(found, " "), 256))


def source_key(value: Column) -> Column:
    return F.sha2(F.lower(F.trim(value)), 256)


def sentences(text: Column, least: int = 10, limit: int | None = 20_000) -> Column:
    """Pieces after ``.!?`` and spaces (a line break does not split), longer than ``least`` when trimmed.

    ``limit`` bounds the characters that are read, where the measure built on it requires that; ``None``: all are.
    """
    cut = F.split(text if limit is None else F.substring(text, 1, limit), "(?<=[.!?]) +")
    return F.filter(cut, lambda s: F.length(F.trim(s)) > least)


def display_units(text: Column, least: int = 3) -> Column:
    """Pieces at white space after ``.!?`` or at line breaks, longer than ``least`` when trimmed."""
    cut = F.split(text, r"(?<=[.!?])[ \t]+|\n")
    return F.filter(cut, lambda s: F.length(F.trim(s)) > least)


def clauses(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?;\n]+"), lambda s: F.trim(s) != "")


def canonical_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """Whole-word aliases by their canonical names, the longest first."""
    out = text
    for alias in sorted(aliases, key=lambda a: (-len(a), a)):
        pattern = r"(?i)\b" + r"[ \t\n\r\f\x0B]+".join(re.escape(w) for w in alias.split()) + r"\b"
        out = F.regexp_replace(out, pattern, aliases[alias])
    return out


def first_line(text: Column, limit: int = 80) -> Column:
    """First line that is not blank, cut to ``limit``."""
    return F.substring(F.try_element_at(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), F.lit(1)), 1, limit)


def encoded_candidates(text: Column, least: int = 16) -> Column:
    """Runs of the Base64 alphabet of at least ``least`` characters."""
    return F.regexp_extract_all(text, F.lit(f"([A-Za-z0-9+/]{{{least},}}={{0,2}})"), 1)


def strict_decode(token: Column, least: int = 8, limit: int = 2048) -> Column:
    """Decoded text of a Base64 token if it is valid, valid UTF-8, printable and long enough; else null. Never recursive."""
    raw = F.try_to_binary(token, F.lit("base64"))
    text = F.when((F.length(token) <= limit) & (F.length(token) % 4 == 0) & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when((F.length(text) >= least) & ~text.rlike(r"[^\x20-\x7E\n\r\t]"), text)


#: Letters of other scripts that look like a Latin one, by their Unicode names.
_LIKE = {
    "a": ("CYRILLIC SMALL LETTER A", "GREEK SMALL LETTER ALPHA"), "b": ("GREEK SMALL LETTER BETA",), "c": ("CYRILLIC SMALL LETTER ES",), "d": ("CYRILLIC SMALL LETTER KOMI DE",),
    "e": ("CYRILLIC SMALL LETTER IE", "GREEK SMALL LETTER EPSILON"), "l": ("CYRILLIC SMALL LETTER PALOCHKA",),
    "h": ("CYRILLIC SMALL LETTER SHHA",), "i": ("CYRILLIC SMALL LETTER BYELORUSSIAN-UKRAINIAN I", "GREEK SMALL LETTER IOTA"), "j": ("CYRILLIC SMALL LETTER JE",), "k": ("CYRILLIC SMALL LETTER KA", "GREEK SMALL LETTER KAPPA"),
    "m": ("CYRILLIC SMALL LETTER EM",), "o": ("CYRILLIC SMALL LETTER O", "GREEK SMALL LETTER OMICRON"), "p": ("CYRILLIC SMALL LETTER ER", "GREEK SMALL LETTER RHO"), "q": ("CYRILLIC SMALL LETTER QA",),
    "s": ("CYRILLIC SMALL LETTER DZE",), "t": ("CYRILLIC SMALL LETTER TE", "GREEK SMALL LETTER TAU"),
    "u": ("GREEK SMALL LETTER UPSILON", "GREEK SMALL LETTER MU"), "v": ("GREEK SMALL LETTER NU",), "w": ("CYRILLIC SMALL LETTER WE",), "x": ("CYRILLIC SMALL LETTER HA", "GREEK SMALL LETTER CHI"), "y": ("CYRILLIC SMALL LETTER U",),
}
LOOK_ALIKES = {unicodedata.lookup(name): latin for latin, names in _LIKE.items() for name in names}
_WORD = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(LOOK_ALIKES)


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Places at which a text may be cut so that normalising the parts normalises the whole."""
    begin = 0
    for k in range(1, len(text) + 1):
        if k < len(text):
            c, run = text[k], text[begin:k]
            if not (c.isascii() and text[k - 1].isascii()):
                joins = unicodedata.combining(c) or unicodedata.normalize("NFKC", run + c) != unicodedata.normalize("NFKC", run) + unicodedata.normalize("NFKC", c)
                if joins:
                    continue
        yield begin, k
        begin = k


def fold_spans(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text in NFKC, case-folded, without format controls, with look-alikes as Latin letters in words that hold one; and the span in the original of each of its characters.

    A composed character has the span of the run that it is composed of.
    """
    if text.isascii():
        return text.casefold(), [(k, k + 1) for k in range(len(text))]
    out, spans = [], []
    for begin, end in _runs(text):
        for c in unicodedata.normalize("NFKC", text[begin:end]).casefold():
            if unicodedata.category(c) != "Cf":
                out.append(c)
                spans.append((begin, end))
    return _WORD.sub(_latin, "".join(out)), spans


def _latin(m: re.Match) -> str:
    return m[0].translate(_FOLD) if any(unicodedata.name(c, "").startswith("LATIN") for c in m[0]) else m[0]


def fold_text(text: str | None) -> str | None:
    return None if text is None else fold_spans(text)[0]


def fold_offsets(text: str) -> list[int]:
    """Place in the original at which each character of :func:`fold_text` begins."""
    return [begin for begin, _ in fold_spans(text)[1]]


@F.pandas_udf(T.StringType())
def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def offsets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(fold_offsets, na_action="ignore")


@F.pandas_udf(T.StringType())
def decode_entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All named and numeric character references; for what :func:`strip_html` leaves."""
    import html

    for batch in batches:
        yield batch.map(html.unescape, na_action="ignore")


def plain_text(markup: Column) -> Column:
    """Text of markup with every character reference decoded; only texts that still hold one travel to Python."""
    plain = strip_html(markup)
    held = plain.rlike("&(#|[A-Za-z])")
    return F.coalesce(decode_entities(F.when(held, plain)), plain)


def unit_spans(text: Column, least: int = 3) -> Column:
    """:func:`display_units` with their places: structs of ``start, end, unit``."""
    parts = F.split(text, r"(?<=\n)|(?<=[.!?])(?=[ \t])")
    ends = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)))

    def placed(part: Column, end: Column) -> Column:
        lead = F.length(part) - F.length(F.ltrim(part))
        unit = F.trim(F.regexp_replace(part, "\n$", ""))
        start = end - F.length(part) + lead
        return F.struct(start.alias("start"), (start + F.length(unit)).alias("end"), unit.alias("unit"))

    return F.filter(F.zip_with(parts, ends, placed), lambda u: F.length(u["unit"]) > least)
