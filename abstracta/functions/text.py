"""Text, list and file-name expressions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed patterns, written for Java's regex engine: the leading flags give Unicode
# classes (U) and a dot that stops at a line feed only (d).
PLACEHOLDER_TITLE = r"(?U)\ANull[^\s\x1c-\x1f]+\z"
FILENAME_REJECTED = r"[^a-zA-Z0-9_\- ]"
CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"
# A list literal of quoted strings without escapes, which needs no Python to read.
_QUOTED = r"""(?:'[^'\\\n\r\x00]*+'|"[^"\\\n\r\x00]*+")"""
PLAIN_LIST = rf"\A\s*+\[\s*+(?:{_QUOTED}\s*+(?:,\s*+{_QUOTED}\s*+)*+,?\s*+)?\]\s*+\z"


def strip_text(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_placeholder_title(title: Column) -> Column:
    """True when the whole title is ``Null`` plus one run of non-space characters."""
    return F.coalesce(title.rlike(PLACEHOLDER_TITLE), F.lit(False))


def title_case(text: Column) -> Column:
    """Upper-case each cased character that follows an uncased one, lower-case the rest."""
    pieces = F.split(text, rf"(?<!{CASED})(?={CASED})")

    def capitalise(piece: Column) -> Column:
        head = F.upper(F.left(piece, F.lit(1)))
        return F.concat(F.left(head, F.lit(1)), F.lower(F.substr(head, F.lit(2))), F.lower(F.substr(piece, F.lit(2))))

    return F.array_join(F.transform(pieces, capitalise), "")


def format_keywords(keywords: Column) -> Column:
    """Drop NULL and empty keywords, then strip and title-case the rest."""
    kept = F.filter(keywords, lambda k: k.isNotNull() & (k != ""))
    return F.transform(kept, lambda k: title_case(strip_text(k)))


def split_authors(authors: Column) -> Column:
    """Comma list to array: pieces stripped, empty ones dropped, NULL gives ``[]``."""
    pieces = F.transform(F.split(authors, ","), strip_text)
    return F.coalesce(F.filter(pieces, lambda a: a != ""), F.array().cast("array<string>"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _read_list_literal(raw: pd.Series) -> pd.Series:
    def read(value):
        if value is None:
            return None
        try:
            items = ast.literal_eval(value)
            return [item if isinstance(item, str) else None if item is None else str(item) for item in items]
        except Exception:
            return None

    return raw.map(read)


def parse_keywords(raw: Column, python_literals: bool = True) -> Column:
    """List literal to array; any other or unreadable text becomes a one-element array.

    Plain lists of quoted strings are read by expressions. The remaining literals
    (escapes, ``None``, numbers) go to a vectorised ``ast.literal_eval``; elements that
    are not strings become their text, ``None`` and missing input stay NULL. ``python_literals=False`` keeps the whole expression
    on the JVM for columns known to hold plain lists only.
    """
    plain = raw.rlike(PLAIN_LIST)
    quoted = F.regexp_extract_all(raw, F.lit(f"({_QUOTED})"), F.lit(1))
    strings = F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2))
    parsed = F.when(plain, strings)
    if python_literals:
        looks_like_list = F.startswith(strip_text(raw), F.lit("["))
        parsed = F.coalesce(parsed, _read_list_literal(F.when(looks_like_list & ~plain, raw)))
    return F.coalesce(parsed, F.when(raw.isNotNull(), F.array(raw)))


def _two_decimals(signed: Column) -> Column:
    """Two decimals, rounded on the exact binary value; NULL stays NULL.

    ``format_string('%.2f')`` rounds the decimal text half up (0.815 -> 0.82), while the
    binary value of 0.815 lies below the tie. The rounding error of ``value * 100`` is
    recovered exactly by splitting the mantissa, and decides such ties.
    """
    value = F.abs(signed)
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    low = value - high
    product = value * F.lit(100.0)
    error = (high * F.lit(100.0) - product) + low * F.lit(100.0)
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    cents = (whole + F.when(up, 1).otherwise(0)).cast("bigint")
    digits = F.format_string("%d.%02d", F.floor(cents / 100).cast("bigint"), cents % 100)
    # Like the usual formatting, a negative zero keeps its sign.
    minus = (signed < 0) | (signed.cast("string") == "-0.0")
    return F.when(signed.isNotNull(), F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), digits))


def safe_filename(rank: Column, affinity: Column, venue: Column, title: Column) -> Column:
    """``<rank> - <affinity> - <venue> - <title>.pdf`` with file-system-safe parts."""
    return F.concat(
        F.format_string("%02d", rank.cast("bigint")),
        F.lit(" - "),
        _two_decimals(affinity),
        F.lit(" - "),
        F.regexp_replace(venue, FILENAME_REJECTED, ""),
        F.lit(" - "),
        F.regexp_replace(title, FILENAME_REJECTED, ""),
        F.lit(".pdf"),
    )


def file_stamp(venue: Column, year: Column, state: Column, ts: Column) -> Column:
    """``notes_<venue><year>_<state>_<yyyy-MM-dd_HH-mm-ss>``."""
    return F.concat(
        F.lit("notes_"), venue, year.cast("string"), F.lit("_"), state, F.lit("_"),
        F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"),
    )
