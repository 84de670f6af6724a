"""Markup expressions: anchors, element texts, attributes.

Extraction stays in JVM regular expressions so pages never leave the executor JVM; only
short extracted texts that may hold character references go through Python.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from abstracta.functions.text import strip_text

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_ATTRS_AHEAD = r"[^>]*?\s"
_ANCHOR = rf"(?is)(<a(?=[\s>]){_ATTRS}>.*?</a\s*>)"
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_TAG = rf"(?s)<[A-Za-z/!]{_ATTRS}>"
# Nodes that cannot hold their own tag; another opening one ends them or is text.
_UNCLOSED = ("p", "li", "dt", "dd", "tr", "td", "th", "option", "title", "style", "script", "a")


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """Replace character references such as ``&amp;``."""
    return text.map(lambda t: html_lib.unescape(t) if t is not None and "&" in t else t)


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, "")


def inner_text(markup: Column, joiner: str = "") -> Column:
    """Text nodes of a fragment, each stripped, empty ones dropped, then joined."""
    pieces = F.transform(F.split(markup, _TAG), strip_text)
    return F.array_join(F.filter(pieces, lambda p: p != ""), joiner)


def element(html: Column, tag: str, attribute: str = "") -> Column:
    """Inner markup of the first ``tag`` whose attributes match the regex; NULL if none."""
    return F.try_element_at(elements(html, tag, attribute), F.lit(1))


def elements(html: Column, tags: str, attribute: str = "") -> Column:
    """Inner markups of every element whose tag is in the ``a|b`` list and attributes match.

    Only pages in which such an element holds one of its own tag leave the JVM.
    """
    wanted = f"(?={_ATTRS_AHEAD}{attribute})" if attribute else ""
    opening = rf"(?is)<({tags})(?=[\s>]){wanted}{_ATTRS}>"
    flat = F.regexp_extract_all(html, F.lit(rf"{opening}(.*?)</\1\s*>"), F.lit(2))
    unclosed = rf"(?is)<(?!(?:{'|'.join(_UNCLOSED)})[\s>])"
    nested = html.rlike(rf"{opening.replace('(?is)<', unclosed, 1)}(?:(?!</\1\s*>).)*?<\1(?=[\s>])")
    return F.when(nested, _whole_nodes(opening)(F.when(nested, html))).otherwise(flat)


def _whole_nodes(opening: str):
    start = re.compile(opening)

    def nodes(page: str) -> list[str]:
        found, at = [], 0
        while match := start.search(page, at):
            depth, end, at = 1, len(page), len(page)
            for tag in re.finditer(rf"(?is)<(/?){match[1]}(?=[\s>]){_ATTRS}>", page[match.end() :]):
                depth += -1 if tag[1] else match[1].lower() not in _UNCLOSED
                if not depth:
                    end, at = match.end() + tag.start(), match.end() + tag.end()
                    break
            found.append(page[match.end() : end])
        return found

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def whole(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else nodes(page))

    return whole



def has_class(name: str) -> str:
    """Attribute regex: the class list holds ``name``."""
    return rf"""class\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>]))"""


def has_id(name: str) -> str:
    """Attribute regex: the id equals ``name``."""
    return rf"""id\s*=\s*(?:"{name}"|'{name}'|{name}(?=[\s>]))"""


def anchors(markup: Column) -> Column:
    """All anchors as ``array<struct<href, text>>`` in page order.

    ``href`` is NULL without the attribute, ``text`` joins the stripped text nodes.
    Character references are still in place; unescape after exploding.
    """
    attribute = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def describe(anchor: Column) -> Column:
        opening = F.regexp_extract(anchor, rf"(?is)\A(<a{_ATTRS}>)", 1)
        href = F.concat(*[F.regexp_extract(opening, attribute, group) for group in (1, 2, 3)])
        body = F.regexp_replace(F.substr(anchor, F.length(opening) + 1), r"(?i)</a\s*>\z", "")
        return F.struct(
            F.when(opening.rlike(attribute), href).alias("href"), inner_text(body).alias("text")
        )

    return F.transform(F.regexp_extract_all(markup, F.lit(_ANCHOR), F.lit(1)), describe)
