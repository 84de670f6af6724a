"""Fields of a page in one pass: a tokenizer with a selector matcher, in Arrow batches.

The page is cut into tags and text once; comments, scripts and styles are passed over. Every
wanted field follows the tags with a state of its own: how far its path of selectors is open,
and how deep its elements hold their own tag. The pass ends as soon as all fields are known.

An element ends at the close that matches it by depth; one whose tag cannot nest (``p``, ``li``,
...) at the first close. An element that never ends is not found. Of a path the first element of
each step counts.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F

from abstracta.functions.text import WHITESPACE

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][^\s/>]*)({_ATTRS})>|<[a-z/!]{_ATTRS}>", re.S | re.I
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
# Nodes that cannot hold their own tag; another opening one is text inside them.
UNCLOSED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option", "title", "style", "script", "a"))


@dataclass(frozen=True)
class Selector:
    """An element by tag (none: any) and by an attribute that has one of ``values``.

    ``class`` is a list, of which one name has to be among the values.
    """

    tags: tuple[str, ...] = ()
    attribute: str = ""
    values: tuple[str, ...] = ()

    def matches(self, tag: str, attributes: dict[str, str]) -> bool:
        if self.tags and tag not in self.tags:
            return False
        if not self.attribute:
            return True
        value = attributes.get(self.attribute)
        found = () if value is None else value.split() if self.attribute == "class" else (value,)
        return any(v in self.values for v in found)


@dataclass(frozen=True)
class Field:
    """What a page is asked for: the first element of a path, or the links of all elements.

    ``kind`` is ``text`` (text nodes, stripped, joined), ``raw`` (all text as it stands) or
    ``links`` (``href`` and text of the anchors in elements that the one selector matches, or
    anywhere without one).
    """

    name: str
    path: tuple[Selector, ...] = ()
    kind: str = "text"
    joiner: str = " "


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


class _First:
    """The first element of a path."""

    def __init__(self, field: Field) -> None:
        self.field, self.open, self.done = field, [], False
        self.nodes: list[str] = []
        self.value: str | None = None

    def text(self, node: str) -> None:
        if len(self.open) == len(self.field.path):
            self.nodes.append(node)

    def opened(self, tag: str, attributes) -> None:
        for element in self.open:
            if element[0] == tag and tag not in UNCLOSED:
                element[1] += 1
        level = len(self.open)
        if level < len(self.field.path) and self.field.path[level].matches(tag, attributes()):
            self.open.append([tag, 1])

    def closed(self, tag: str) -> None:
        for level, element in enumerate(self.open):
            if element[0] == tag:
                element[1] -= 1
                if not element[1]:
                    if level == len(self.field.path) - 1:
                        self.value = self._joined()
                    self.done = True  # also where a step ends without the next one in it
                    return

    def _joined(self) -> str:
        if self.field.kind == "raw":
            return "".join(self.nodes)
        stripped = (node.strip(WHITESPACE) for node in self.nodes)
        return self.field.joiner.join(node for node in stripped if node)

    def result(self) -> str | None:
        return None if self.value is None else html_lib.unescape(self.value) if "&" in self.value else self.value


class _Links:
    """Anchors inside all elements that a selector matches; an element counts when it has ended."""

    def __init__(self, field: Field) -> None:
        self.field, self.done = field, False
        self.element: list | None = None if field.path else ["", 1]
        self.anchor: tuple[str | None, list[str]] | None = None
        self.held: list[tuple[str | None, str]] = []
        self.found: list[tuple[str | None, str]] = []

    def text(self, node: str) -> None:
        if self.anchor:
            self.anchor[1].append(node)

    def opened(self, tag: str, attributes) -> None:
        if self.element is None:
            if self.field.path[0].matches(tag, attributes()):
                self.element = [tag, 1]
        elif tag == self.element[0] and tag not in UNCLOSED:
            self.element[1] += 1
        if tag == "a" and self.element and not self.anchor:
            self.anchor = attributes().get("href"), []

    def closed(self, tag: str) -> None:
        if tag == "a" and self.anchor:
            nodes = (node.strip(WHITESPACE) for node in self.anchor[1])
            self.held.append((self.anchor[0], "".join(node for node in nodes if node)))
            self.anchor = None
        if self.element and tag == self.element[0]:
            self.element[1] -= 1
            if not self.element[1]:
                self.found += self.held
                self.element, self.anchor, self.held = None, None, []

    def result(self) -> list[dict]:
        found = self.found if self.field.path else self.held
        return [{"href": None if href is None else html_lib.unescape(href), "text": html_lib.unescape(text)} for href, text in found]


def parse_page(page: str, fields: Sequence[Field]) -> list:
    """The fields of one page."""
    states = [(_Links if field.kind == "links" else _First)(field) for field in fields]
    live, at, pending = list(states), 0, []
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            pending.append(page[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None and page.startswith("<!--", token.start()) or token[1]:
            continue  # what is hidden does not part a text
        if pending:
            node, pending = "".join(pending), []
            for state in live:
                state.text(node)
        if tag is None:
            continue
        tag = tag.lower()
        if token[2]:
            for state in live:
                state.closed(tag)
        else:
            known: list[dict] = []

            def attributes(text=token[4], known=known) -> dict[str, str]:
                if not known:
                    known.append(attributes_of(text))
                return known[0]

            for state in live:
                state.opened(tag, attributes)
        if any(state.done for state in live):
            live = [state for state in live if not state.done]
            if not live:
                break
    return [state.result() for state in states]


def page_fields(html: Column, fields: Sequence[Field]) -> Column:
    """A struct of all fields of each page: strings (NULL for none) and arrays of links."""
    kinds = {"links": "array<struct<href: string, text: string>>"}
    link = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
    schema = pa.struct([(field.name, link if field.kind == "links" else pa.string()) for field in fields])
    names = [field.name for field in fields]

    @F.arrow_udf("struct<" + ", ".join(f"{field.name}: {kinds.get(field.kind, 'string')}" for field in fields) + ">")
    def parse(pages: pa.Array) -> pa.Array:
        rows = (None if page is None else dict(zip(names, parse_page(page, fields))) for page in pages.to_pylist())
        return pa.array(rows, schema)

    return parse.asNondeterministic()(html)
