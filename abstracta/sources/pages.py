"""Landed web pages: list pages to entries, detail pages to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from abstracta.functions.html import anchors, elements, has_class, unescape_html, visible
from abstracta.functions.markup import Field, Selector, page_fields
from abstracta.functions.records import resolve_url
from abstracta.functions.text import split_authors, strip_text

# Where list pages keep titles, and what marks a detail link elsewhere.
TITLE_TAGS = "dt|div|h4"
TITLE_CLASS = "ptitle"
DETAIL_MARKER = "/html/"
BIBTEX_MARKER = "bibtex"
TITLES = Selector(tuple(TITLE_TAGS.split("|")), "class", (TITLE_CLASS,))
_BIBREF = Selector(("div",), "class", ("bibref",))
DETAIL_FIELDS = (
    Field("title", (Selector((), "id", ("papertitle",)),)),
    Field("authors", (Selector((), "id", ("authors",)), Selector(("i",)))),
    Field("abstract", (Selector((), "id", ("abstract",)),)),
    Field("pre", (_BIBREF, Selector(("pre",))), "raw"),
    Field("block", (_BIBREF,), "raw"),
    Field("links", (), "links"),
)


def _usable(links: Column) -> Column:
    return F.filter(links, lambda a: a["href"].isNotNull() & (a["href"] != "") & (a["text"] != ""))


def titled_links(html: Column, tags: str = TITLE_TAGS, attribute: str = has_class(TITLE_CLASS)) -> Column:
    """Anchors with an address and a text inside title nodes."""
    return _usable(anchors(F.array_join(elements(visible(html), tags, attribute), "\n")))


def marked_links(html: Column, marker: str = DETAIL_MARKER) -> Column:
    """Anchors anywhere whose address contains the marker."""
    return F.filter(_usable(anchors(visible(html))), lambda a: F.contains(a["href"], F.lit(marker)))


def list_links(
    html: Column, titles: Selector = TITLES, marker: str | None = DETAIL_MARKER
) -> Column:
    """Usable links of a list page, in one pass: those in title nodes, or else those with the marker.

    ``array<struct<href, text>>`` with character references replaced; no marker, no fallback.
    """
    wanted = [Field("titled", (titles,), "links")]
    if marker is None:
        return _usable(page_fields(html, wanted)["titled"])

    def chosen(page: Column) -> Column:
        marked = F.filter(_usable(page["all"]), lambda a: F.contains(a["href"], F.lit(marker)))
        return with_fallback(_usable(page["titled"]), marked)

    # As the element of a list, a page's fields are evaluated once for both uses.
    found = page_fields(html, [*wanted, Field("all", (), "links")])
    return F.transform(F.array(found), chosen)[0]


def with_fallback(primary: Column, fallback: Column) -> Column:
    """The primary links, or the fallback where a page has none."""
    return F.when(F.size(primary) > 0, primary).otherwise(fallback)


def explode_links(pages: DataFrame, links: Column, base: Column, *keep: str, escaped: bool = True) -> DataFrame:
    """One row per link: ``keep..., pos, title, detail_url``; ``escaped`` ones have character references."""
    exploded = pages.select(*keep, base.alias("_base"), F.posexplode(links).alias("pos", "_link"))
    if not escaped:
        address = resolve_url(F.col("_base"), F.col("_link.href"))
        return exploded.select(*keep, "pos", F.col("_link.text").alias("title"), address.alias("detail_url"))
    plain = exploded.select(
        *keep, "_base", "pos",
        unescape_html("_link.text").alias("title"), unescape_html("_link.href").alias("_href"),
    )
    return plain.select(*keep, "pos", "title", resolve_url(F.col("_base"), F.col("_href")).alias("detail_url"))


def bibtex_link(html: Column, page_url: Column, marker: str = BIBTEX_MARKER) -> Column:
    """Address of the first anchor with the marker in its address or text, any case."""

    def mentions(a: Column) -> Column:
        return F.contains(F.lower(a["href"]), F.lit(marker)) | F.contains(F.lower(a["text"]), F.lit(marker))

    found = F.try_element_at(
        F.filter(anchors(visible(html)), lambda a: a["href"].isNotNull() & mentions(a)), F.lit(1)
    )
    return F.when(found.isNotNull(), resolve_url(page_url, unescape_html(found["href"])))


def extract_details(
    pages: DataFrame, html: str = "html", url: str = "url", *, marker: str = BIBTEX_MARKER
) -> DataFrame:
    """Records of proceedings detail pages; a missing node gives NULL, missing authors ``[]``.

    All fields come from one pass over the page.
    """
    found = pages.select(F.col(url).alias("detail_url"), page_fields(F.col(html), DETAIL_FIELDS).alias("p"))

    def mentions(a: Column) -> Column:
        return F.contains(F.lower(a["href"]), F.lit(marker)) | F.contains(F.lower(a["text"]), F.lit(marker))

    link = F.try_element_at(F.filter("p.links", lambda a: a["href"].isNotNull() & mentions(a)), F.lit(1))
    return found.select(
        "detail_url",
        F.col("p.title").alias("title"),
        split_authors(F.col("p.authors")).alias("authors"),
        F.col("p.abstract").alias("abstract"),
        strip_text(F.coalesce("p.pre", "p.block")).alias("bibtex"),
        F.when(link.isNotNull(), resolve_url(F.col("detail_url"), link["href"])).alias("bibtex_url"),
    )
