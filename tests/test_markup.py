"""Golden pages for the tokenizer, and one pass for all fields of a page."""

import pytest
from pyspark.sql import functions as F

from abstracta.functions import html
from abstracta.functions.markup import Field, Selector, page_fields, parse_page
from abstracta.session import table

DIV = Selector(("div",), "id", ("x",))


def one(page, *path, **options):
    return parse_page(page, [Field("f", path, **options)])[0]


@pytest.mark.parametrize(
    "page, wanted",
    [
        ('<div id="x">a</div><div id="x">b</div>', "a"),
        ('<div id="x"><div>in</div> out</div> more', "in out"),
        ('<div id="x">a<div>b<div>c</div></div>d</div>e', "a b c d"),
        ('<div id="x">never closed', None),
        ('<div id="x"><div>never closed</div>', None),
        ("<div id='x' title='a > b'>quoted</div>", "quoted"),
        ('<div title="<div id=x>" id="x">t</div>', "t"),
        ("<DIV ID=x>case</DIV >", "case"),
        ('<div id="x">a<!-- </div> -->b</div>', "ab"),
        ('<!-- <div id="x">no</div> --><div id="x">yes</div>', "yes"),
        ('<div id="x">a<script>"</div>"</script>b<style>c</style></div>', "ab"),
        ('<div id="x"> a &amp; b <br/> c&nbsp;</div>', "a & b c\xa0"),
        ('<div id="x"></div>', ""),
        ('<div id="xx">no</div><p id="x">no</p>', None),
        ("a < b <div id=x>1 < 2</div>", "1 < 2"),
        ("", None),
    ],
)
def test_golden_elements(page, wanted):
    assert one(page, DIV) == wanted


def test_paths_unclosed_tags_and_kinds():
    page = '<div id="x" class="a b"><p>one<p>two</p><i>three</i></p></div><i>four</i>'
    assert one(page, Selector(("p",))) == "one two"
    assert one(page, DIV, Selector(("i",))) == "three"
    assert one(page, Selector((), "class", ("b",)), Selector(("i",))) == "three"
    assert one(page, Selector((), "class", ("c",))) is None
    assert one("<div id=x><b>no i</b></div><div id=x><i>later</i></div>", DIV, Selector(("i",))) is None
    assert one("<div id=x><i>open</div></i>", DIV, Selector(("i",))) is None
    assert one("<pre> a\n <b>b</b>&lt; </pre>", Selector(("pre",)), kind="raw") == " a\n b< "
    assert one("<i> a </i>", Selector(("i",)), joiner="") == "a"


def test_links():
    page = '''<a href="/0">out</a><li><a href='/1'>o <b>ne</b></a><a>none</a><a href=/2 >two<a href="/in">nested</a></li>
    <li><a href="/3">unfinished</li><li><a href="/4">never closed element</a>'''
    inside = one(page, Selector(("li",)), kind="links")
    assert [(a["href"], a["text"]) for a in inside] == [("/1", "one"), (None, "none"), ("/2", "twonested")]
    everywhere = [a["href"] for a in one(page, kind="links")]
    assert everywhere == ["/0", "/1", None, "/2", "/3"]  # an anchor ends at the first close, others in it are text


def test_fields_come_from_one_evaluation(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    fields = [Field("title", (Selector(("title",)),)), Field("h1", (Selector(("h1",)),)), Field("links", (), "links")]
    found = pages.select("page_id", page_fields(F.col("html"), fields).alias("p")).select("page_id", "p.title", "p.h1", F.size("p.links").alias("n"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    shown = html.visible(F.col("html"))
    old = pages.select(
        "page_id",
        html.unescape_html(html.inner_text(html.element(shown, "title"), " ")).alias("title"),
        html.unescape_html(html.inner_text(html.element(shown, "h1"), " ")).alias("h1"),
        F.size(html.anchors(shown)).alias("n"),
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, old.collect()))


def test_long_pages_take_one_pass():
    page = "<div>" * 2000 + '<div id="x">' + "<p>text</p>" * 200_000 + "</div>" + "</div>" * 2000
    assert len(one(page, DIV).split()) == 200_000
