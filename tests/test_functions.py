"""Golden values of the column functions."""

from urllib.parse import urljoin

import random

import pytest
from pyspark.sql import functions as F

from abstracta.functions import html, records, text, vectors


def test_strip_text_is_python_strip(values):
    inputs = ["\t a \n", "\x1fa\x85\xa0", " b　", "", " ", None, "a b"]
    assert values(inputs, text.strip_text) == [None if s is None else s.strip() for s in inputs]


@pytest.mark.parametrize(
    "title, dropped",
    [("Nullabc", True), ("Null abc", False), ("Nullabc\n", False), (None, False), ("Null", False),
     ("xNullabc", False), ("Nullé\x1c", False), ("Null é", False)],
)
def test_placeholder_title(values, title, dropped):
    assert values([title], text.is_placeholder_title) == [dropped]


def test_title_case_is_python_title(values):
    inputs = ["self-supervised 3d", "GRAPH neural-NETWORKS", "l'été éa", "ßa", "3d2x", "中a b", "", "a\tb", "o'neil's"]
    assert values(inputs, text.title_case) == [s.title() for s in inputs]


def test_format_keywords(values):
    assert values([[" deep learning ", "", None, "3d"]], text.format_keywords, "array<string>") == [
        ["Deep Learning", "3D"]
    ]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("['a', 'b']", ["a", "b"]),
        ('["a"]', ["a"]),
        ("""['a', "it's"]""", ["a", "it's"]),
        ("['a'", ["['a'"]),
        ("a, b", ["a, b"]),
        ("", [""]),
        ("[]", []),
        (" [ 'a' , ]", ["a"]),
        (r"['a\'b']", ["a'b"]),
        ("['a', None, 3]", ["a", None, "3"]),
        ("[a, b]", ["[a, b]"]),
        ("['a\nb']", ["['a\nb']"]),
    ],
)
def test_parse_keywords(values, raw, expected):
    assert values([raw], text.parse_keywords) == [expected]


def test_split_authors(values):
    assert values(["A B, ,C ,", None, ""], text.split_authors) == [["A B", "C"], [], []]


def test_two_decimals_are_python_format(values):
    rng = random.Random(5)
    numbers = [0.815, 0.125, 2.675, 0.005, 1.005, 0.0, 0.995, 99.995, 0.375, 12345.675]
    numbers += [round(rng.random() * 3, 3) for _ in range(3000)] + [rng.random() for _ in range(500)]
    assert values(numbers, text._two_decimals, "double") == [f"{n:.2f}" for n in numbers]


def test_safe_filename(spark):
    row = spark.range(1).select(
        text.safe_filename(F.lit(123), F.lit(0.815), F.lit("ICLR: 2026"), F.lit("A/B testing? - x_y")).alias("f")
    ).head()
    assert row["f"] == "123 - 0.81 - ICLR 2026 - AB testing - x_y.pdf"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('{"value": "a"}', "a"), ("a", "a"), ('"a"', "a"), ('{"value": ["a","b"]}', '["a","b"]'),
        ('{"value": null}', None), ("null", None), ('{"k": 1}', '{"k": 1}'), ("12", "12"), (None, None),
        ('{"value": 3}', "3"), ("", ""),
    ],
)
def test_unwrap_value(values, raw, expected):
    assert values([raw], records.unwrap_value) == [expected]


def test_normalize_pdf_url(values):
    base = "https://openreview.net/"
    inputs = ["/pdf/x.pdf", "//pdf/x.pdf", base + "pdf/x.pdf", "", "http://other/x.pdf", None]
    assert values(inputs, records.normalize_pdf_url) == [
        base + "pdf/x.pdf", base + "pdf/x.pdf", base + "pdf/x.pdf", "", base + "http://other/x.pdf", None
    ]


def test_resolve_url_is_urljoin(spark):
    bases = ["https://a.org/x/y.html?q=1#f", "http://a.org", "https://a.org/x/", "https://a.org:8080/x/y/z"]
    hrefs = ["b.html", "/b/c", "//c.net/d", "?q=2", "#top", "", "../b", "../../../b", "./b", "b/../c/./d", "..", ".",
             "https://z.org/p/../q", "mailto:a@b", "b?x=/../y", "/../b", "b/", "/"]
    pairs = [(b, h) for b in bases for h in hrefs]
    rows = spark.createDataFrame(pairs, "base string, href string")
    found = {(r[0], r[1]): r[2] for r in rows.select("base", "href", records.resolve_url(F.col("base"), F.col("href"))).collect()}
    wrong = {p: (found[p], urljoin(*p)) for p in pairs if found[p] != urljoin(*p)}
    assert not wrong


def test_coalesce_title(spark):
    rows = spark.createDataFrame([("d", "l"), ("", "l"), (None, "l")], "a string, b string")
    got = [r[0] for r in rows.select(records.coalesce_title(F.col("a"), F.col("b"))).collect()]
    assert got == ["d", "l", "l"]


def test_scores(values):
    assert values([0.0, 0.25, 1.0, 1.2], vectors.score_search, "double") == [1.0, 0.75, 0.0, 1.2]
    assert values([0.0, 1.0, 2.0], vectors.score_affinity, "double") == [1.0, 0.5, 0.0]


PAGE = """<html><!-- <a href="/no">no</a> --><body>
<dl><dt class="ptitle big"><br><a href="/content/a.html">A <b>title</b> &amp; more</a></dt>
<dt class='ptitle'><a>no address</a><a href="">x</a><a class="t" href='b.html?x=1&amp;y=2'>Second</a></dt></dl>
<div class="other"><a href="/html/c.html">C</a></div></body></html>"""


def test_anchors(values):
    found = values([PAGE], lambda x: html.anchors(html.visible(x)))[0]
    assert [(a["href"], a["text"]) for a in found] == [
        ("/content/a.html", "Atitle&amp; more"), (None, "no address"), ("", "x"), ("b.html?x=1&amp;y=2", "Second"),
        ("/html/c.html", "C"),
    ]


def test_element_by_id_and_class(values):
    page = '<div class="a"><p ID="papertitle" x=">">T<br>U</p></div><div class="bibref pre-x">B</div><span id=abstract>Z</span>'
    assert values([page], lambda x: html.element(x, "p", html.has_id("papertitle"))) == ["T<br>U"]
    assert values([page], lambda x: html.element(x, "div", html.has_class("bibref"))) == ["B"]
    assert values([page], lambda x: html.element(x, "span", html.has_id("abstract"))) == ["Z"]
    assert values([page], lambda x: html.element(x, "div", html.has_class("bib"))) == [None]


def test_unescape(values):
    assert values(["a &amp; b &eacute; &#39; &copy", None, "x"], html.unescape_html) == ["a & b é ' ©", None, "x"]


def test_decision_class(values):
    given = ["ICLR 2025 Oral", "ICLR 2025 poster", "NeurIPS 2024 spotlight", "Submitted to ICLR 2026", "ICLR 2026 Conference Withdrawn Submission",
             "ICLR 2023 notable top 5%", "ICLR 2023 notable top 25%", "Rejected Submission", "ICML 2024", None, "", "Temporal 2024"]
    assert values(given, records.decision_class) == [
        "oral", "poster", "spotlight", "submitted", "withdrawn", "oral", "spotlight", "rejected", None, None, None, None
    ]
