"""The page tree: parsing, selecting, text, markup, links."""

from __future__ import annotations

import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gleaner.functions.markup import inner_html, parse, resolve, select, text_of, text_of_all
from gleaner.functions.urls import resolve_html_link


def texts(page, selector):
    return [text_of(node) for node in select(parse(page), selector)]


def test_implied_end_tags():
    page = "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<p>y<div>z</div><dl><dt>k<dd>v</dl>"
    assert texts(page, "li") == ["a", "b c", "c", "d"]
    assert texts(page, "p") == ["x", "y"]
    assert texts(page, "dl > dt") == ["k"] and texts(page, "dl > dd") == ["v"]


def test_tables_get_a_body_and_rows():
    page = "<table><tr><td>1<td>2<tr><td>3</table>"
    assert texts(page, "table > tbody > tr > td") == ["1", "2", "3"]


def test_unclosed_inline_elements_end_with_their_paragraph():
    assert texts("<div><p><b>x<br>y<p>z</div><span>w</span>", "p") == ["x y", "z"]


def test_head_script_and_comments():
    page = '<!doctype html><title>T &amp; t</title><script>"<p>no</p>"</script><!-- <p>no</p> --><p>yes</p>'
    assert texts(page, "p") == ["yes"]
    assert texts(page, "head > title") == ["T & t"]
    assert text_of(select(parse(page), "body")[0]) == "yes"


def test_attributes():
    node = select(parse("<a HREF='x&amp;y' data-k=1 checked class=\"b  a\">"), "a")[0]
    assert node.get("href") == "x&y" and node.get("data-k") == "1"
    assert node.get("checked") == "" and node.get("none") is None


@pytest.mark.parametrize(
    "selector, found",
    [
        ("[class=a b]", ["1"]),
        ("div[class=a b ]", ["1"]),
        (".A", ["1", "2"]),
        ("#i", ["3"]),
        ("section > p", ["4"]),
        ("section p, p#i", ["3", "4", "5"]),
        ("section div > p", ["5"]),
        ("[data-k]", ["2"]),
        ("*[data-k^=v]", ["2"]),
        ("p:first", None),
    ],
)
def test_selectors(selector, found):
    page = (
        '<div class="a b">1</div><div class="b a" data-k="val">2</div><p id="i">3</p>'
        "<section><p>4</p><div><p>5</p></div></section>"
    )
    if found is None:
        with pytest.raises(ValueError):
            select(parse(page), selector)
    else:
        assert texts(page, selector) == found


def test_selection_within_an_element_looks_at_no_parent_above_it():
    item = select(parse('<ul class="k"><li><a>x</a></li></ul>'), "li")[0]
    assert [node.tag for node in select(item, "li > a")] == ["a"]
    assert select(item, "ul a") == []


def test_text():
    assert texts("<div> a\n\t b<p>c</p>d<br>e &lt;f&gt;</div>", "div") == ["a b cd e <f>"]
    assert texts("<div><pre> a  b </pre></div>", "pre") == ["a  b"]
    assert text_of_all(select(parse("<p>a</p><img><p>b</p><img>"), "body > *")) == "a  b "


def test_markup_is_written_back():
    page = '<p class="x">a &amp; b<br>c &lt; d</p><img src="u?a=1&amp;b=2" alt="">'
    assert inner_html(select(parse(page), "body")[0]) == page


@pytest.mark.parametrize(
    "ref, link",
    [
        ("/x", "http://h/x"), ("y", "http://h/a/b/y"), ("../z", "http://h/a/z"), ("./q", "http://h/a/b/q"),
        ("..", "http://h/a/"), ("?a=1", "http://h/a/b/c.html?a=1"), ("#f", "http://h/a/b/c.html?q=1#f"),
        ("//o.com/p", "http://o.com/p"), ("https://z/1", "https://z/1"), ("javascript:void(0)", ""),
        ("mailto:a@b", "mailto:a@b"), ("", "http://h/a/b/c.html?q=1"), (None, ""), (" /s ", "http://h/s"),
    ],
)
def test_references(ref, link):
    assert resolve("http://h/a/b/c.html?q=1", ref) == link


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/=\"' abpli!-&;\n", max_size=80))
def test_any_page_parses_and_settles(page):
    body = select(parse(page), "body")[0]
    written = inner_html(body)
    again = inner_html(select(parse(f"<body>{written}"), "body")[0])
    assert text_of(select(parse(f"<body>{again}"), "body")[0]) == text_of(select(parse(f"<body>{written}"), "body")[0])


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<a " * 100000, '<a b="' * 50000, "<!--" * 100000, "</x" * 100000, "<div>" * 50000):
        text_of(select(parse(page), "body")[0])
    assert time.time() - began < 20


def test_nested_pages_take_time_linear_in_their_depth():
    began = time.time()
    page = '<div class="q">' + "<div>" * 3000 + "<a>x</a>" + "</div>" * 3000
    assert len(select(parse(page), ".q div > div div a")) == 1
    assert select(parse(page), ".q div span div a") == []
    assert time.time() - began < 1


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/.?#:\u00e9 ", max_size=12), min_size=20, max_size=20))
def test_links_as_columns_equal_links_in_pages(spark, refs):
    bases = ["http://h/a/b/c.html?q=1#f", "https://h", "http://h/../x/./y/", "mailto:a", "x://h/p?q"]
    refs = [*refs, "//o/../p/./q", "http://z/a/../b?x#y", "javascript:a", "../..", "./", "", "#f", "?a", "FTP://h/a/./b"]
    rows = [(base, ref) for base in bases for ref in refs]
    frame = spark.createDataFrame(rows, "page string, ref string").coalesce(1)
    found = frame.select("page", "ref", resolve_html_link(F.col("page"), F.col("ref")).alias("link")).collect()
    assert [(r.page, r.ref, r.link) for r in found] == [(page, ref, resolve(page, ref)) for page, ref in rows]
