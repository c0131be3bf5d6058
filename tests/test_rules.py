"""Rule checks on hand-written rules."""

from __future__ import annotations

import json

import pytest

from gleaner.functions import rules
from gleaner.operators import audit

URL = "http://a/<num>"


def verdicts(spark, check, column, given):
    frame = spark.createDataFrame([(number, rule) for number, rule in enumerate(given)], f"n int, {column} string")
    rows = frame.select("n", check().alias("err")).orderBy("n").collect()
    return [row.err == "" for row in rows]


@pytest.mark.parametrize(
    "check, column, good, bad",
    [
        (
            rules.urlformat_error,
            "urlformat",
            [
                {"url": URL, "numfirst": 2, "numlast": 4},
                {"url": URL},
                {"url": URL, "numfirst": 5, "numlast": 1},
                {"url": URL, "numfirst": 1.0},
                {"url": "https://a/<num>"},
            ],
            [
                {"url": "http://a/"},
                {"url": "ftp://a/<num>"},
                {"url": URL, "numfirst": -1},
                {"url": URL, "numfirst": "1"},
                {"url": URL, "numlast": None},
                {"url": URL, "numlast": 1.5},
                {"url": URL, "numlast": 3000000000},
                {"url": 7},
                {},
                [],
            ],
        ),
        (
            rules.listjson_error,
            "listjson",
            [{"contenturl": "| data || link"}, {"contenturl": " || link "}, {"contenturl": "| a", "urlprefix": 3}],
            [{"contenturl": "| data link"}, {"contenturl": "data"}, {"contenturl": ""}, {"contenturl": "|  a"}, {"contenturl": None}, {}],
        ),
        (
            rules.listhtml_error,
            "listhtml",
            [{"list": "ul", "contenturl": "a"}, {"list": " ", "contenturl": " "}],
            [{"list": "ul"}, {"list": "", "contenturl": "a"}, {"list": "ul", "contenturl": 1}],
        ),
        (
            rules.contentjson_error,
            "contentjson",
            [
                {"content": "| a", "title": "|| b"},
                {"content": "| a", "title": "|| b", "tag": " ", "author": "| c"},
            ],
            [
                {"content": "| a"},
                {"content": "| a", "title": "b"},
                {"content": "| a", "title": "| b", "tag": "c"},
                {"content": "| a", "title": "| b", "postdate": []},
            ],
        ),
        (
            rules.contenthtml_error,
            "contenthtml",
            [{"content": "article", "title": "h1"}, {"content": "a", "title": "b", "tag": ""}],
            [{"content": "a"}, {"content": "a", "title": ""}, {"content": "a", "title": "b", "author": {}}],
        ),
        (
            rules.wxconfig_error,
            "wxconfig",
            [{"keyword": "k"}, {"keyword": "k", "contenttype": 1}],
            [{"keyword": "k", "contenttype": 2}, {"keyword": ""}, {"contenttype": 0}, {"keyword": "k", "contenttype": "1"}],
        ),
    ],
)
def test_checks(spark, check, column, good, bad):
    assert verdicts(spark, check, column, map(json.dumps, good)) == [True] * len(good)
    assert verdicts(spark, check, column, [*map(json.dumps, bad), "", "{bad", "null"]) == [False] * (len(bad) + 3)


def site(spark, **given):
    columns = "urlformat listjson listhtml contentjson contenthtml".split()
    row = {name: given.get(name, "") for name in columns}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{name} string" for name in columns))
    return frame.select(rules.site_error().alias("err")).first().err


def test_first_error_of_a_site_wins(spark):
    url = json.dumps({"url": URL})
    html, json_rule = '{"list":"ul","contenturl":"a"}', '{"contenturl":"| a"}'
    article = '{"content":"a","title":"b"}'
    assert site(spark) == "urlformat is empty"
    assert site(spark, urlformat="{") == "urlformat rule is not valid"
    both = site(spark, urlformat=url, listjson=json_rule, listhtml=html, contenthtml="{broken")
    assert both == "needs one of listjson and listhtml"
    assert site(spark, urlformat=url, listhtml="{") == "listhtml rule is not valid"
    assert site(spark, urlformat=url, listhtml=html) == "needs one of contentjson and contenthtml"
    assert site(spark, urlformat=url, listhtml=html, contenthtml="{}") == "contenthtml rule is not valid"
    assert site(spark, urlformat=url, listhtml=html, contenthtml=article, contentjson=" ") == ""


def test_generated_urls(spark):
    sites = spark.createDataFrame(
        [
            (1, json.dumps({"url": URL, "numfirst": 2, "numlast": 4}), ""),
            (2, json.dumps({"url": URL, "numfirst": 5, "numlast": 1}), ""),
            (3, json.dumps({"url": "http://b/<num>/<timestamp>", "numlast": 1}), " "),
            (4, json.dumps({"url": URL, "numfirst": 9, "numlast": 9}), "http://a/start"),
            (5, "{", "http://a/start"),
        ],
        "sid bigint, urlformat string, entryurl string",
    )
    generated = {tuple(row) for row in audit.generated_urls(sites, 77).collect()}
    assert generated == {
        (1, 0, "http://a/2"), (1, 1, "http://a/3"), (1, 2, "http://a/4"),
        (3, 0, "http://b/0/77"), (3, 1, "http://b/1/77"), (4, 0, "http://a/9"),
    }
    listed = {tuple(row) for row in audit.site_list_urls(sites, 77).collect()}
    assert listed == (generated - {(4, 0, "http://a/9")}) | {(4, 0, "http://a/start"), (4, 1, "http://a/9")}


def test_a_very_long_range_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 7)
    rule = json.dumps({"url": URL, "numfirst": 3, "numlast": 52})
    sites = spark.createDataFrame([(1, rule)], "sid bigint, urlformat string")
    rows = sorted((row.pos, row.listurl) for row in audit.generated_urls(sites, 0).collect())
    assert rows == [(number, f"http://a/{number + 3}") for number in range(50)]


def test_a_rule_with_a_repeated_member_takes_the_last(spark):
    given = ['{"list":"","list":"a","contenturl":"b"}', '{"list":"a","list":"","contenturl":"b"}']
    assert verdicts(spark, rules.listhtml_error, "listhtml", given) == [True, False]
