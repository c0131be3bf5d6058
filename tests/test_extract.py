"""Extraction on hand-written pages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions.columns import result_status
from gleaner.operators import accounts, bodies, extract
from gleaner.sources.tables import write_paged_by_site

DAY = 1462924800  # 2016-05-11


def pages(spark, body, rule, column, url="http://h/a/l.html", connecterror=""):
    row = (url, body, connecterror, rule if isinstance(rule, str) else json.dumps(rule))
    return spark.createDataFrame([row], f"url string, body string, connecterror string, {column} string")


def status(frame):
    return frame.select(result_status(F.lit(""), F.col("connecterror"), F.col("parseerror"))).first()[0]


def test_html_links(spark):
    page = '<ul><li><a href="/p/1">1</a><li><a href="/q/2">2</a><a href="/p/1">1</a><a>none</a></ul>'
    rule = {"list": "li", "contenturl": "a"}
    links = extract.html_links(pages(spark, page, rule, "listhtml")).first().links
    assert links == ["http://h/p/1", "http://h/q/2", "http://h/p/1", ""]
    prefixed = extract.html_links(pages(spark, page, {**rule, "urlprefix": "http://h/p/"}, "listhtml")).first().links
    assert prefixed == ["http://h/p/1", "http://h/p/1"]
    attribute = extract.html_links(
        pages(spark, '<li><b data-u="x">', {"list": "li", "contenturl": "b", "attr": "data-u"}, "listhtml")
    )
    assert attribute.first().links == ["http://h/a/x"]


def test_links_are_relative_to_the_base_element(spark):
    page = '<head><base href="http://o/d/"></head><ul><li><a href="x"></ul>'
    assert extract.html_links(pages(spark, page, {"list": "li", "contenturl": "a"}, "listhtml")).first().links == ["http://o/d/x"]


def test_html_links_that_fail(spark):
    rule = {"list": "li", "contenturl": "a"}
    assert status(extract.html_links(pages(spark, "<li>", "{", "listhtml"))) == 3
    assert status(extract.html_links(pages(spark, "<li>", rule, "listhtml", connecterror="timeout"))) == 3
    assert status(extract.html_links(pages(spark, "<li>", {**rule, "list": "li:x"}, "listhtml"))) == 4
    assert status(extract.html_links(pages(spark, "<li>", rule, "listhtml"))) == 2


def test_json_links(spark):
    body = json.dumps({"data": [{"link": "a", "x": {"link": "b"}}, {"link": "c"}, {"link": 7}]})

    def links(rule):
        return extract.json_links(pages(spark, body, rule, "listjson", "http://h/api/l.json"))

    assert links({"contenturl": "| data || link"}).first().links == [
        "http://h/api/a", "http://h/api/b", "http://h/api/c", "http://h/api/7",
    ]
    template = {"contenturl": "|| link", "extraprefix": "http://h/p/<id>"}
    assert links(template).first().links == ["http://h/p/a", "http://h/p/b", "http://h/p/c", "http://h/p/7"]
    assert links({**template, "urlprefix": "c"}).first().links == ["http://h/api/c"]
    missing = links({"contenturl": "| none || link"})
    assert missing.first().links == [] and status(missing) == 4
    assert status(extract.json_links(pages(spark, "<p>", {"contenturl": "| a"}, "listjson"))) == 4


def test_deep_json(spark):
    body = '{"a":' * 400 + '{"link":"x"}' + "}" * 400
    linked = extract.json_links(pages(spark, body, {"contenturl": "|| link"}, "listjson", "http://h/l"))
    assert linked.first().links == ["http://h/x"]


def test_html_fields(spark):
    page = (
        '<h1> T <b>t</b></h1><div class="c"><p>x</p><img src="i.png"></div><i class="a">w</i>'
        '<a class="t">k</a><a class="t">l</a>'
    )
    rule = {"content": ".c", "title": "h1", "author": "i:x", "tag": "a.t", "titleimage": ".c img", "postdate": ".none"}
    row = extract.html_fields(pages(spark, page, rule, "contenthtml")).first()
    assert row.content == '<p>x</p><img src="i.png">' and row.title == "T t" and row.tag == "k,l"
    assert row.titleimage == "http://h/a/i.png"
    assert row.author == "" and row.postdate == "" and row.parseerror == ""


def test_json_fields(spark):
    body = json.dumps({"m": {"t": " T ", "n": 3, "i": ""}, "tags": [{"k": "a"}, {"k": "b"}]})
    rule = {"content": "| m", "title": "| m | t", "author": "| none", "tag": "| tags || k", "titleimage": "| m | i"}
    row = extract.json_fields(pages(spark, body, rule, "contentjson", "http://h/x/p.json")).first()
    assert row.title == "T" and row.author == "" and row.tag == "a,b" and row.postdate == ""
    assert json.loads(row.content) == {"t": " T ", "n": 3, "i": ""}
    # The image was found and is empty: it resolves to the folder, as a link would.
    assert row.titleimage == "http://h/x/"
    missing = extract.json_fields(pages(spark, body, {**rule, "titleimage": "| none"}, "contentjson")).first()
    assert missing.titleimage == ""


def test_results_follow_the_rule_a_site_has(spark):
    sites = spark.createDataFrame(
        [(1, '{"list":"li","contenturl":"a"}', "{}"), (2, " ", '{"contenturl":"| u"}'), (3, "", "")],
        "sid bigint, listhtml string, listjson string",
    )
    fetched = spark.createDataFrame(
        [(1, "http://h/1", '<li><a href="/x">'), (2, "http://h/2", '{"u":"/y"}'), (3, "http://h/3", "z")],
        "sid bigint, url string, body string",
    ).withColumn("connecterror", F.lit(""))
    rows = {row.sid: row for row in extract.list_results(fetched, sites).collect()}
    assert rows[1].links == ["http://h/x"] and rows[2].links == ["http://h/y"] and rows[3].links == []
    assert rows[1].joberror == "" and rows[3].joberror != ""
    assert rows[1].source == '<li><a href="/x">' and rows[3].source == ""


def test_pages_in_buckets_of_their_site_do_not_move_for_their_rules(spark, tmp_path):
    sites = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "sid bigint, listhtml string")
    fetched = spark.range(200).select((F.col("id") % 50).alias("sid"), F.lit("b").alias("body"))
    write_paged_by_site(fetched, "paged", str(tmp_path / "t"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ruled = extract.with_site_rules(spark.table("paged"), sites, "listhtml")
        assert ruled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert ruled.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE paged")


def test_json_numbers_stay_as_written():
    document = extract.read_json('{"a":[0.12345678901234567890,1e5,-2,{"b":1.50,"c":null,"é":"x"}],"big":1e999999}')
    assert [extract.json_words(value) for value in document["a"]] == ["0.12345678901234567890", "100000", "-2", '{"b":1.50,"c":null,"é":"x"}']
    assert extract.json_words(document["big"]) == "1E+999999"
    with pytest.raises(ValueError):
        extract.read_json('{"a":NaN}')


def test_bodies(spark):
    content = 'bare <p>x</p><img src="/a.png"><img alt="n">'
    articles = spark.createDataFrame([(5, 3, "http://h/p/1", content)], "cuid bigint, sid bigint, url string, content string")
    row = bodies.normalise_bodies(articles, DAY).first()
    first, second = bodies.image_filename(5, 0), bodies.image_filename(5, 1)
    assert row.contenttext.strip() == "x"
    assert row.contentabsurl == '<p>x</p>\n<img src="http://h/a.png">\n<img alt="n" src="">'
    assert row.contentlocalurl == f'<p>x</p>\n<img src="upload/3/201605/11/{first}">\n<img alt="n" src="upload/3/201605/11/{second}">'
    images = bodies.image_manifest(articles, DAY).collect()
    assert [(image.pos, image.urlabs, image.urlsrc, image.path, image.filename) for image in images] == [
        (0, "http://h/a.png", "/a.png", "upload/3/201605/11/", first)
    ]


def test_reader_body(spark):
    given = [
        '<p class="c"><img src="s" width="1" class="c" alt="t"></p>', None, '<img class="" data-w="1" data-ratio="2" data-src="3" width="4" height="5" style="a>b" x>',
        '<img alt="class=&quot;c&quot; width" style="s"><imgs class="c"><div style="k">', '<img data-class="k" class="c"><img width>',
    ]
    frame = spark.createDataFrame([(k, text) for k, text in enumerate(given)], "k int, c string").orderBy("k")
    assert [row[0] for row in frame.select(bodies.reader_body(F.col("c"))).collect()] == [
        '<p class="c"><img src="s" alt="t"></p>', None, "<img x>", '<img alt="class=&quot;c&quot; width"><imgs class="c"><div style="k">', '<img data-class="k"><img>',
    ]


def account_page(images, authors=1, title="A"):
    names = "".join(f'<em class="rich_media_meta rich_media_meta_text">n{i}</em>' for i in range(authors))
    shown = "".join(f'<img data-src="u{i}">' for i in range(images))
    return (
        f'<h2 id="activity-name">{title}</h2><div class="rich_media_meta_list">{names}</div>'
        f'<div id="js_content"><p>x</p>{shown}</div><span id="sg_readNum3">9</span>'
    )


def test_account_articles(spark):
    given = [account_page(1), account_page(2, 2), account_page(3), account_page(0, 2, "")]
    frame = spark.createDataFrame([(i, 1, page, "") for i, page in enumerate(given)], "cuid bigint, sid bigint, body string, connecterror string")
    rows = {row.cuid: row for row in accounts.account_articles(frame, DAY).collect()}
    assert [rows[i].titleimage for i in range(4)] == ["u0", "", "u1", ""]
    assert [rows[i].author for i in range(4)] == ["", "n1", "", "n1"]
    assert [rows[i].parseerror != "" for i in range(4)] == [False, False, False, True]
    assert rows[1].readcount == "9" and rows[1].likecount == ""
    assert rows[1].contentabsurl.count('src="u') == 4 and len(rows[2].images) == 3


def test_account_lists(spark):
    history = (
        '<div id="history"><div msgid="1"><span class="weui_media_hd" style="background-image:url(http://i/1)"></span>'
        '<h4 class="weui_media_title" hrefs="/s?a=1&amp;b=2"> T </h4><p class="weui_media_extra_info">d</p></div></div>'
    )
    frame = spark.createDataFrame(
        [("http://h/x", history, "", 1), ("http://h/x", "<p>", "", 0)], "url string, body string, connecterror string, contenttype int"
    )
    rows = accounts.account_items(frame, F.col("contenttype")).collect()
    assert [tuple(item) for item in rows[0]["items"]] == [("T", "http://h/s?a=1&b=2", "d", "http://i/1")]
    assert rows[1]["items"] == [] and rows[1].parseerror != ""
