"""Commit jobs and queries on hand-written rows."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import extract
from gleaner.plans import commit, dryrun, queries
from gleaner.session import stored
from gleaner.sources.tables import conform
from tests.test_operators import empty, state

NOW = 1462924800


def by_key(frame, key):
    return {row[key]: row for row in frame.collect()}


def list_results(spark, rows):
    return spark.createDataFrame(
        rows,
        "attempt bigint, luid bigint, sid bigint, source string, links array<string>, duration int, joberror string, "
        "connecterror string, parseerror string, fetched_at int",
    )


def test_list_results(spark):
    sites = state(spark, "sites", [(1, 10), (2, 99)], "sid bigint, lastfetch int")
    listurls = state(spark, "listurls", [(1, 1, 3), (2, 2, 0), (3, 2, 0)], "luid bigint, sid bigint, connectcount int")
    articles = state(spark, "contenturls", [(5, "known")], "cuid bigint, url string")
    results = list_results(
        spark,
        [
            (1, 1, 1, "s1", ["a", "known"], 7, "", "", "", 50),
            (2, 1, 1, "", [], 8, "", "timeout", "", 60),
            (3, 2, 2, "s3", ["b", "a"], 9, "", "", "", 70),
        ],
    )
    after = commit.commit_lists(results, sites, listurls, articles, NOW)
    pages = by_key(after["listurls"], "luid")
    assert (pages[1].status, pages[1].connectcount, pages[1].parsecount, pages[1].lastupdate) == (3, 5, 2, 60)
    assert (pages[2].status, pages[2].source, pages[3].status, pages[3].connectcount) == (2, "s3", 0, 0)
    assert {sid: row.lastfetch for sid, row in by_key(after["sites"], "sid").items()} == {1: 60, 2: 99}
    assert {row.cuid: (row.url, row.luid) for row in after["contenturls"].collect()} == {5: ("known", 0), 6: ("a", 1), 7: ("b", 2)}


def test_article_results(spark):
    columns = (
        "attempt bigint, cuid bigint, sid bigint, url string, source string, content string, title string, author string, "
        "postdate string, tag string, titleimage string, duration int, joberror string, connecterror string, "
        "parseerror string, fetched_at int"
    )
    results = spark.createDataFrame(
        [
            (1, 1, 1, "http://h/a", "s", "<p>x</p><img src='/i'><img>", "T", "w", "d", "a,b", "http://h/t", 1, "", "", "", 50),
            (2, 2, 1, "http://h/b", "s", "<p>y</p>", "U", "w", "d", " ", "http://h/u", 1, "", "", "", 51),
            (3, 3, 1, "http://h/c", "", "", "", "", "", "c", "", 1, "", "timeout", "", 52),
            (4, 2, 1, "http://h/b", "s2", "<p>z</p>", "V", "w", "d", "b", "", 1, "", "", "", 53),
        ],
        columns,
    )
    sites = state(spark, "sites", [(1, 10)], "sid bigint, lastfetch int")
    articles = state(spark, "contenturls", [(i, f"old{i}", 7) for i in range(1, 5)], "cuid bigint, title string, titleimageid bigint")
    after = commit.commit_articles(
        results, sites, articles, empty(spark, "images"), empty(spark, "articletags"), empty(spark, "contenttags"), NOW
    )
    rows = by_key(after["contenturls"], "cuid")
    assert (rows[1].status, rows[1].title, rows[1].imagefinish, rows[1].titleimageid) == (2, "T", 0, 2)
    assert (rows[2].status, rows[2].title, rows[2].imagefinish, rows[2].titleimageid, rows[2].contenttext) == (2, "V", 1, 0, "z")
    assert (rows[3].status, rows[3].title, rows[3].connecterror, rows[3].titleimageid) == (3, "", "timeout", 0)
    assert (rows[4].status, rows[4].title, rows[4].titleimageid) == (0, "old4", 7)
    images = by_key(after["images"], "imgid")
    assert {key: (row.cuid, row.urlabs, row.path) for key, row in images.items()} == {
        1: (1, "http://h/i", "upload/1/201605/11/"), 2: (1, "http://h/t", "upload/1/201605/11/"),
    }
    assert f'src="upload/1/201605/11/{images[1].filename}"' in rows[1].contentlocalurl
    assert {row.tagname for row in after["articletags"].collect()} == {"a", "b"}
    assert after["contenttags"].count() == 3
    assert after["sites"].first().lastfetch == 53


def test_image_results(spark):
    images = state(spark, "images", [(1, 1, 0), (2, 1, 3), (3, 2, 0), (4, 2, 0), (5, 3, 2)], "imgid bigint, cuid bigint, status int")
    articles = state(spark, "contenturls", [(1,), (2,), (3,)], "cuid bigint")
    results = spark.createDataFrame(
        [(1, 1, 9, 1, "", 50), (2, 3, 0, 1, "gone", 51)],
        "attempt bigint, imgid bigint, size bigint, duration int, connecterror string, fetched_at int",
    )
    after = commit.commit_images(results, images, articles)
    assert {row.imgid: (row.status, row.size) for row in after["images"].collect()} == {
        1: (2, 9), 2: (3, 0), 3: (3, 0), 4: (0, 0), 5: (2, 0)
    }
    # Article 3 has all its images, but none of them came in now.
    assert {row.cuid: row.imagefinish for row in after["contenturls"].collect()} == {1: 1, 2: 0, 3: 0}


def test_listing(spark):
    sites = state(spark, "sites", [(1, "s1", 0), (2, "s2", 1)], "sid bigint, sitename string, islocal int")
    rows = [(i, 1 + i % 2, 2, i % 3 % 2, 100 + i if i % 4 == 0 else 0, "x" * 300) for i in range(1, 13)] + [(13, 1, 0, 1, 0, "")]
    articles = state(spark, "contenturls", rows, "cuid bigint, sid bigint, status int, imagefinish int, titleimageid bigint, contenttext string")
    images = state(spark, "images", [(100 + i, f"u{i}", "p/", f"f{i}") for i in range(1, 13)], "imgid bigint, urlabs string, path string, filename string")
    visible = [i for i in range(12, 0, -1) if 1 + i % 2 == 1 or i % 3 % 2 == 1]
    page = queries.content_list(articles, sites, images, 0, 2, 3)
    found = sorted(page.collect(), key=lambda row: -row.cuid)
    assert [row.cuid for row in found] == visible[3:6]
    for row in found:
        image = ("" if row.cuid % 4 else f"u{row.cuid}") if row.sid == 1 else ("" if row.cuid % 4 else f"p/f{row.cuid}")
        assert row.titleimage == image and len(row.content) == 200
    large = queries.content_list(articles, sites, images, 0, 1, 20000)
    assert sorted(row.cuid for row in large.collect()) == sorted(visible)
    assert queries.content_count(articles, sites).first().rscount == len(visible)
    answer = json.loads(queries.content_list_json(articles, sites, images, 2, 1, 2).first().json)
    assert answer["errmsg"] == "" and answer["rscount"] == len([i for i in visible if i % 2])
    assert [item["cuid"] for item in answer["contentlists"]] == [i for i in visible if i % 2][:2]


def test_article_detail(spark):
    sites = state(spark, "sites", [(1, "s", 0)], "sid bigint, sitename string, islocal int")
    articles = state(
        spark, "contenturls", [(1, 1, 2, '<p>x</p>\n<img src="u" width="3">'), (2, 1, 0, "")], "cuid bigint, sid bigint, status int, contentabsurl string"
    )
    bridge = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "ctid bigint, tid bigint, cuid bigint")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "tid bigint, tagname string")
    asked = spark.createDataFrame([(1,), (2,), (9,)], "cuid bigint")
    answers = queries.content_json(articles, sites, empty(spark, "images"), bridge, names, asked)
    found = {row.cuid: json.loads(row.json) for row in answers.collect()}
    assert found[1]["content"]["content"] == '<p>x</p>\n<img src="u">' and found[1]["content"]["titleimage"] == ""
    assert found[1]["content"]["tags"] == [{"tagid": 1, "tagname": "a"}, {"tagid": 2, "tagname": "b"}]
    assert found[2] == found[9] == {"errmsg": "content not found", "content": None}


def test_dry_run(spark):
    sites = state(
        spark,
        "sites",
        [(1, json.dumps({"url": "http://h/l/<num>", "numlast": 9}), '{"list":"ul","contenturl":"a"}', '{"content":"p","title":"h1"}')],
        "sid bigint, urlformat string, listhtml string, contenthtml string",
    )
    links = "<ul>" + "".join(f'<a href="/a/{i}">' for i in range(8))
    pages = spark.createDataFrame(
        [("http://h/l/0", links), ("http://h/a/1", "<h1>T</h1><p>" + "x" * 300), ("http://h/l/5", links)], "url string, body string"
    )
    report = dryrun.dry_run(sites, conform(pages, "raw_pages"), NOW).collect()
    shown = {row.link: row for row in report if row.link}
    assert sorted(shown) == [f"http://h/a/{i}" for i in range(8)]
    assert sorted(link for link, row in shown.items() if row.linkfollowed) == [f"http://h/a/{i}" for i in range(5)]
    assert shown["http://h/a/6"].title is None and shown["http://h/a/6"].articleerror is None
    assert {row.listurl for row in report} == {f"http://h/l/{i}" for i in range(10)}
    assert {row.listurl for row in report if row.pagefollowed} == {"http://h/l/0", "http://h/l/1"}
    assert shown["http://h/a/1"].title == "T" and len(shown["http://h/a/1"].content) == 100
    assert shown["http://h/a/2"].articleerror != ""
    assert [row.listerror != "" for row in report if row.listurl == "http://h/l/1"] == [True]


def test_collected_pages_become_articles(spark):
    """From fetched list pages to a listing, through every commit."""
    sites = state(
        spark,
        "sites",
        [(1, "s", 0, '{"list":"ul","contenturl":"a"}', '{"content":"div","title":"h1","tag":"b"}')],
        "sid bigint, sitename string, islocal int, listhtml string, contenthtml string",
    )
    fetched = spark.createDataFrame(
        [(1, 1, 1, "http://h/l", '<ul><a href="/1"><a href="/2"></ul>', "", 3, 50)],
        "attempt bigint, luid bigint, sid bigint, url string, body string, connecterror string, duration int, fetched_at int",
    )
    listed = commit.commit_lists(
        extract.list_results(fetched, sites), sites, state(spark, "listurls", [(1, 1)], "luid bigint, sid bigint"), empty(spark, "contenturls"), NOW
    )
    articles = listed["contenturls"]
    pages = articles.select(
        F.col("cuid").alias("attempt"), "cuid", "sid", "url", F.concat(F.lit("<h1>"), "url", F.lit("</h1><div><p>x</p></div><b>k</b>")).alias("body"),
        F.lit("").alias("connecterror"), F.lit(1).alias("duration"), F.lit(60).alias("fetched_at"),
    )
    after = commit.commit_articles(
        extract.article_results(pages, sites), listed["sites"], articles, empty(spark, "images"), empty(spark, "articletags"), empty(spark, "contenttags"), NOW
    )
    page = queries.content_list(after["contenturls"], after["sites"], after["images"]).collect()
    assert sorted((row.title, row.content) for row in page) == [("http://h/1", "x"), ("http://h/2", "x")]
    feed = queries.index_feed(after["contenturls"], after["contenttags"], after["articletags"], 1).collect()
    assert [(row.url, row.tags) for row in feed] == [("http://h/2", "k")]


def test_pages_are_taken_as_last_fetched(spark):
    rows = [("a", "old", "", 1), ("a", "new", "", 5), ("a", "newer", "", 9), ("b", "x", "timeout", 3), ("b", "y", "", 3), ("b", "y", "", 3), ("c", "late", "", 8), ("d", "other", "", 2)]
    pages = spark.createDataFrame(rows, "url string, body string, connecterror string, fetched_at int")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("none",)], "url string")
    assert sorted(map(tuple, dryrun.latest_fetches(wanted, pages, 5).collect())) == [("a", "new", ""), ("b", "y", "")]
    assert sorted(map(tuple, dryrun.latest_fetches(wanted, pages).collect())) == [("a", "newer", ""), ("b", "y", ""), ("c", "late", "")]
    assert sorted(r.body for r in dryrun.latest_fetches(wanted, pages.drop("fetched_at")).collect())[-1] == "y"


def shuffled_bytes(frame) -> int:
    """Bytes that a query puts through shuffles, before compression, from its executed plan."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            todo.append(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        children = node.children()
        todo.extend(children.apply(place) for place in range(children.size()))
    return total


def test_bodies_of_articles_that_stay_are_not_moved(spark):
    texts = spark.range(20).select(F.col("id").alias("body_id"), F.rpad(F.col("id").cast("string"), 10_000, "x").alias("contenttext"))
    narrow = spark.range(2000).select((F.col("id") + 1).alias("cuid"), (F.col("id") % 20).alias("body_id"), F.lit("T").alias("title"))
    articles = conform(narrow.join(texts, "body_id").drop("body_id"), "contenturls")
    page = '<div id="js_content"><p>new</p></div><h2 id="activity-name">N</h2>'
    pages = spark.createDataFrame(
        [(k, k, 1, f"http://h/{k}", page, 1, "", "", 50) for k in (1, 2, 2000, 9999)],
        "attempt bigint, cuid bigint, sid bigint, url string, body string, duration int, joberror string, connecterror string, fetched_at int",
    )
    sites = state(spark, "sites", [(1, 10)], "sid bigint, lastfetch int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = commit.commit_account_articles(pages, sites, articles, empty(spark, "images"), NOW)["contenturls"]
        assert after.columns == articles.columns and after.dtypes == articles.dtypes
        # 20 MB of bodies lie in the articles, 0.2 MB in the texts they come from.
        assert 200_000 < shuffled_bytes(after) < 3_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = by_key(after, "cuid")
    assert len(rows) == 2000 and {key for key, row in rows.items() if row.contenttext == "new"} == {1, 2, 2000}
    assert (rows[2].title, rows[2].lastupdate, len(rows[3].contenttext), rows[3].lastupdate) == ("T", 50, 10_000, 0)


@pytest.mark.parametrize("most", [commit.SENT_KEYS, 3])
def test_no_stored_body_moves_when_spark_sends_no_table_by_itself(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(commit, "SENT_KEYS", most)
    table = stored(spark.range(1, 200).select(F.col("id").alias("cuid"), (F.col("id") % 40).alias("text"), F.concat(F.lit("body"), F.col("id") % 40).alias("contenttext")))
    changes = stored(spark.createDataFrame([(k, f"new{k}") for k in (3, 4, 77, 500)], "cuid bigint, contenttext string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = commit.update_bodies(table, changes, changes, "cuid")
        plan = after._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [given for given in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan) if "contenttext#" in given and "cuid#" in given]
        rows = {r.cuid: (r.text, r.contenttext) for r in after.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {k: (k % 40, f"new{k}" if k in (3, 4, 77) else f"body{k % 40}") for k in range(1, 200)}
    # The bodies that come new meet the kept columns of their rows; the stored ones stay, unless there are too many keys to send.
    assert len(moved) == (1 if most > 3 else 2)
