"""Stand-in tables for the collection's own, derived from the given tables.

Each is one SELECT that Spark and DuckDB read alike, over the given tables and
earlier stand-ins. Flags vary with the keys, so good and broken rules, every
status and both kinds of site are all there. A third of the articles belongs to
site 1, so every query meets a hot site.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import stored

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FILES = 8  # of every stand-in that is written, at least
FILE_ROWS = 25_000  # rows of such a file, about
# Read from the given tables whenever they are asked for, so that a query moves only the columns it needs: articles repeat the
# texts of documents, images and results are long texts made of a few numbers. Page-like ones are dealt out for their parsers.
VIEWS = {"v_contenturls", "v_images", "v_image_results", "v_article_results", "v_event_clock"}
DEALT = {"v_bodies", "v_account_articles"}
# Groups of the largest table, narrow already: written where they are worked out.
GROUPED = {"v_contenttags", "v_known_bridge"}
NOW = 1700000000  # for anything stamped
CLOCK = 4000  # for what is due: the sites' clocks run from 0 to 4999

_HOST = "concat('http://s', CAST(s_suppkey + 1 AS STRING), '.example.org"

SQL: dict[str, str] = {
    "v_sites": f"""
SELECT s_suppkey + 1 AS sid, s_name AS sitename, {_HOST}/') AS siteurl,
  CASE WHEN s_suppkey % 5 = 0 THEN {_HOST}/start') ELSE '' END AS entryurl,
  CASE WHEN s_suppkey % 7 = 6 THEN '' WHEN s_suppkey % 7 = 5 THEN '{{bad'
    WHEN s_suppkey % 7 = 4 THEN '{{"url":"ftp://x/<num>","numfirst":1,"numlast":3}}'
    ELSE concat('{{"url":"http://s', CAST(s_suppkey + 1 AS STRING), '.example.org/list/<num>',
      CASE WHEN s_suppkey % 2 = 1 THEN '?t=<timestamp>' ELSE '' END, '","numfirst":',
      CASE WHEN s_suppkey % 11 = 10 THEN '"1"' ELSE CAST(s_suppkey % 3 AS STRING) END,
      CASE WHEN s_suppkey % 13 = 12 THEN '' ELSE concat(',"numlast":', CAST(s_suppkey % 5 AS STRING)) END, '}}') END AS urlformat,
  CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 1 END AS isenable,
  CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END AS isweixin,
  CASE WHEN s_suppkey % 16 = 15 THEN '' WHEN s_suppkey % 16 = 14 THEN '{{"keyword":""}}'
    WHEN s_suppkey % 16 = 13 THEN '{{"keyword":"k"}}' WHEN s_suppkey % 8 = 7 THEN '{{"keyword":"k","contenttype":0}}'
    WHEN s_suppkey % 8 = 3 THEN '{{"keyword":"k","contenttype":1}}' WHEN s_suppkey % 8 = 2 THEN '{{"keyword":5}}'
    ELSE '{{"keyword":"k","contenttype":2}}' END AS wxconfig,
  0 AS isbrowser, 0 AS isscroll, CAST(s_suppkey % 2 AS INT) AS islocal,
  CASE WHEN s_suppkey % 6 = 5 THEN '{{"contenturl":"| data || link"}}'
    WHEN s_suppkey % 12 = 3 THEN '{{"contenturl":"| data link"}}'
    WHEN s_suppkey % 12 = 9 THEN '{{"contenturl":null}}' ELSE '' END AS listjson,
  CASE WHEN s_suppkey % 6 = 4 THEN '{{"list":"","contenturl":"a"}}' WHEN s_suppkey % 6 = 5 THEN ''
    WHEN s_suppkey % 6 = 1 THEN '{{"list":"nav > ul > li","contenturl":"a","urlprefix":"https://","attr":""}}'
    WHEN s_suppkey % 6 = 2 THEN '{{"list":"nav","contenturl":"li a","attr":"href"}}'
    ELSE '{{"list":"nav > ul > li","contenturl":"a"}}' END AS listhtml,
  CASE WHEN s_suppkey % 8 = 6 THEN '{{"content":"| data || link","title":"| data || link"}}'
    WHEN s_suppkey % 8 = 5 THEN '{{"content":"| data link","title":"| data"}}' ELSE '' END AS contentjson,
  CASE WHEN s_suppkey % 8 >= 5 AND s_suppkey % 8 < 7 THEN ''
    WHEN s_suppkey % 8 = 7 THEN '{{"content":"article"}}' WHEN s_suppkey % 8 = 4 THEN '{{"content":"article","title":"h1","tag":[]}}'
    ELSE '{{"content":"article","title":"h1","author":"div.ad","tag":"nav > ul > li > a","titleimage":"article img"}}' END AS contenthtml,
  20 AS gap_s, 3600 AS schedule, CAST((s_suppkey * 37) % 5000 AS INT) AS lastfetch, '' AS parseerror,
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS listcreated
FROM supplier""",
    "v_listurls": """
SELECT p_partkey + 1 AS luid, p_partkey % (SELECT count(*) FROM supplier) + 1 AS sid,
  concat('http://s', CAST(p_partkey % (SELECT count(*) FROM supplier) + 1 AS STRING), '.example.org/list/', CAST(p_partkey % 9 AS STRING)) AS listurl,
  '' AS source, 0 AS dateline, 0 AS lastupdate, CAST(p_size AS INT) AS connectcount, CAST(p_size AS INT) AS parsecount,
  CASE WHEN p_partkey < (SELECT count(*) FROM supplier) THEN 1 ELSE 0 END AS isfirst,
  CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS isenable, CAST(p_partkey % 5 AS INT) AS status,
  '' AS connecterror, '' AS parseerror, 0 AS duration
FROM part""",
    "v_contenturls": """
SELECT o_orderkey + 1 AS cuid, o_custkey AS luid, sid, concat('http://s', CAST(sid AS STRING), '.example.org/a/', CAST(o_orderkey AS STRING)) AS url,
  '' AS source, CAST(CAST(o_orderdate AS DATE) AS STRING) AS postdate, 0 AS dateline, CAST(o_custkey AS INT) AS lastupdate,
  concat('T', CAST(o_orderkey % 500 AS STRING)) AS title, o_orderpriority AS author, o_orderstatus AS extrainfo, text AS contenttext, '' AS contentsource,
  concat('<p class="c">', lang, '</p>', chr(10), '<img src="http://i.example.org/', CAST(o_orderkey AS STRING), '.png" width="3" alt="x">', chr(10), '<img style="s" class="c">') AS contentabsurl,
  concat('<div><img data-src="d" src="upload/', CAST(o_orderkey AS STRING), '"></div>') AS contentlocalurl,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey * 20 + 1 ELSE 0 END AS titleimageid,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 11 = 1 THEN 1 ELSE 2 END AS indexfinish,
  CAST(o_orderkey % 2 AS INT) AS imagefinish,
  CASE WHEN o_orderkey % 7 < 4 THEN 2 ELSE CAST(o_orderkey % 5 AS INT) END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' ELSE '' END AS connecterror,
  CASE WHEN o_orderkey % 17 = 0 THEN 'bad page' ELSE '' END AS parseerror, 0 AS duration
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey % (SELECT count(*) FROM supplier) + 1 END AS sid,
  o_orderkey % (SELECT count(*) FROM documents) AS body_id FROM orders) o JOIN documents ON doc_id = body_id""",
    # Body images of an article, one per line number, and title images.
    "v_images": """
SELECT l_orderkey * 20 + l_linenumber * 2 AS imgid, l_orderkey + 1 AS cuid, max(l_suppkey) + 1 AS sid,
  concat('http://img.example.org/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS urlabs,
  concat('/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS urlsrc, 0 AS dateline, 0 AS lastupdate,
  concat('upload/', CAST(max(l_suppkey) + 1 AS STRING), '/') AS path, concat('f', CAST(l_linenumber AS STRING)) AS filename, CAST(0 AS BIGINT) AS size,
  min(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'O' THEN 3 ELSE 2 END) AS status, '' AS connecterror, 0 AS duration
FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL
SELECT o_orderkey * 20 + 1, o_orderkey + 1, o_custkey % 7 + 1, concat('http://img.example.org/', CAST(o_orderkey AS STRING), '/title'),
  '/title', 0, 0, 'upload/t/', concat('t', CAST(o_orderkey AS STRING)), CAST(7 AS BIGINT), CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END, '', 0
FROM orders WHERE o_orderstatus <> 'P'""",
    "v_articletags": """
SELECT CAST(substr(p_brand, 7) AS BIGINT) AS tid, p_brand AS tagname FROM part GROUP BY p_brand""",
    "v_contenttags": """
SELECT (l_orderkey + 1) * 1000 + tid AS ctid, tid, l_orderkey + 1 AS cuid
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN v_articletags ON tagname = p_brand GROUP BY tid, l_orderkey""",
    # What was stored before a batch: the brands with at least the usual number of parts, the tags of returned lines.
    "v_known_tags": """
SELECT CAST(substr(p_brand, 7) AS BIGINT) AS tid, p_brand AS tagname FROM part GROUP BY p_brand
HAVING count(*) * (SELECT count(DISTINCT p_brand) FROM part) >= (SELECT count(*) FROM part)""",
    "v_known_bridge": """
SELECT (l_orderkey + 1) * 1000 + tid AS ctid, tid, l_orderkey + 1 AS cuid
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN v_articletags ON tagname = p_brand WHERE l_returnflag = 'R' GROUP BY tid, l_orderkey""",
    # Fetched HTML list pages; a few fetches failed.
    "v_list_pages": """
SELECT page_id AS attempt, page_id % 7 + 1 AS luid, page_id % (SELECT count(*) FROM supplier) + 1 AS sid, url, html AS body,
  CASE WHEN page_id % 17 = 16 THEN 'timeout' ELSE '' END AS connecterror, CAST(page_id % 900 AS INT) AS duration,
  CAST(4000 + page_id AS INT) AS fetched_at
FROM pages""",
    # Fetched JSON pages with a rule each, by market segment.
    "v_json_pages": """
SELECT c_custkey AS page_id, concat('http://s', CAST(c_custkey AS STRING), '.example.org/api/list') AS url, '' AS connecterror,
  CASE WHEN c_nationkey = 3 THEN '<html>' ELSE concat('{"data":[{"link":"/c/', CAST(c_custkey AS STRING), '","x":{"link":" d/', CAST(c_custkey AS STRING),
    '"}},{"link":"http://e.example.org/', CAST(c_custkey AS STRING), '"},{"link":', CAST(c_custkey AS STRING),
    '}],"meta":{"title":" ', c_name, ' ","author":{"name":"', c_mktsegment, '"},"n":', CAST(c_nationkey AS STRING), ',"img":"i.png"}}') END AS body,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '{"contenturl":"| data || link","extraprefix":"http://h.example.org/p/<id>"}'
    WHEN 'BUILDING' THEN '{"contenturl":"| data || link","urlprefix":"/c/","extraprefix":"http://h.example.org/p/<id>"}'
    WHEN 'MACHINERY' THEN '{"contenturl":"| none || link"}' WHEN 'HOUSEHOLD' THEN '{"contenturl":"data"}'
    ELSE '{"contenturl":"| data || link"}' END AS listjson,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '{"content":"| data || link","title":"| meta | title","author":"| meta | author | name","tag":"|| link","titleimage":"| meta | img"}'
    WHEN 'BUILDING' THEN '{"content":"| meta | n","title":"| meta || name","author":"| none","postdate":"| meta | author","titleimage":"| none"}'
    WHEN 'HOUSEHOLD' THEN '{"title":"| meta | title"}'
    ELSE '{"content":"| meta | title","title":"| meta | n","postdate":"|| n","titleimage":"| data || link"}' END AS contentjson
FROM customer""",
    # Article bodies: text with a title, up to three images, and bare text at the top.
    "v_bodies": """
SELECT doc_id + 1 AS cuid, doc_id % (SELECT count(*) FROM supplier) + 1 AS sid,
  concat('http://s', CAST(doc_id % (SELECT count(*) FROM supplier) + 1 AS STRING), '.example.org/p/', CAST(doc_id AS STRING)) AS url,
  concat(CASE WHEN lang = 'de' THEN 'bare ' ELSE '' END, '<h2>', source, '</h2><p>',
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</p>',
    CASE WHEN lang = 'fr' THEN '' ELSE concat('<img src="/img/', CAST(doc_id AS STRING), '.png" width="10" class="c" alt="t">') END,
    CASE WHEN lang = 'en' THEN '<p><img src="b.png" data-src="z" height="1"></p><img alt="n">' ELSE '' END) AS content
FROM documents""",
    # Results of article fetches, every document once and the first tries of some articles again.
    "v_article_results": """
SELECT cuid AS attempt, cuid, sid, url, concat('<html>', CAST(cuid AS STRING)) AS source, content, concat('N', CAST(cuid AS STRING)) AS title, 'w' AS author, '2020-01-02' AS postdate,
  CASE cuid % 5 WHEN 0 THEN '' WHEN 1 THEN 'Brand#3,new a,,' WHEN 2 THEN ',Brand#4,Brand#4' WHEN 3 THEN concat('new ', CAST(cuid % 23 AS STRING), ',Brand#1') ELSE ' ' END AS tag,
  CASE WHEN cuid % 3 = 0 THEN concat('http://img.example.org/t', CAST(cuid AS STRING)) ELSE '' END AS titleimage,
  CAST(cuid % 100 AS INT) AS duration, CASE WHEN cuid % 41 = 0 THEN 'no rule' ELSE '' END AS joberror,
  CASE WHEN cuid % 29 = 0 THEN 'timeout' ELSE '' END AS connecterror, CASE WHEN cuid % 31 = 0 THEN 'bad page' ELSE '' END AS parseerror,
  CAST(5000 + cuid % 77 AS INT) AS fetched_at
FROM v_bodies""",
    # Saved account pages: search results and histories, one per customer.
    "v_account_lists": """
SELECT c_custkey AS page_id, concat('http://a.example.org/w/', CAST(c_custkey AS STRING)) AS url, '' AS connecterror, c_custkey % 2 AS contenttype,
  CASE WHEN c_nationkey = 5 THEN '<p>nothing</p>' WHEN c_custkey % 2 = 0 THEN
    concat('<html><body><div class="news-box"><ul class="news-list"><li d="1"><div class="img-box"><a data-z="z"><img src="/i/', CAST(c_custkey AS STRING),
      '.jpg"></a></div><div class="txt-box"><h3><a href="/s?id=', CAST(c_custkey AS STRING), '&amp;k=1">', c_name, ' <em>', c_mktsegment,
      '</em></a></h3></div></li><li d="2"><div class="txt-box"><h3><a href="http://b.example.org/x">', c_mktsegment, '</a></h3></div></li><li>ad</li></ul></div>')
  ELSE concat('<div id="history"><div msgid="1"><span class="weui_media_hd" style="background-image:url(http://i.example.org/', CAST(c_custkey AS STRING),
      ')"></span><h4 class="weui_media_title" hrefs="/h/', CAST(c_custkey AS STRING), '"> ', c_name, '</h4><p class="weui_media_extra_info">',
      CAST(c_nationkey AS STRING), '</p></div><div msgid="2"><h4 class="weui_media_title big" hrefs="/n">no</h4></div></div>') END AS body
FROM customer""",
    # Saved account articles: 0 to 3 images, one or two authors, some without a title.
    "v_account_articles": """
SELECT cuid AS attempt, cuid, sid, concat('http://a.example.org/art/', CAST(cuid AS STRING)) AS url,
  CASE WHEN cuid % 37 = 0 THEN 'timeout' ELSE '' END AS connecterror, '' AS joberror, 5 AS duration, CAST(6000 + cuid % 99 AS INT) AS fetched_at,
  concat('<html><body><h2 id="activity-name"> ', CASE WHEN cuid % 19 = 0 THEN '' ELSE concat('A', CAST(cuid AS STRING)) END, '</h2>',
    '<div class="rich_media_meta_list"><em id="post-date">2016-05-1', CAST(cuid % 10 AS STRING), '</em><em class="rich_media_meta rich_media_meta_text">first</em>',
    CASE WHEN cuid % 2 = 0 THEN '<em class="rich_media_meta rich_media_meta_text">second</em>' ELSE '' END, '</div><div id="js_content"><p>',
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</p>',
    CASE WHEN cuid % 4 >= 1 THEN concat('<img data-src="http://m.example.org/', CAST(cuid AS STRING), '/1">') ELSE '' END,
    CASE WHEN cuid % 4 >= 2 THEN '<img alt="none">' ELSE '' END,
    CASE WHEN cuid % 4 >= 3 THEN concat('<img data-src="http://m.example.org/', CAST(cuid AS STRING), '/3">') ELSE '' END,
    '</div><span id="sg_readNum3">', CAST(cuid % 1000 AS STRING), '</span><span id="sg_likeNum3">', CAST(cuid % 7 AS STRING), '</span></body></html>') AS body, text
FROM (SELECT doc_id + 1 AS cuid, doc_id % (SELECT count(*) FROM supplier) + 1 AS sid, text FROM documents) d""",
    # A saved list page for every site.
    "v_site_lists": """
SELECT sid, concat('http://a.example.org/site/', CAST(sid AS STRING)) AS url, '' AS connecterror,
  CASE WHEN wxconfig LIKE '%:0}' THEN concat('<div class="news-box"><ul class="news-list"><li d><div class="txt-box"><h3><a href="/1">T', CAST(sid AS STRING),
    '</a></h3></div></li><li d><div class="txt-box"><h3><a href="/2">New</a></h3></div></li><li d><div class="txt-box"><h3><a href="/3">New</a></h3></div></li></ul></div>')
  ELSE concat('<div id="history"><div msgid="1"><h4 class="weui_media_title" hrefs="/4">T1</h4><p class="weui_media_extra_info">d1</p></div>',
    '<div msgid="2"><h4 class="weui_media_title" hrefs="/5">N', CAST(sid AS STRING), '</h4></div></div>') END AS body
FROM v_sites""",
    # Results of image fetches, for all images but those still waiting.
    "v_image_results": """
SELECT imgid AS attempt, imgid, imgid * 3 AS size, 4 AS duration, CASE WHEN imgid % 6 = 4 THEN 'gone' ELSE '' END AS connecterror, 7000 AS fetched_at
FROM v_images WHERE status <> 0""",
    # All pages as if from one host, so that links repeat across pages.
    "v_host_pages": """
SELECT page_id AS page, page_id % 7 + 1 AS luid, CAST(1 AS BIGINT) AS sid, 'http://h.example.org/' AS url, html AS body, '' AS connecterror,
  '{"list":"nav > ul","contenturl":"li > a"}' AS listhtml, url AS page_url
FROM pages""",
    # Items of account lists, some known by title.
    "v_items": """
SELECT c_custkey AS page, c_nationkey AS pos, c_custkey % 3 + 1 AS sid, concat('T', CAST(c_custkey % 700 AS STRING)) AS title,
  concat('http://w.example.org/', CAST(c_custkey AS STRING)) AS url, c_mktsegment AS postdate
FROM customer""",
    # Fetch results with a clock: users stand for sites.
    "v_fetches": """
SELECT event_id AS attempt, user_id + 1 AS sid, user_id * 3 + 1 AS luid, CAST(FLOOR(value) AS INT) AS amount, props, event_type,
  CAST(FLOOR(epoch_of_ts) AS INT) AS fetched_at
FROM v_event_clock""",
}

# The one place where the engines differ: seconds of a timestamp.
_CLOCK = "SELECT *, {} AS epoch_of_ts FROM events"
SPARK_CLOCK = _CLOCK.format("unix_seconds(CAST(ts AS TIMESTAMP))")
DUCKDB_CLOCK = _CLOCK.format("epoch(ts)")


@functools.cache
def needs(name: str) -> tuple[str, ...]:
    """Stand-ins a stand-in or a query text is built on, itself left out, in build order."""
    text = SQL.get(name, name)
    found: list[str] = []
    for used in dict.fromkeys(re.findall(r"\bv_\w+", text)):
        if used != name and (used in SQL or used == "v_event_clock"):
            for one in (*(needs(used) if used in SQL else ()), used):
                if one not in found:
                    found.append(one)
    return tuple(found)


def with_standins(query: str) -> str:
    """A DuckDB query over stand-ins, self-contained."""
    parts = [f"{name} AS ({SQL.get(name, DUCKDB_CLOCK).strip()})" for name in needs(query)]
    if not parts:
        return query.strip()
    head = query.strip()
    if head[:5].upper() == "WITH ":
        recursive = head[5:15].upper() == "RECURSIVE "
        rest = head[15:] if recursive else head[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}, {rest}"
    return f"WITH {', '.join(parts)} {head}"


def _frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The frames already registered as views for a folder; another folder starts over."""
    held = getattr(spark, "_standins", None)
    if held is None or held[0] != folder:
        held = spark._standins = (folder, {})
    return held[1]


def given(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    frames = _frames(spark, folder)
    if table not in frames:
        frames[table] = spark.read.parquet(f"{folder}/{table}.parquet")
        frames[table].createOrReplaceTempView(table)
    return frames[table]


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A query over given tables and stand-ins."""
    for table in set(re.findall(r"\b[a-z]+\b", text)) & set(GIVEN):
        given(spark, folder, table)
    for name in needs(text):
        _view(spark, folder, name)
    return spark.sql(text)


def _view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stand-in: a view, or written once per session as the collection would keep it, in files of like size."""
    frames = _frames(spark, folder)
    if name not in frames:
        rows = sql(spark, folder, SQL.get(name, SPARK_CLOCK))
        if name in GROUPED:
            rows = stored(rows)
        elif name not in VIEWS:
            dealt = rows.repartition(max(FILES, math.ceil(rows.count() / FILE_ROWS)))
            rows = dealt if name in DEALT else stored(dealt)
        frames[name] = rows
        frames[name].createOrReplaceTempView(name)
    return frames[name]


def standin(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stand-in as a frame."""
    frame = _view(spark, folder, name)
    return frame.withColumnRenamed("gap_s", "interval") if name == "v_sites" else frame
