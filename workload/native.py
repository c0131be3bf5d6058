"""Queries over rules, URLs, scalar columns, filters, joins, roll-ups, rankings and keys."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from gleaner.functions import columns, rules, urls
from gleaner.operators import audit, keys, links, rollup, select, tags
from gleaner.operators.extract import explode_links, html_links
from gleaner.session import stored
from workload.registry import query
from workload.standins import CLOCK, NOW


# ---- rule checks -----------------------------------------------------------------------------------------------------

def _kind(column: str, key: str) -> str:
    return f"coalesce(json_type({column}, '$.{key}'), 'MISSING')"


def _string(column: str, key: str) -> str:
    return f"coalesce(json_extract_string({column}, '$.{key}'), '')"


def _is_text(column: str, key: str) -> str:
    return f"{_kind(column, key)} IN ('MISSING', 'VARCHAR')"


def _is_int(column: str, key: str) -> str:
    return f"{_kind(column, key)} IN ('MISSING', 'UBIGINT', 'BIGINT')"


def _path(text: str) -> str:
    parts = f"string_split(trim({text}), ' ')"
    return (
        f"(len({parts}) % 2 = 0 AND len(list_filter({parts}, lambda x, i: i % 2 = 1 AND x NOT IN ('|', '||'))) = 0)"
    )


def _valid(column: str, condition: str) -> str:
    return f"(CASE WHEN json_valid({column}) THEN {condition} ELSE false END)"


URLFORMAT_OK = _valid(
    "urlformat",
    f"{_is_text('urlformat', 'url')} AND {_is_int('urlformat', 'numfirst')} AND {_is_int('urlformat', 'numlast')} "
    f"AND regexp_matches({_string('urlformat', 'url')}, '^https?://') AND contains({_string('urlformat', 'url')}, '<num>') "
    f"AND coalesce(CAST(json_extract(urlformat, '$.numfirst') AS VARCHAR), '0') NOT LIKE '-%' "
    f"AND coalesce(CAST(json_extract(urlformat, '$.numlast') AS VARCHAR), '0') NOT LIKE '-%'",
)
LISTJSON_OK = _valid("listjson", f"{_is_text('listjson', 'contenturl')} AND {_path(_string('listjson', 'contenturl'))}")
LISTHTML_OK = _valid(
    "listhtml",
    f"{_is_text('listhtml', 'list')} AND {_is_text('listhtml', 'contenturl')} "
    f"AND {_string('listhtml', 'list')} <> '' AND {_string('listhtml', 'contenturl')} <> ''",
)
OPTIONAL = ("author", "postdate", "tag", "titleimage")
CONTENTJSON_OK = _valid(
    "contentjson",
    " AND ".join(
        [f"{_is_text('contentjson', k)} AND {_path(_string('contentjson', k))}" for k in ("content", "title")]
        + [
            f"{_is_text('contentjson', k)} AND (trim({_string('contentjson', k)}) = '' OR {_path(_string('contentjson', k))})"
            for k in OPTIONAL
        ]
    ),
)
CONTENTHTML_OK = _valid(
    "contenthtml",
    " AND ".join(
        [f"{_is_text('contenthtml', k)} AND {_string('contenthtml', k)} <> ''" for k in ("content", "title")]
        + [_is_text("contenthtml", k) for k in OPTIONAL]
    ),
)
WXCONFIG_OK = _valid(
    "wxconfig",
    f"{_is_text('wxconfig', 'keyword')} AND {_is_int('wxconfig', 'contenttype')} AND {_string('wxconfig', 'keyword')} <> '' "
    f"AND coalesce(CAST(json_extract(wxconfig, '$.contenttype') AS VARCHAR), '0') IN ('0', '1')",
)
SITE_OK = (
    f"(urlformat <> '' AND {URLFORMAT_OK} AND (trim(listjson) <> '') <> (trim(listhtml) <> '') "
    f"AND (trim(listjson) = '' OR {LISTJSON_OK}) AND (trim(listhtml) = '' OR {LISTHTML_OK}) "
    f"AND (trim(contentjson) <> '') <> (trim(contenthtml) <> '') "
    f"AND (trim(contentjson) = '' OR {CONTENTJSON_OK}) AND (trim(contenthtml) = '' OR {CONTENTHTML_OK}))"
)


def _rule_query(name: str, column: str, check, condition: str) -> None:
    @query(name, f"SELECT sid, CAST({condition} AS INT) AS ok FROM v_sites")
    def run(t):
        return audit.rule_errors(t.sites, check, column).select("sid", (F.col("err") == "").cast("int").alias("ok"))


_rule_query("v1_urlformat_check", "urlformat", rules.urlformat_error, URLFORMAT_OK)
_rule_query("v2_listjson_check", "listjson", rules.listjson_error, LISTJSON_OK)
_rule_query("v3_listhtml_check", "listhtml", rules.listhtml_error, LISTHTML_OK)
_rule_query("v4_contentjson_check", "contentjson", rules.contentjson_error, CONTENTJSON_OK)
_rule_query("v5_contenthtml_check", "contenthtml", rules.contenthtml_error, CONTENTHTML_OK)
_rule_query("v6_wxconfig_check", "wxconfig", rules.wxconfig_error, WXCONFIG_OK)


@query(
    "v7_site_audit",
    f"""SELECT sid, CASE WHEN isweixin = 0 AND NOT ok THEN 0 ELSE isenable END AS isenable,
  CASE WHEN isweixin = 1 THEN listcreated WHEN ok THEN 1 ELSE 0 END AS listcreated,
  CAST(isweixin = 0 AND NOT ok AS INT) AS failed FROM (SELECT *, {SITE_OK} AS ok FROM v_sites)""",
)
def site_audit(t):
    """Plain sites after their audit."""
    return audit.audit_sites(t.sites).select(
        "sid", "isenable", "listcreated", (F.col("parseerror") != "").cast("int").alias("failed")
    )


# Generated list pages of good rules, and with the entry page in front.
GENERATED = f"""gen AS (SELECT sid, isenable, entryurl, CAST(i - nf AS BIGINT) AS gpos,
    replace(replace(u, '<num>', CAST(i AS VARCHAR)), '<timestamp>', '{NOW}') AS listurl
  FROM (SELECT *, unnest(range(nf, nl + 1)) AS i FROM (SELECT sid, isenable, entryurl, json_extract_string(urlformat, '$.url') AS u,
    coalesce(CAST(json_extract_string(urlformat, '$.numfirst') AS BIGINT), 0) AS nf,
    coalesce(CAST(json_extract_string(urlformat, '$.numlast') AS BIGINT), 0) AS nl
    FROM v_sites WHERE {URLFORMAT_OK} AND __WHICH__))),
  wanted AS (SELECT sid, isenable, gpos + CASE WHEN entryurl <> '' THEN 1 ELSE 0 END AS pos, listurl FROM gen
    UNION ALL SELECT sid, isenable, 0, entryurl FROM v_sites WHERE entryurl <> '' AND {URLFORMAT_OK} AND __WHICH__)"""

# Stored list pages after reconciliation; `base` is what is stored before.
RECONCILED = """heads AS (SELECT sid, listurl AS head FROM wanted WHERE pos = 0),
  added AS (SELECT (SELECT max(luid) FROM v_listurls) + row_number() OVER (ORDER BY w.sid, pos) AS luid, w.sid, w.listurl, w.isenable,
      CAST(w.listurl = head AS INT) AS isfirst FROM wanted w JOIN heads h ON h.sid = w.sid
    WHERE NOT EXISTS (SELECT 1 FROM base l WHERE l.sid = w.sid AND l.listurl = w.listurl)),
  kept AS (SELECT luid, b.sid, listurl,
      CASE WHEN head IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.sid = b.sid AND w.listurl = b.listurl) THEN 0 ELSE isenable END AS isenable,
      CASE WHEN head IS NULL THEN isfirst ELSE CAST(listurl = head AS INT) END AS isfirst
    FROM base b LEFT JOIN heads h ON h.sid = b.sid)
  SELECT * FROM kept UNION ALL SELECT * FROM added"""


@query(
    "v7_audit_listurls",
    f"""WITH {GENERATED.replace('__WHICH__', f'isweixin = 0 AND listcreated = 0 AND {SITE_OK}')},
  base AS (SELECT luid, l.sid, listurl, CASE WHEN s.sid IS NULL THEN l.isenable ELSE 0 END AS isenable, isfirst
    FROM v_listurls l LEFT JOIN (SELECT sid FROM v_sites WHERE isweixin = 0 AND NOT {SITE_OK}) s ON s.sid = l.sid), {RECONCILED}""",
)
def audit_listurls(t):
    """List pages after the audit of the plain sites."""
    after = audit.audit_listurls(t.sites, t.state("listurls"), NOW)
    return after.select("luid", "sid", "listurl", "isenable", "isfirst")


@query(
    "v8_account_audit",
    f"""SELECT sid, CASE WHEN isweixin = 1 AND NOT ok THEN 0 ELSE isenable END AS isenable,
  CASE WHEN isweixin = 1 AND NOT ok THEN 0 ELSE listcreated END AS listcreated,
  CAST(isweixin = 1 AND NOT ok AS INT) AS failed FROM (SELECT *, {WXCONFIG_OK} AS ok FROM v_sites)""",
)
def account_audit(t):
    """Account sites after their audit."""
    return audit.audit_account_sites(t.sites).select(
        "sid", "isenable", "listcreated", (F.col("parseerror") != "").cast("int").alias("failed")
    )


# ---- URLs ------------------------------------------------------------------------------------------------------------

@query("u1_generated_urls", f"WITH {GENERATED.replace('__WHICH__', 'true')} SELECT sid, gpos AS pos, listurl FROM gen")
def generated_urls(t):
    """List pages every rule describes."""
    return audit.generated_urls(t.sites, NOW)


@query("u2_site_list_urls", f"WITH {GENERATED.replace('__WHICH__', 'true')} SELECT sid, pos, listurl FROM wanted")
def site_list_urls(t):
    """List pages with the entry page in front."""
    return audit.site_list_urls(t.sites, NOW)


JSON_REF = "CASE c_nationkey % 3 WHEN 0 THEN concat('/x/', c_name) WHEN 1 THEN concat(c_name, '.html') ELSE concat('https://z/', c_name) END"


@query(
    "u3_json_links",
    f"""SELECT c_custkey, CASE WHEN ref LIKE 'http%' THEN ref WHEN ref LIKE '/%' THEN concat('http://s', c_custkey, '.example.org', ref)
  ELSE concat('http://s', c_custkey, '.example.org/api/', ref) END AS link
  FROM (SELECT c_custkey, {JSON_REF} AS ref FROM customer)""",
)
def json_refs(t):
    """References as JSON pages write them, made absolute."""
    pages = t.sql(
        f"SELECT c_custkey, concat('http://s', c_custkey, '.example.org/api/list') AS url, {JSON_REF} AS ref FROM customer"
    )
    page = F.col("url")
    return pages.select(
        "c_custkey", urls.resolve_json_link(F.col("ref"), urls.site_root(page), urls.folder_url(page)).alias("link")
    )


PAGE_REFS = """SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN concat('/x/', page_id) WHEN 1 THEN concat('y', page_id) WHEN 2 THEN '?q=1'
  WHEN 3 THEN '#f' WHEN 4 THEN '//o.example.org/a' WHEN 5 THEN 'http://k/l' WHEN 6 THEN 'javascript:void(0)' ELSE '../up' END AS ref FROM pages"""


@query(
    "u4_html_links",
    f"""SELECT page_id, CASE WHEN ref LIKE 'http:%' THEN ref WHEN ref LIKE 'javascript%' THEN '' WHEN ref LIKE '//%' THEN concat(scheme, ':', ref)
    WHEN ref LIKE '/%' THEN concat(origin, ref) WHEN ref LIKE '?%' THEN concat(origin, path, ref) WHEN ref LIKE '#%' THEN concat(origin, path, query, ref)
    WHEN ref = '../up' THEN concat(origin, regexp_replace(regexp_extract(path, '^(.*/)', 1), '[^/]+/$', ''), 'up') ELSE concat(origin, regexp_extract(path, '^(.*/)', 1), ref) END AS link
  FROM (SELECT page_id, ref, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query FROM ({PAGE_REFS}))""",
)
def html_refs(t):
    """References as HTML pages write them, made absolute."""
    return t.sql(PAGE_REFS).select("page_id", urls.resolve_html_link(F.col("url"), F.col("ref")).alias("link"))


@query("u5_id_templates", "SELECT c_custkey, concat('http://h.example.org/p/', c_custkey, '?v=', c_custkey) AS link FROM customer")
def id_templates(t):
    """Article URLs from ids."""
    template = F.lit("http://h.example.org/p/<id>?v=<id>")
    return t.given("customer").select(
        "c_custkey", urls.fill_template(template, F.col("c_custkey").cast("string")).alias("link")
    )


# Links of HTML list pages by the rule of the page's site.
HTML_LINKS = """refs AS (SELECT *, regexp_extract_all(body, '<li><a href="([^"]*)"', 1) AS hrefs, (sid - 1) % 6 AS kind,
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM v_list_pages),
  usable AS (SELECT * FROM refs WHERE connecterror = '' AND kind < 4 AND (kind <> 1 OR url LIKE 'https://%')),
  links AS (SELECT attempt, luid, sid, url, unnest(range(0, len(hrefs))) AS pos, concat(origin, unnest(hrefs)) AS link FROM usable)"""


@query("u6_prefixed_links", f"WITH {HTML_LINKS} SELECT attempt, pos, link FROM links WHERE (sid - 1) % 6 = 1")
def prefixed_links(t):
    """Links of the sites whose rule has a prefix, kept only when they start with it."""
    prefixed = t.sites.filter(columns.json_text(F.col("listhtml"), "urlprefix") != "")
    linked = html_links(t.list_pages.join(prefixed.select("sid", "listhtml"), "sid"))
    return explode_links(linked, "attempt")


# ---- filters and scalar columns --------------------------------------------------------------------------------------

@query("f1_enabled_sites", "SELECT sid, sitename FROM v_sites WHERE isenable = 1 AND isweixin = 0")
def enabled_sites(t):
    """Enabled plain sites."""
    return select.enabled_sites(t.sites, 0).select("sid", "sitename")


DUE_LISTS = f"""SELECT luid, l.sid, listurl FROM v_listurls l JOIN v_sites s ON s.sid = l.sid WHERE l.isenable = 1 AND
  ((status = 0 AND lastfetch + gap_s < {CLOCK}) OR (isfirst = 1 AND status IN (2, 3) AND lastfetch + schedule < {CLOCK}))"""


@query("f2_due_list_pages", DUE_LISTS)
def due_list_pages(t):
    """List pages to read now."""
    return select.due_list_pages(t.listurls, t.sites, CLOCK).select("luid", "sid", "listurl")


def _due_articles(kind: int) -> str:
    return f"""SELECT cuid, c.sid, url FROM v_contenturls c JOIN v_sites s ON s.sid = c.sid
  WHERE status IN (0, 3) AND lastfetch + gap_s < {CLOCK} AND isweixin = {kind}"""


@query("f3_due_articles", _due_articles(0))
def due_articles(t):
    """Articles of plain sites to read now."""
    return select.due_articles(t.contenturls, t.sites, CLOCK, 0).select("cuid", "sid", "url")


@query("f3_due_account_articles", _due_articles(1))
def due_account_articles(t):
    """Articles of account sites to read now."""
    return select.due_articles(t.contenturls, t.sites, CLOCK, 1).select("cuid", "sid", "url")


@query("f4_due_images", "SELECT imgid, sid, urlabs FROM v_images WHERE status IN (0, 3)")
def due_images(t):
    """Images to load now."""
    return select.due_images(t.images).select("imgid", "sid", "urlabs")


@query(
    "f5_due_account_sites",
    f"SELECT sid FROM v_sites WHERE isenable = 1 AND isweixin = 1 AND {CLOCK} - schedule > lastfetch AND {WXCONFIG_OK}",
)
def due_account_sites(t):
    """Account sites whose list is due."""
    return select.due_account_sites(t.sites, CLOCK).select("sid")


VISIBLE = """SELECT c.*, islocal, sitename FROM v_contenturls c JOIN v_sites s ON s.sid = c.sid
  WHERE status = 2 AND (islocal = 0 OR imagefinish = 1)"""


@query("f6_visible_articles", f"SELECT cuid, sid, islocal, imagefinish FROM ({VISIBLE})")
def visible_articles(t):
    """Articles a reader may see."""
    return select.visible_articles(t.contenturls, t.sites, "islocal").select("cuid", "sid", "islocal", "imagefinish")


@query(
    "f7_result_status",
    """SELECT cuid, CASE WHEN extrainfo = 'P' THEN 4 WHEN connecterror <> '' THEN 3 WHEN parseerror <> '' THEN 4 ELSE 2 END AS status
  FROM v_contenturls""",
)
def result_status(t):
    """Status of every article from its errors."""
    job_error = F.when(F.col("extrainfo") == "P", "no rule").otherwise("")
    status = columns.result_status(job_error, F.col("connecterror"), F.col("parseerror"))
    return t.contenturls.select("cuid", status.alias("status"))


@query(
    "f8_reset_in_flight",
    """SELECT cuid AS id, 'article' AS kind, CASE WHEN status = 1 THEN 0 ELSE status END AS status, CASE WHEN indexfinish = 1 THEN 0 ELSE indexfinish END AS indexfinish FROM v_contenturls
  UNION ALL SELECT luid, 'list', CASE WHEN status = 1 THEN 0 ELSE status END, NULL FROM v_listurls
  UNION ALL SELECT imgid, 'image', CASE WHEN status = 1 THEN 0 ELSE status END, NULL FROM v_images""",
)
def reset_in_flight(t):
    """The three work tables after a crash."""
    articles = select.reset_in_flight(t.contenturls).select(F.col("cuid").alias("id"), F.lit("article").alias("kind"), "status", "indexfinish")
    lists = select.reset_in_flight(t.listurls).select(F.col("luid").alias("id"), F.lit("list").alias("kind"), "status")
    images = select.reset_in_flight(t.images).select(F.col("imgid").alias("id"), F.lit("image").alias("kind"), "status")
    return articles.unionByName(lists.unionByName(images), allowMissingColumns=True)


@query("f9_excerpts", "SELECT doc_id, substr(text, 1, 200) AS excerpt, substr(text, 1, 10) AS head FROM documents")
def excerpts(t):
    """The start of every text as a listing shows it."""
    text = F.col("text")
    return t.given("documents").select(
        "doc_id", columns.excerpt(text).alias("excerpt"), columns.excerpt(text, 10).alias("head")
    )


SHOWN_IMAGE = "CASE WHEN islocal = 0 THEN coalesce(urlabs, '') ELSE concat(coalesce(path, ''), coalesce(filename, '')) END"


@query(
    "f10_title_images",
    f"SELECT imgid, {SHOWN_IMAGE} AS titleimage FROM v_images i JOIN (SELECT sid, islocal FROM v_sites) s ON s.sid = i.sid",
)
def title_images(t):
    """Where a reader finds every image."""
    joined = select.of_site(t.images, t.sites, "islocal")
    shown = columns.title_image(F.col("islocal"), F.col("urlabs"), F.col("path"), F.col("filename"))
    return joined.select("imgid", shown.alias("titleimage"))


@query(
    "f11_page_arguments",
    f"SELECT cuid FROM (SELECT cuid, row_number() OVER (ORDER BY cuid DESC) AS rn FROM ({VISIBLE})) WHERE rn <= 10",
)
def page_arguments(t):
    """A page asked for with a page and a count below 1: the first ten."""
    return select.article_page(select.visible_articles(t.contenturls, t.sites).select("cuid"), 0, -1)


@query("f12_counts_caption", "SELECT o_orderkey, concat('阅读: ', o_custkey, ', 点赞: ', o_orderstatus) AS extrainfo FROM orders")
def counts_caption(t):
    """The caption of two counts."""
    caption = columns.counts_caption(F.col("o_custkey").cast("string"), F.col("o_orderstatus"))
    return t.given("orders").select("o_orderkey", caption.alias("extrainfo"))


DATES = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN '2016-5-1' WHEN 2 THEN CASE o_orderkey % 8 WHEN 2 THEN '2016-13-01' ELSE '2200-01-01' END ELSE o_orderpriority END AS postdate
  FROM orders"""


@query(
    "c1_date_to_epoch",
    f"SELECT o_orderkey, (coalesce(CAST(epoch(try_strptime(postdate, '%Y-%m-%d')) AS BIGINT), 0) + 2147483648) % 4294967296 - 2147483648 AS seconds FROM ({DATES})",
)
def date_to_epoch(t):
    """Epoch seconds of free-form dates."""
    return t.sql(DATES).select("o_orderkey", columns.to_epoch(F.col("postdate")).alias("seconds"))


@query(
    "c2_epoch_to_text",
    """SELECT attempt, strftime(make_timestamp(fetched_at::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS moment,
  strftime(make_timestamp(fetched_at::BIGINT * 1000000), '%Y%m/%d') AS folder FROM v_fetches""",
)
def epoch_to_text(t):
    """Date texts of fetch times."""
    at = F.col("fetched_at")
    return t.fetches.select(
        "attempt", columns.from_epoch(at).alias("moment"), columns.from_epoch(at, "yyyyMM/dd").alias("folder")
    )


@query("c3_md5", "SELECT doc_id, upper(md5(text)) AS digest FROM documents")
def md5(t):
    """Digest of every text."""
    return t.given("documents").select("doc_id", columns.md5_hex(F.col("text")).alias("digest"))


@query(
    "c4_json_text",
    """SELECT event_id, trim(coalesce(json_extract_string(props, '$.k'), '')) AS k, trim(coalesce(json_extract_string(props, '$.none'), '')) AS missing,
  CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '' END AS nothing FROM events""",
)
def json_text(t):
    """Members of event properties as text."""
    # A third has a null member, which is text too.
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"nothing":null,'), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    return t.given("events").select(
        "event_id", *[columns.json_text(props, key).alias(name) for key, name in (("k", "k"), ("none", "missing"), ("nothing", "nothing"))]
    )


@query(
    "c5_text_to_int",
    "SELECT o_orderkey, coalesce(try_cast(regexp_extract(v, '^[+-]?[0-9]+$') AS INT), 7) AS number FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey * 100000 AS STRING) ELSE substr(o_orderpriority, 1, o_orderkey % 3) END AS v FROM orders)",
)
def text_to_int(t):
    """Ints from text, 7 where it is none."""
    text = F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") * 100000).cast("string")).otherwise(
        F.substring("o_orderpriority", F.lit(1), (F.col("o_orderkey") % 3).cast("int"))
    )
    return t.given("orders").select("o_orderkey", columns.to_int(text, 7).alias("number"))


# ---- joins -----------------------------------------------------------------------------------------------------------

@query("j1_articles_with_site", "SELECT cuid, c.sid, sitename, islocal FROM v_contenturls c JOIN v_sites s ON s.sid = c.sid")
def articles_with_site(t):
    """Every article with its site."""
    return select.of_site(t.contenturls, t.sites, "sitename", "islocal").select("cuid", "sid", "sitename", "islocal")


@query(
    "j2_articles_with_title_image",
    f"SELECT cuid, {SHOWN_IMAGE} AS titleimage FROM (SELECT cuid, titleimageid, islocal FROM v_contenturls c JOIN v_sites s ON s.sid = c.sid) LEFT JOIN v_images i ON imgid = titleimageid".replace("SELECT cuid, CASE", "SELECT a.cuid, CASE").replace("s.sid = c.sid) LEFT", "s.sid = c.sid) a LEFT"),
)
def articles_with_title_image(t):
    """Every article with its title image, if any."""
    from gleaner.plans.queries import with_title_image

    articles = select.of_site(t.contenturls.select("cuid", "sid", "titleimageid"), t.sites, "islocal")
    return with_title_image(articles, t.images).select("cuid", "titleimage")


@query(
    "j3_optional_site",
    "SELECT sid, CAST(0 AS BIGINT) AS asked, count(*) AS n FROM v_contenturls GROUP BY sid UNION ALL SELECT sid, 1, count(*) FROM v_contenturls WHERE sid = 1 GROUP BY sid",
)
def optional_site(t):
    """Articles of all sites (0) and of site 1."""

    def counted(sid):
        rows = select.of_one_site(t.contenturls, sid)
        return rows.groupBy("sid").agg(F.count("*").alias("n")).withColumn("asked", F.lit(sid).cast("bigint"))

    return counted(0).unionByName(counted(1))


@query("j4_tags_of_articles", "SELECT cuid, t.tid, tagname FROM v_contenttags c JOIN v_articletags t ON t.tid = c.tid")
def tags_of_articles(t):
    """Tags of every article."""
    return tags.tags_of_articles(t.contenttags, t.articletags)


HOST_LINKS = """hrefs AS (SELECT page, luid, sid, page_url, regexp_extract_all(body, '<li><a href="([^"]*)"', 1) AS found FROM v_host_pages),
  links AS (SELECT page, luid, sid, page_url, unnest(range(0, len(found))) AS pos, concat('http://h.example.org', unnest(found)) AS url FROM hrefs)"""
FRESH_LINKS = f"""{HOST_LINKS}, fresh AS (SELECT url, page, pos, luid, sid FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page, pos DESC) AS rn FROM links
    WHERE url NOT IN (SELECT url FROM links WHERE page_url LIKE 'http://%')) WHERE rn = 1)"""


def _host_links(t):
    """Links of all pages, and as stored articles those of the pages read over http."""
    found = explode_links(html_links(t.host_pages), "page", "luid", "sid", "page_url").withColumnRenamed("link", "url")
    stored = found.filter(F.col("page_url").startswith("http://")).select(
        (F.col("page") * 1000 + F.col("pos")).alias("cuid"), "sid", "url"
    )
    return found.drop("page_url"), stored


@query("j5_unseen_links", f"WITH {FRESH_LINKS} SELECT url, page, pos, luid FROM fresh")
def unseen_links(t):
    """Links no article has yet, one row each."""
    found, stored = _host_links(t)
    return links.unseen_links(found, stored, ["url"]).select("url", "page", "pos", "luid")


@query(
    "j5_new_articles",
    f"WITH {FRESH_LINKS} SELECT (SELECT max(page * 1000 + pos) FROM links WHERE page_url LIKE 'http://%') + row_number() OVER (ORDER BY page, pos DESC) AS cuid, luid, sid, url, {NOW} AS dateline, 0 AS status FROM fresh",
)
def new_articles(t):
    """Article rows for links no article has yet."""
    found, stored = _host_links(t)
    return links.insert_links(found, stored, NOW).select("cuid", "luid", "sid", "url", "dateline", "status")


@query(
    "j6_new_account_articles",
    """SELECT (SELECT max(cuid) FROM v_contenturls) + row_number() OVER (ORDER BY page, pos DESC) AS cuid, sid, title, url, postdate
  FROM (SELECT *, row_number() OVER (PARTITION BY sid, title ORDER BY page, pos DESC) AS rn FROM v_items i
    WHERE NOT EXISTS (SELECT 1 FROM v_contenturls c WHERE c.sid = i.sid AND c.title = i.title)) WHERE rn = 1""",
)
def new_account_articles(t):
    """Article rows for account items whose title their site does not have."""
    added = links.insert_account_items(t.items, t.contenturls, NOW)
    return added.select("cuid", "sid", "title", "url", "postdate")


# Half of the new texts shout, in ASCII letters only; under the equality of any case they meet what is stored all the same.
SHOUTED = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _shouted(text: str, which: Column) -> Column:
    return F.when(which, F.translate(text, string.ascii_lowercase, string.ascii_uppercase)).otherwise(F.col(text))


FRESH_ANY_CASE = f"""{HOST_LINKS}, spelled AS (SELECT page, luid, sid, page_url, pos, CASE WHEN pos % 2 = 0 THEN {SHOUTED.format('url')} ELSE url END AS url, url AS stored FROM links),
  fresh AS (SELECT url, page, pos, luid, sid FROM (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY page, pos DESC) AS rn FROM spelled
    WHERE lower(url) NOT IN (SELECT lower(url) FROM links WHERE page_url LIKE 'http://%')) WHERE rn = 1)"""


def _shouted_links(t):
    """Links of all pages, every other one in upper case, and as stored articles those of the pages read over http."""
    found, stored = _host_links(t)
    return found.withColumn("url", _shouted("url", F.col("pos") % 2 == 0)), stored


@query(
    "j5_new_articles_any_case",
    f"WITH {FRESH_ANY_CASE} SELECT (SELECT max(page * 1000 + pos) FROM links WHERE page_url LIKE 'http://%') + row_number() OVER (ORDER BY page, pos DESC) AS cuid, luid, sid, url FROM fresh",
)
def new_articles_any_case(t):
    """Article rows for links that no article has in any case, spelled as found first."""
    found, stored = _shouted_links(t)
    return links.insert_links(found, stored, NOW, keys.ANY_CASE).select("cuid", "luid", "sid", "url")


@query(
    "j6_new_account_articles_any_case",
    f"""WITH spelled AS (SELECT page, pos, sid, url, postdate, CASE WHEN page % 2 = 0 THEN lower(title) ELSE title END AS title FROM v_items)
  SELECT (SELECT max(cuid) FROM v_contenturls) + row_number() OVER (ORDER BY page, pos DESC) AS cuid, sid, title, url, postdate
  FROM (SELECT *, row_number() OVER (PARTITION BY sid, lower(title) ORDER BY page, pos DESC) AS rn FROM spelled i
    WHERE NOT EXISTS (SELECT 1 FROM v_contenturls c WHERE c.sid = i.sid AND lower(c.title) = lower(i.title))) WHERE rn = 1""",
)
def new_account_articles_any_case(t):
    """Article rows for account items whose title their site does not have in any case."""
    title = F.when(F.col("page") % 2 == 0, F.lower("title")).otherwise(F.col("title"))
    added = links.insert_account_items(t.items.withColumn("title", title), t.contenturls, NOW, keys.ANY_CASE)
    return added.select("cuid", "sid", "title", "url", "postdate")


@query(
    "j7_reconciled_listurls",
    f"""WITH {GENERATED.replace('__WHICH__', 'isweixin = 0 AND listcreated = 0')},
  base AS (SELECT luid, sid, listurl, isenable, isfirst FROM v_listurls), {RECONCILED}""",
)
def reconciled_listurls(t):
    """List pages after bringing in the generated ones."""
    after = audit.reconcile_listurls(t.sites, t.state("listurls"), NOW)
    return after.select("luid", "sid", "listurl", "isenable", "isfirst")


# ---- aggregates ------------------------------------------------------------------------------------------------------

@query("a1_row_total", f"SELECT count(*) AS rscount FROM ({VISIBLE})")
def row_total(t):
    """How many articles a reader may see."""
    return rollup.row_total(select.visible_articles(t.contenturls, t.sites))


@query(
    "a2_images_complete",
    """SELECT cuid, CASE WHEN cuid IN (SELECT cuid FROM v_images GROUP BY cuid HAVING count(*) FILTER (status = 0) = 0 AND count(*) FILTER (status IN (2, 3)) > 0)
    THEN 1 ELSE imagefinish END AS imagefinish FROM v_contenturls""",
)
def images_complete(t):
    """Articles with the mark that all images are there."""
    images = t.images.select("imgid", "cuid", "status")
    complete = rollup.images_complete(images, images.filter(F.col("status").isin(2, 3)))
    return rollup.mark_complete(t.contenturls.select("cuid", "imagefinish"), complete)


@query(
    "a3_without_body_images",
    """SELECT c.cuid, CAST(i.cuid IS NULL AS INT) AS imagefinish FROM v_contenturls c
  LEFT JOIN (SELECT DISTINCT cuid FROM v_images WHERE imgid % 2 = 0) i ON i.cuid = c.cuid""",
)
def without_body_images(t):
    """Articles complete at once, for want of images in the body."""
    return rollup.without_body_images(t.contenturls, t.images.filter(F.col("urlsrc") != "/title"))


@query(
    "a4_tag_strings",
    "SELECT cuid, string_agg(tagname, ',' ORDER BY t.tid) AS tags FROM v_contenttags c JOIN v_articletags t ON t.tid = c.tid GROUP BY cuid",
)
def tag_strings(t):
    """Tags of every article as one text."""
    return tags.tag_strings(t.contenttags, t.articletags)


@query(
    "a4_tag_lists",
    "SELECT cuid, concat('[', string_agg(concat('{\"tagid\":', t.tid, ',\"tagname\":\"', tagname, '\"}'), ',' ORDER BY t.tid), ']') AS tags FROM v_contenttags c JOIN v_articletags t ON t.tid = c.tid GROUP BY cuid",
)
def tag_lists(t):
    """Tags of every article as a list."""
    return tags.tag_lists(t.contenttags, t.articletags).withColumn("tags", F.to_json("tags"))


@query(
    "a5_latest_fetch",
    """SELECT s.sid, greatest(lastfetch, coalesce(latest, 0)) AS lastfetch FROM v_sites s LEFT JOIN
  (SELECT sid, max(fetched_at) AS latest FROM (SELECT sid, fetched_at FROM v_fetches UNION ALL SELECT sid, fetched_at FROM v_list_pages) GROUP BY sid) f ON f.sid = s.sid""",
)
def latest_fetch(t):
    """Site clocks after two kinds of results."""
    return rollup.move_clocks(t.sites, rollup.latest_fetch(t.fetches, t.list_pages)).select("sid", "lastfetch")


@query(
    "a6_attempt_counters",
    """SELECT l.luid, connectcount + coalesce(n, 0) AS connectcount, parsecount + coalesce(n, 0) AS parsecount
  FROM v_listurls l LEFT JOIN (SELECT luid, count(*) AS n FROM v_fetches GROUP BY luid) f ON f.luid = l.luid""",
)
def attempt_counters(t):
    """List page counters after their attempts."""
    counted = rollup.add_attempts(t.listurls, rollup.attempts(t.fetches, "luid"))
    return counted.select("luid", "connectcount", "parsecount")


# ---- rankings, sorts, limits -----------------------------------------------------------------------------------------

@query("t1_next_list_page", f"SELECT sid, max(luid) AS luid FROM ({DUE_LISTS}) GROUP BY sid")
def next_list_page(t):
    """The list page each site reads next."""
    return select.next_list_page(t.listurls, t.sites, CLOCK)


@query("t2_next_article", f"SELECT sid, min(cuid) AS cuid FROM ({_due_articles(0)}) GROUP BY sid")
def next_article(t):
    """The article each plain site reads next."""
    return select.next_article(t.contenturls, t.sites, CLOCK, 0)


@query("t3_next_image", "SELECT sid, min(imgid) AS imgid FROM v_images WHERE status IN (0, 3) GROUP BY sid")
def next_image(t):
    """The image each site loads next."""
    return select.next_image(t.images)


@query("t4_cyclic_order", "SELECT sid, row_number() OVER (ORDER BY sid <= 7, sid) AS turn FROM v_sites WHERE isenable = 1")
def cyclic_order(t):
    """Sites in the order of their turns after site 7."""
    return select.cyclic_order(t.sites, 7)


@query("t4_next_site", "SELECT coalesce(min(CASE WHEN sid > 7 THEN sid END), min(sid)) AS sid FROM v_sites WHERE isenable = 1 AND isweixin = 1")
def next_site(t):
    """The account site whose turn it is after site 7."""
    return select.next_site(t.sites, 7, 1)


@query("t5_article_page", f"SELECT cuid, title FROM ({VISIBLE}) ORDER BY cuid DESC LIMIT 20 OFFSET 40")
def article_page(t):
    """The third page of twenty articles."""
    return select.article_page(select.visible_articles(t.contenturls, t.sites).select("cuid", "title"), 3, 20)


@query("t6_index_batch", "SELECT cuid, url FROM v_contenturls WHERE status = 2 AND indexfinish = 0 ORDER BY cuid LIMIT 50")
def index_batch(t):
    """The oldest fifty articles that wait for the index."""
    return select.index_batch(t.contenturls, 50).select("cuid", "url")


# ---- set operations, keys, tags --------------------------------------------------------------------------------------

@query(
    "d1_multiset_difference",
    "SELECT ps AS size, bd AS brand FROM (SELECT p_size % 20 AS ps, p_brand AS bd FROM part EXCEPT ALL SELECT CAST(c_nationkey AS INT) % 20, concat('Brand#', CAST(c_custkey % 9 + 1 AS STRING)) FROM customer)",
)
def multiset_difference(t):
    """Sizes and brands of parts, each less the times a customer takes it away."""
    new = t.given("part").select((F.col("p_size") % 20).alias("size"), F.col("p_brand").alias("brand"))
    old = t.given("customer").select(
        (F.col("c_nationkey") % 20).alias("size"), F.concat(F.lit("Brand#"), F.col("c_custkey") % 9 + 1).alias("brand")
    )
    return keys.multiset_difference(new, old)


@query(
    "d2_split_by_presence",
    f"""WITH {GENERATED.replace('__WHICH__', 'true')} SELECT luid, l.sid, l.listurl, CAST(w.listurl IS NOT NULL AS INT) AS kept
  FROM v_listurls l LEFT JOIN (SELECT DISTINCT sid, listurl FROM wanted) w ON w.sid = l.sid AND w.listurl = l.listurl""",
)
def split_by_presence(t):
    """Stored list pages, those still generated marked."""
    split = keys.split_by_presence(
        t.listurls.select("luid", "sid", "listurl"), audit.site_list_urls(t.sites, NOW), ["sid", "listurl"]
    )
    return split.withColumn("kept", F.col("kept").cast("int"))


@query(
    "k1_new_ids",
    "SELECT l_orderkey, l_linenumber, n, (SELECT max(luid) FROM v_listurls) + row_number() OVER (ORDER BY l_orderkey, l_linenumber DESC) AS luid FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)",
)
def new_ids(t):
    """Ids for order lines above those of the list pages."""
    rows = t.given("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return keys.new_ids(rows, t.listurls, "luid", [F.col("l_orderkey"), F.desc("l_linenumber")])


# Tag texts of all articles as new.
TAG_TEXTS = "SELECT cuid, concat(string_agg(tagname, ',' ORDER BY t.tid), ',x', cuid % 40, ',,') AS tag FROM v_contenttags c JOIN v_articletags t ON t.tid = c.tid GROUP BY cuid"
TAG_NAMES = f"""texts AS ({TAG_TEXTS}), parts AS (SELECT cuid, string_split(regexp_replace(tag, ',+$', ''), ',') AS names FROM texts),
  named AS (SELECT cuid, unnest(range(0, len(names))) AS pos, unnest(names) AS tagname FROM parts),
  known AS (SELECT * FROM v_known_tags),
  seen AS (SELECT tagname, min(cuid) AS cuid, arg_min(pos, cuid) AS pos FROM named WHERE tagname NOT IN (SELECT tagname FROM known) GROUP BY tagname),
  alltags AS (SELECT tid, tagname FROM known UNION ALL SELECT (SELECT max(tid) FROM known) + row_number() OVER (ORDER BY cuid, pos), tagname FROM seen)"""


def _tagged(t):
    texts = tags.tag_strings(t.contenttags, t.articletags)
    return texts.select(
        "cuid", F.concat(F.col("tags"), F.lit(",x"), (F.col("cuid") % 40).cast("string"), F.lit(",,")).alias("tag")
    )


@query("g1_tag_upsert", f"WITH {TAG_NAMES} SELECT tid, tagname FROM alltags")
def tag_upsert(t):
    """The tag table with the names it lacked."""
    return tags.upsert_tags(_tagged(t), t.known_tags)


@query(
    "g2_bridge_upsert",
    f"""WITH {TAG_NAMES}, old AS (SELECT * FROM v_known_bridge),
  pairs AS (SELECT cuid, tid, min(pos) AS pos FROM named n JOIN alltags a ON a.tagname = n.tagname GROUP BY cuid, tid)
  SELECT ctid, tid, cuid FROM old UNION ALL SELECT (SELECT max(ctid) FROM old) + row_number() OVER (ORDER BY cuid, pos), tid, cuid
  FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.cuid = p.cuid AND o.tid = p.tid)""",
)
def bridge_upsert(t):
    """The article-tag bridge with the pairs it lacked."""
    # In a collection the articles are a stored table, read for the names and again for the pairs.
    tagged = stored(_tagged(t))
    names = tags.upsert_tags(tagged, t.known_tags)
    return tags.upsert_bridge(tagged, names, t.known_bridge)


# The same tags, each article's names twice: in lower case before as they are, for two articles in three.
LOUD_TEXTS = f"SELECT cuid, CASE WHEN cuid % 3 > 0 THEN concat(lower(tag), tag) ELSE tag END AS tag FROM ({TAG_TEXTS})"
TAGS_ANY_CASE = f"""texts AS ({LOUD_TEXTS}), parts AS (SELECT cuid, string_split(regexp_replace(tag, ',+$', ''), ',') AS names FROM texts),
  listed AS (SELECT cuid, unnest(range(0, len(names))) AS place, unnest(names) AS tagname FROM parts),
  named AS (SELECT cuid, tagname, row_number() OVER (PARTITION BY cuid ORDER BY min(place)) - 1 AS pos FROM listed GROUP BY cuid, tagname),
  known AS (SELECT * FROM v_known_tags),
  seen AS (SELECT tagname, cuid, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(tagname) ORDER BY cuid, pos) AS rn FROM named
    WHERE lower(tagname) NOT IN (SELECT lower(tagname) FROM known)) WHERE rn = 1),
  alltags AS (SELECT tid, tagname FROM known UNION ALL SELECT (SELECT max(tid) FROM known) + row_number() OVER (ORDER BY cuid, pos), tagname FROM seen)"""


def _loud(t):
    tag = F.when(F.col("cuid") % 3 > 0, F.concat(F.lower("tag"), F.col("tag"))).otherwise(F.col("tag"))
    return _tagged(t).withColumn("tag", tag)


@query("g1_tag_upsert_any_case", f"WITH {TAGS_ANY_CASE} SELECT tid, tagname FROM alltags")
def tag_upsert_any_case(t):
    """The tag table with the names it lacked in any case, spelled as they appear first."""
    return tags.upsert_tags(_loud(t), t.known_tags, keys.ANY_CASE)


@query(
    "g2_bridge_upsert_any_case",
    f"""WITH {TAGS_ANY_CASE}, old AS (SELECT * FROM v_known_bridge),
  pairs AS (SELECT cuid, min(tid) AS tid, min(pos) AS pos FROM named n JOIN alltags a ON lower(a.tagname) = lower(n.tagname) GROUP BY cuid, lower(n.tagname))
  SELECT ctid, tid, cuid FROM old UNION ALL SELECT (SELECT max(ctid) FROM old) + row_number() OVER (ORDER BY cuid, pos), tid, cuid
  FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.cuid = p.cuid AND o.tid = p.tid)""",
)
def bridge_upsert_any_case(t):
    """The article-tag bridge with the pairs it lacked, names compared in any case."""
    loud = stored(_loud(t))
    names = tags.upsert_tags(loud, t.known_tags, keys.ANY_CASE)
    return tags.upsert_bridge(loud, names, t.known_bridge, keys.ANY_CASE)
