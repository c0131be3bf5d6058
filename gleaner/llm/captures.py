"""Archive records that the given pages would leave, and the SQL that resolves their revisits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Both engines read this. Every page is fetched in full, a fourth of them again with a new body;
# revisits come with the old tag, a weak tag, a date only, no validator, too early, and under
# other spellings of the address. With every page its host's robots.txt is asked for: one hot address per host.
CAPTURES = r"""
SELECT page_id * 8 AS record_id, url, page_id * 10 AS ts, false AS revisit,
  concat('"', substr(md5(html), 1, 16), '"') AS etag, concat('day ', CAST(page_id AS STRING)) AS last_modified,
  'text/html' AS content_type, CAST(length(html) AS STRING) AS content_length, 'max-age=60' AS cache_control,
  concat('t', CAST(page_id * 10 AS STRING)) AS date, 'origin' AS server, md5(html) AS body_digest, CAST(length(html) AS BIGINT) AS body_length
FROM pages
UNION ALL
SELECT page_id * 8 + 1, url, page_id * 10 + 20000, false, concat('"', substr(md5(html), 17, 16), '"'), NULL,
  'text/html', CAST(length(html) + 1 AS STRING), 'max-age=60', concat('t', CAST(page_id * 10 + 20000 AS STRING)), 'origin',
  md5(concat(html, ' ')), CAST(length(html) + 1 AS BIGINT)
FROM pages WHERE page_id % 4 = 0
UNION ALL
SELECT page_id * 8 + 2, concat(url, '#again'), page_id * 10 + 5000, true,
  concat(CASE WHEN page_id % 3 = 0 THEN 'W/' ELSE '' END, '"', substr(md5(html), 1, 16), '"'), 'any', 'text/plain', '0',
  CASE WHEN page_id % 2 = 0 THEN 'max-age=600' END, concat('t', CAST(page_id * 10 + 5000 AS STRING)), NULL, NULL, NULL
FROM pages
UNION ALL
SELECT page_id * 8 + 3, url, page_id * 10 + 30000, true, concat('"', substr(md5(html), 1, 16), '"'), NULL, NULL, NULL, NULL,
  concat('t', CAST(page_id * 10 + 30000 AS STRING)), NULL, NULL, NULL
FROM pages WHERE page_id % 2 = 0
UNION ALL
SELECT page_id * 8 + 4, replace(url, 'http://', 'HTTPS://'), page_id * 10 + 6000, true, NULL, concat('day ', CAST(page_id - page_id % 2 AS STRING)), NULL, '0',
  'no-cache', NULL, 'edge', NULL, NULL
FROM pages WHERE page_id % 5 < 2
UNION ALL
SELECT page_id * 8 + 5, url, page_id * 10 + 7000, true, NULL, NULL, NULL, NULL, 'no-cache', NULL, NULL, NULL, NULL
FROM pages WHERE page_id % 5 = 2
UNION ALL
SELECT page_id * 8 + 6, url, page_id * 10 - 1, true, concat('"', substr(md5(html), 1, 16), '"'), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM pages WHERE page_id % 7 = 3
UNION ALL
SELECT page_id * 8 + 7, concat(regexp_extract(url, '^[a-z]+://[^/]+', 0), '/robots.txt'), page_id * 10 + 1, page_id % 8 > 0,
  concat('"r', CAST((page_id - page_id % 64) AS STRING), '"'), NULL, CASE WHEN page_id % 8 = 0 THEN 'text/plain' END,
  CASE WHEN page_id % 8 = 0 THEN '7' END, NULL, concat('t', CAST(page_id * 10 + 1 AS STRING)), NULL,
  CASE WHEN page_id % 8 = 0 THEN md5(concat('robots', CAST((page_id - page_id % 64) AS STRING))) END, CASE WHEN page_id % 8 = 0 THEN CAST(7 AS BIGINT) END
FROM pages"""

HEADERS = ["cache_control", "content_length", "content_type", "date", "etag", "last_modified", "server"]

_BARE = "regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '')"
_KEY = rf"""concat(
    regexp_replace(regexp_replace(lower(regexp_extract({_BARE}, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', ''),
    regexp_replace(regexp_replace(regexp_replace({_BARE}, '^[^/?]*', ''), '([?&])(?:(?:utm_[a-z]+|ref)=[^&]*(?:&|$))+', '\1', 'g'), '[?&/]+$', ''))"""

CHECK = rf"""
WITH c AS (SELECT *, {_KEY} AS url_key FROM ({CAPTURES})),
o AS (SELECT * FROM c WHERE NOT revisit QUALIFY row_number() OVER (PARTITION BY url_key, ts ORDER BY record_id DESC) = 1),
m AS (
  SELECT r.*, o.record_id AS o_id, o.etag AS o_etag, o.last_modified AS o_lm, o.body_digest AS o_digest, o.body_length AS o_length,
    concat_ws(chr(10), 'cache-control: ' || coalesce(r.cache_control, o.cache_control), 'content-length: ' || o.content_length,
      'content-type: ' || o.content_type, 'date: ' || coalesce(r.date, o.date), 'etag: ' || coalesce(r.etag, o.etag),
      'last-modified: ' || coalesce(r.last_modified, o.last_modified), 'server: ' || coalesce(r.server, o.server)) AS merged,
    coalesce(regexp_replace(r.etag, '^W/', '') = regexp_replace(o.etag, '^W/', ''), r.last_modified = o.last_modified) AS agree
  FROM (SELECT * FROM c WHERE revisit) r ASOF LEFT JOIN o ON r.url_key = o.url_key AND r.ts > o.ts),
s AS (
  SELECT *, CASE WHEN o_id IS NULL THEN 'no response' WHEN agree IS NULL THEN 'unverified' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS state
  FROM m)
SELECT record_id, url_key, ts, state, o_id AS refers_to, CASE WHEN state = 'resolved' THEN merged END AS headers,
  CASE WHEN state = 'resolved' THEN o_digest END AS body_digest, CASE WHEN state = 'resolved' THEN o_length END AS body_length
FROM s"""


def captures(pages: DataFrame) -> DataFrame:
    """The records, with their headers as one map."""
    pages.createOrReplaceTempView("_pages_of_captures")
    rows = pages.sparkSession.sql(CAPTURES.replace("FROM pages", "FROM _pages_of_captures"))
    entries = F.array(*[F.struct(F.lit(name.replace("_", "-")).alias("key"), F.col(name).alias("value")) for name in HEADERS])
    headers = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.select("record_id", "url", "ts", "revisit", headers.alias("headers"), "body_digest", "body_length")


def printed(headers: str):
    """Headers as sorted lines."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")
