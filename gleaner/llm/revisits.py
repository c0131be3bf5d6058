"""Archive records: not-modified revisits resolved against the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE = 4096  # units of time that one task takes of a URL's records
# Headers of a not-modified answer that do not replace those of the stored response: they concern
# the connection, or the body that the answer does not have.
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a closing slash do not matter; the host's case neither."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    # Tracking parameters go with the sign after them, then a sign that ends the rest.
    clean = F.regexp_replace(F.regexp_replace(rest, "([?&])(?:(?:utm_[a-z]+|ref)=[^&]*(?:&|$))+", "$1"), "[?&/]+$", "")
    return F.concat(host, clean)


def resolved(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id``, ``url_key``, ``ts``, ``state``, ``refers_to``, ``headers``, ``body_digest``, ``body_length``.

    ``records``: ``record_id``, ``url``, ``ts``, ``revisit`` (whether the record is a not-modified answer
    without body), ``headers`` (names in lower case), ``body_digest``, ``body_length``. A revisit refers to the full
    response of the same canonical URL with the largest earlier ``ts`` (of equal ones the largest
    id). ``state`` is ``no response`` if there is none; else validators decide: entity
    tags, without the weak sign, if both have one, else the dates of last change if both have one,
    else ``unverified``; they agree (``resolved``) or not (``mismatch``). Only a resolved revisit
    gets the response's body and merged headers: the stored ones, replaced by the revisit's
    where ``NOT_MERGED`` permits.

    The join is a running last response over a URL's records in order of time. A URL's
    records are dealt by slices of time, and the last response before each slice comes from one row per
    slice, so a hot URL is many tasks. Bodies do not travel; ``refers_to`` finds them. A null URL or time
    never finds a response (``no response``); a null ``revisit`` is a full response; null headers
    are none. Repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
    """
    found = F.struct("ts", "record_id", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "body_digest", "body_length")
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.coalesce("revisit", F.lit(False)).alias("revisit"), "headers", "body_digest", "body_length")
    rows = rows.withColumn("slice", F.floor(F.col("ts") / SLICE))
    known = rows.where("url_key IS NOT NULL AND ts IS NOT NULL")
    responses = F.when(~F.col("revisit"), found)
    # At one time revisits come first, so a response counts only if it is earlier.
    order = Window.partitionBy("url_key", "slice").orderBy("ts", F.col("revisit").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last(responses, ignorenulls=True).over(order)).where("revisit")
    ends = known.groupBy("url_key", "slice").agg(F.max_by(found, F.when(~F.col("revisit"), F.struct("ts", "record_id"))).alias("end"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(before)).select("url_key", "slice", "far")
    met = near.join(carried, ["url_key", "slice"]).withColumn("hit", F.coalesce("near", "far"))
    lost = rows.where("revisit AND (url_key IS NULL OR ts IS NULL)")
    met = met.select("record_id", "url_key", "ts", "headers", "hit").union(lost.select("record_id", "url_key", "ts", "headers", F.lit(None).cast(met.schema["hit"].dataType)))

    def header(column: str, name: str) -> Column:
        return F.element_at(F.col(column), F.lit(name))

    def tag(column: str) -> Column:
        return F.regexp_replace(header(column, "etag"), "^W/", "")

    agree = F.coalesce(tag("headers") == tag("hit.headers"), header("headers", "last-modified") == header("hit.headers", "last-modified"))
    state = F.when(F.col("hit").isNull(), "no response").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda name, _: ~name.isin(NOT_MERGED))
    merged = F.map_concat(F.map_filter(F.col("hit.headers"), lambda name, _: ~F.map_contains_key(fresh, name)), fresh)
    ok = F.col("state") == "resolved"
    return met.withColumn("state", state).select(
        "record_id",
        "url_key",
        "ts",
        "state",
        F.col("hit.record_id").alias("refers_to"),
        F.when(ok, merged).alias("headers"),
        F.when(ok, F.col("hit.body_digest")).alias("body_digest"),
        F.when(ok, F.col("hit.body_length")).alias("body_length"),
    )
