"""A rule dry-run: what the rules of chosen sites find on stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.functions.rules import FIELDS
from gleaner.operators.audit import generated_urls
from gleaner.operators.extract import article_results, list_results
from gleaner.session import stored

# Fixed value: characters of a body that a report shows.
CONTENT_LENGTH = 100


def latest_fetches(wanted: DataFrame, raw_pages: DataFrame, at: int | None = None) -> DataFrame:
    """For each wanted address (``url``) its stored page as last fetched, at or before ``at`` if given.

    Which fetch that is, is found on addresses and times alone; bodies are then read for those fetches. Of several
    pages of one address and time one without an error is taken, and of these the least in the order of its text.
    """
    times = raw_pages if "fetched_at" in raw_pages.columns else raw_pages.withColumn("fetched_at", F.lit(0))
    times = times if at is None else times.filter(F.col("fetched_at") <= at)
    asked = wanted.select("url").distinct()
    last = times.select("url", "fetched_at").join(asked, "url", "left_semi").groupBy("url").agg(F.max("fetched_at").alias("fetched_at"))
    found = times.select("url", "fetched_at", "connecterror", "body").join(last, ["url", "fetched_at"])
    one = found.groupBy("url").agg(F.min(F.struct("connecterror", "body")).alias("page"))
    return one.select("url", "page.body", "page.connecterror")


def _with_bodies(wanted: DataFrame, raw_pages: DataFrame, at: int | None) -> DataFrame:
    """Wanted pages (``url``) with their stored body; one that is not stored counts as not fetched."""
    joined = wanted.join(latest_fetches(wanted, raw_pages, at), "url", "left")
    return joined.withColumn("connecterror", F.coalesce("connecterror", F.lit("page is not stored")))


def dry_run(sites: DataFrame, raw_pages: DataFrame, now: int, follow_pages: int = 2, follow_links: int = 5, at: int | None = None) -> DataFrame:
    """Report per site: all its list pages, all links of those it reads, and the fields of the articles it reads.

    One row per link, and one without a link for a list page that gave none or
    is not read. A run reads the first ``follow_pages`` list pages of a site
    (``pagefollowed``) and the first ``follow_links`` links of each
    (``linkfollowed``); what it lists is never cut. Pages are read as they were
    last fetched, at or before ``at`` if that is given.
    """
    pages = generated_urls(sites, now).select("sid", F.col("pos").alias("listpos"), "listurl", (F.col("pos") < follow_pages).alias("pagefollowed"))
    asked = pages.filter("pagefollowed").select("sid", "listpos", F.col("listurl").alias("url"))
    listed = list_results(_with_bodies(asked, raw_pages, at), sites)
    # The links are reported and followed, so they are worked out once.
    linked = stored(
        listed.select(
            "sid",
            "listpos",
            F.concat("joberror", "connecterror", "parseerror").alias("listerror"),
            F.posexplode_outer("links").alias("linkpos", "link"),
        )
    ).withColumn("linkfollowed", F.coalesce(F.col("linkpos") < follow_links, F.lit(False)))
    wanted = linked.filter("linkfollowed").select("sid", F.col("link").alias("url")).distinct()
    read = article_results(_with_bodies(wanted, raw_pages, at), sites).select(
        "sid",
        F.col("url").alias("link"),
        F.lit(True).alias("linkfollowed"),
        F.concat("joberror", "connecterror", "parseerror").alias("articleerror"),
        F.substring("content", 1, CONTENT_LENGTH).alias("content"),
        *[name for name in FIELDS if name != "content"],
    )
    found = linked.join(read, ["sid", "link", "linkfollowed"], "left")
    report = pages.join(found, ["sid", "listpos"], "left")
    return report.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in (("listerror", ""), ("linkfollowed", False))})
