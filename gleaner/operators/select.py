"""What is due, what is visible, what comes next.

``now`` is always a parameter, so results repeat. Choosing one row per site is
an aggregate with partial sums on the map side, never a sort of a whole site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.columns import page_arguments
from gleaner.functions.rules import account_error
from gleaner.operators.keys import number_rows
from gleaner.schemas import DONE, FETCH_FAILED, IN_PROGRESS, WAITING

ANY_KIND = -1
_RANGE_BITS = 16  # ids of a range in which pages are counted


def enabled_sites(sites: DataFrame, kind: int = ANY_KIND) -> DataFrame:
    """Enabled sites, all or of one kind (0 plain, 1 account)."""
    chosen = sites.filter(F.col("isenable") == 1)
    return chosen if kind == ANY_KIND else chosen.filter(F.col("isweixin") == kind)


def of_site(work: DataFrame, sites: DataFrame, *columns: str) -> DataFrame:
    """Work rows with columns of their site.

    An equi join without a hint: Catalyst broadcasts the sites only while their
    size is below its threshold, else a hot site is split at run time.
    """
    return work.join(sites.select("sid", *columns), "sid")


def _waiting_long_enough(now: int) -> Column:
    return F.col("lastfetch") + F.col("interval") < now


def _revisit_due(now: int) -> Column:
    return F.col("lastfetch") + F.col("schedule") < now


def _never_read() -> Column:
    return F.col("status") == WAITING


def _first_page_read() -> Column:
    return (F.col("isfirst") == 1) & F.col("status").isin(DONE, FETCH_FAILED)


def due_list_pages(listurls: DataFrame, sites: DataFrame, now: int) -> DataFrame:
    """Enabled list pages to read now: unread ones, and first pages due for a revisit."""
    work = listurls.filter((F.col("isenable") == 1) & (_never_read() | _first_page_read()))
    joined = of_site(work, sites, "lastfetch", "interval", "schedule")
    due = (_never_read() & _waiting_long_enough(now)) | (_first_page_read() & _revisit_due(now))
    return joined.filter(due).select(*listurls.columns)


def due_articles(contenturls: DataFrame, sites: DataFrame, now: int, kind: int) -> DataFrame:
    """Articles of one kind of site that are unread or failed to load."""
    ready = sites.filter((F.col("isweixin") == kind) & _waiting_long_enough(now)).select("sid")
    return contenturls.filter(F.col("status").isin(WAITING, FETCH_FAILED)).join(ready, "sid").select(*contenturls.columns)


def due_images(images: DataFrame) -> DataFrame:
    """Images that are unread or failed to load."""
    return images.filter(F.col("status").isin(WAITING, FETCH_FAILED))


def due_account_sites(sites: DataFrame, now: int) -> DataFrame:
    """Enabled account sites with a good rule whose article list is due."""
    return enabled_sites(sites, 1).filter(
        (account_error() == "") & (F.lit(now) - F.col("schedule") > F.col("lastfetch"))
    )


def visible_articles(contenturls: DataFrame, sites: DataFrame, *site_columns: str) -> DataFrame:
    """Finished articles a reader may see: where a site shows local images, only once they are there."""
    done = contenturls.filter(F.col("status") == DONE)
    joined = of_site(done, sites, *dict.fromkeys(("islocal", *site_columns)))
    visible = (F.col("islocal") == 0) | ((F.col("islocal") == 1) & (F.col("imagefinish") == 1))
    extra = [name for name in site_columns if name not in contenturls.columns]
    return joined.filter(visible).select(*contenturls.columns, *extra)


def of_one_site(rows: DataFrame, sid: int) -> DataFrame:
    """Rows of one site, or all rows for 0."""
    return rows.filter(F.col("sid") == sid) if sid else rows


def reset_in_flight(table: DataFrame) -> DataFrame:
    """A table as after a crash: rows that were in progress wait again."""

    def reset(name: str) -> Column:
        if name not in ("status", "indexfinish"):
            return F.col(f"`{name}`")
        return F.when(F.col(name) == IN_PROGRESS, WAITING).otherwise(F.col(name)).alias(name)

    return table.select(*[reset(name) for name in table.columns])


def next_list_page(listurls: DataFrame, sites: DataFrame, now: int) -> DataFrame:
    """The list page each site reads next: the due one with the highest id.

    The highest id of both kinds of due page is found per site first; only that
    one row per site meets the site's clock.
    """
    work = listurls.filter(F.col("isenable") == 1)
    best = work.groupBy("sid").agg(
        F.max(F.when(_never_read(), F.col("luid"))).alias("_unread"),
        F.max(F.when(_first_page_read(), F.col("luid"))).alias("_first"),
    )
    joined = of_site(best, sites, "lastfetch", "interval", "schedule")
    # greatest() passes over the kind that is not due.
    luid = F.greatest(
        F.when(_waiting_long_enough(now), F.col("_unread")), F.when(_revisit_due(now), F.col("_first"))
    )
    return joined.select("sid", luid.alias("luid")).filter("luid IS NOT NULL")


def next_article(contenturls: DataFrame, sites: DataFrame, now: int, kind: int) -> DataFrame:
    """The article each site of a kind reads next; the lowest id, as the order is otherwise open."""
    ready = sites.filter((F.col("isweixin") == kind) & _waiting_long_enough(now)).select("sid")
    work = contenturls.filter(F.col("status").isin(WAITING, FETCH_FAILED))
    return work.groupBy("sid").agg(F.min("cuid").alias("cuid")).join(ready, "sid")


def next_image(images: DataFrame) -> DataFrame:
    """The image each site loads next; the lowest id, as the order is otherwise open."""
    return due_images(images).groupBy("sid").agg(F.min("imgid").alias("imgid"))


def cyclic_order(sites: DataFrame, last: int, kind: int = ANY_KIND) -> DataFrame:
    """Enabled sites in the order their turns come after site ``last``."""
    chosen = enabled_sites(sites, kind).select("sid")
    return number_rows(chosen, [F.col("sid") <= last, F.col("sid")], "turn")


def next_site(sites: DataFrame, last: int, kind: int = ANY_KIND) -> DataFrame:
    """The site whose turn it is after site ``last``: one row, 0 when none is enabled."""
    sid = F.col("sid")
    return enabled_sites(sites, kind).agg(
        F.coalesce(F.min(F.when(sid > last, sid)), F.min(sid), F.lit(0)).alias("sid")
    )


def article_page(rows: DataFrame, page: int, count: int) -> DataFrame:
    """One page of articles, newest first.

    Ids are counted in ranges first, one row each; only the ranges that the page
    touches are numbered, each apart. So a page costs the same however deep it lies.
    """
    page, count = page_arguments(page, count)
    skip = (page - 1) * count
    parts = rows.withColumn("_part", F.shiftright("cuid", _RANGE_BITS))
    newer = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
    # A page touches at most as many ranges as it has rows.
    touched = before.filter((F.col("_before") < skip + count) & (F.col("_before") + F.col("_rows") > skip))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("cuid")))
    numbered = parts.join(F.broadcast(touched), "_part").withColumn("_place", place)
    page_rows = numbered.filter((F.col("_place") > skip) & (F.col("_place") <= skip + count))
    return page_rows.orderBy(F.desc("cuid")).limit(count).select(*rows.columns)


def index_batch(contenturls: DataFrame, count: int) -> DataFrame:
    """The oldest finished articles that wait for the index."""
    waiting = contenturls.filter((F.col("status") == DONE) & (F.col("indexfinish") == 0))
    return waiting.orderBy("cuid").limit(count)
