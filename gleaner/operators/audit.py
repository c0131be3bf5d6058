"""Site audits, list URL generation and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.columns import strip
from gleaner.functions.rules import account_error, site_error, urlformat_error, urlformat_parts
from gleaner.operators.keys import new_ids
from gleaner.sources.tables import conform

# List pages are generated in blocks, so one site with very many is not one task.
BLOCK = 10000


def rule_errors(sites: DataFrame, check, column: str) -> DataFrame:
    """``sid`` and what a check says of one rule column."""
    return sites.select("sid", check(column).alias("err"))


def site_errors(sites: DataFrame) -> DataFrame:
    """``sid, err`` of plain sites, enabled or not."""
    return sites.filter(F.col("isweixin") == 0).select("sid", site_error().alias("err"))


def _set(table: DataFrame, **changes: Column) -> DataFrame:
    return table.select(
        *[(changes[name] if name in changes else F.col(f"`{name}`")).alias(name) for name in table.columns]
    )


def audit_sites(sites: DataFrame) -> DataFrame:
    """Sites after the audit of the plain ones: failures are disabled, good ones marked as listed."""
    checked = sites.withColumn("_err", F.when(F.col("isweixin") == 0, site_error()))
    plain, bad = F.col("_err").isNotNull(), F.col("_err") != ""
    return _set(
        checked,
        isenable=F.when(bad, 0).otherwise(F.col("isenable")),
        listcreated=F.when(plain, F.when(bad, 0).otherwise(1)).otherwise(F.col("listcreated")),
        parseerror=F.coalesce("_err", "parseerror"),
    ).drop("_err")


def audit_listurls(sites: DataFrame, listurls: DataFrame, now: int) -> DataFrame:
    """List pages after the audit: those of bad sites disabled, those of new good sites reconciled."""
    errors = site_errors(sites)
    stopped = errors.filter("err != ''").select("sid", F.lit(True).alias("_stop"))
    disabled = _set(
        listurls.join(stopped, "sid", "left").select(*listurls.columns, "_stop"),
        isenable=F.when(F.col("_stop"), 0).otherwise(F.col("isenable")),
    ).drop("_stop")
    good = sites.join(errors.filter("err = ''").select("sid"), "sid", "left_semi")
    return reconcile_listurls(good, disabled, now)


def audit_account_sites(sites: DataFrame) -> DataFrame:
    """Sites after the audit of the account ones."""
    checked = sites.withColumn("_err", F.when(F.col("isweixin") == 1, account_error()))
    bad = F.col("_err") != ""
    return _set(
        checked,
        isenable=F.when(bad, 0).otherwise(F.col("isenable")),
        listcreated=F.when(bad, 0).otherwise(F.col("listcreated")),
        parseerror=F.coalesce("_err", "parseerror"),
    ).drop("_err")


def _page_url(number: Column, now: int) -> Column:
    """The list page of a number, from the template in ``_url``."""
    numbered = F.replace("_url", F.lit("<num>"), number.cast("string"))
    return F.replace(numbered, F.lit("<timestamp>"), F.lit(str(now)))


def _page_ranges(sites: DataFrame) -> DataFrame:
    """Template and page numbers of the sites with a good rule."""
    good = sites.filter(urlformat_error() == "")
    read = good.withColumn("_parts", urlformat_parts())
    return read.withColumns(
        {"_url": F.col("_parts.url"), "_first": F.col("_parts.first"), "_last": F.col("_parts.last")}
    )


def _pages_of_ranges(ranges: DataFrame, now: int, *keep: str) -> DataFrame:
    """One row per number of each range, ``pos`` from 0; no row for a range that counts down."""
    start = F.col("_first") + F.col("_block") * BLOCK
    blocks = (
        ranges.filter("_first <= _last")
        .select("sid", *keep, "_url", "_first", "_last", F.floor((F.col("_last") - F.col("_first")) / BLOCK).alias("_blocks"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), "_blocks")))
        .repartition("sid", "_block")
    )
    numbers = blocks.withColumn("_num", F.explode(F.sequence(start, F.least(F.col("_last"), start + BLOCK - 1))))
    return numbers.select(
        "sid", *keep, (F.col("_num") - F.col("_first")).alias("pos"), _page_url(F.col("_num"), now).alias("listurl")
    )


def generated_urls(sites: DataFrame, now: int) -> DataFrame:
    """``sid, pos, listurl`` of every list page a good rule describes; none when it counts down."""
    return _pages_of_ranges(_page_ranges(sites), now)


def _with_entries(sites: DataFrame, now: int) -> DataFrame:
    """Page ranges with whether there is an entry page, and the site's first page (NULL without any)."""
    entered = strip(F.col("entryurl")) != ""
    return _page_ranges(sites).withColumns(
        {
            "_entry": entered.cast("bigint"),
            "_head": F.when(entered, F.col("entryurl")).when(
                F.col("_first") <= F.col("_last"), _page_url(F.col("_first"), now)
            ),
        }
    )


def _list_pages(entered: DataFrame, now: int, *keep: str) -> DataFrame:
    generated = _pages_of_ranges(entered, now, "_entry", *keep).withColumn("pos", F.col("pos") + F.col("_entry"))
    entries = entered.filter("_entry = 1").select(
        "sid", *keep, F.lit(0).cast("bigint").alias("pos"), F.col("entryurl").alias("listurl")
    )
    return generated.drop("_entry").unionByName(entries)


def site_list_urls(sites: DataFrame, now: int) -> DataFrame:
    """All list pages of sites with a good rule: the entry page, if any, before the generated ones.

    The row at ``pos`` 0 is the site's first page.
    """
    return _list_pages(_with_entries(sites, now), now)


def reconcile_listurls(sites: DataFrame, listurls: DataFrame, now: int) -> DataFrame:
    """List pages after bringing in the generated ones of plain sites not listed yet.

    Missing ones are added (enabled as their site), stored ones no longer
    generated are disabled, the first page is marked. A page in both is left as
    it is. A site whose rule gives no page at all stays untouched.
    """
    open_sites = sites.filter((F.col("isweixin") == 0) & (F.col("listcreated") == 0))
    entered = _with_entries(open_sites, now)
    wanted = _list_pages(entered, now, "isenable", "_head")
    # A URL repeats at most once in a site (entry page and a generated page), so this window is narrow.
    copy = F.row_number().over(Window.partitionBy("sid", "listurl").orderBy("pos"))
    stored = listurls.groupBy("sid", "listurl").agg(F.count("*").alias("_stored"))
    missing = (
        wanted.withColumn("_copy", copy)
        .join(stored, ["sid", "listurl"], "left")
        .filter(F.col("_copy") > F.coalesce("_stored", F.lit(0)))
        .select("sid", "pos", "listurl", "isenable", (F.col("listurl") == F.col("_head")).cast("int").alias("isfirst"))
    )
    numbered = new_ids(missing, listurls, "luid", [F.col("sid"), F.col("pos")])
    added = numbered.withColumn("dateline", F.lit(now))
    heads = entered.filter("_head IS NOT NULL").select("sid", "_head")
    marks = wanted.select("sid", "listurl").distinct().withColumn("_wanted", F.lit(True))
    kept = listurls.join(heads, "sid", "left").join(marks, ["sid", "listurl"], "left")
    listed, head = F.col("_head").isNotNull(), F.col("listurl") == F.col("_head")
    kept = _set(
        kept.select(*listurls.columns, "_head", "_wanted"),
        isenable=F.when(listed & F.col("_wanted").isNull(), 0).otherwise(F.col("isenable")),
        isfirst=F.when(listed, head.cast("int")).otherwise(F.col("isfirst")),
    ).drop("_head", "_wanted")
    return conform(kept, "listurls").unionByName(conform(added, "listurls"))
