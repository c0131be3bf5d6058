"""The queries readers and the index ask: site list, article list, one article, index feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.columns import excerpt, title_image
from gleaner.operators.bodies import reader_body
from gleaner.operators.rollup import row_total
from gleaner.operators.select import article_page, enabled_sites, index_batch, of_one_site, visible_articles
from gleaner.operators.tags import tag_lists, tag_strings
from gleaner.session import stored

ROW_COLUMNS = "cuid sid sitename title url author postdate content lastupdate titleimage".split()
DETAIL_COLUMNS = "luid sid sitename title url author postdate content lastupdate titleimage extrainfo tags".split()


def site_list(sites: DataFrame) -> DataFrame:
    """Enabled sites a reader can choose from."""
    return enabled_sites(sites).select("sid", "sitename", "siteurl")


def with_title_image(articles: DataFrame, images: DataFrame) -> DataFrame:
    """Articles with ``titleimage``; empty for those that have none.

    Id 0 stands for none and would be one huge key; such articles are spread
    by their own number, turned negative, which no image has.
    """
    found = images.select(F.col("imgid").alias("_image"), "urlabs", "path", "filename")
    shown = title_image(F.col("islocal"), F.col("urlabs"), F.col("path"), F.col("filename"))
    key = F.when(F.col("titleimageid") == 0, -F.col("cuid")).otherwise(F.col("titleimageid"))
    return (
        articles.withColumn("_image", key)
        .join(found, "_image", "left")
        .withColumn("titleimage", shown)
        .drop("_image", "urlabs", "path", "filename")
    )


def of_keys(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of a table for the keys of a page (one stored column): a semi join.

    The least and the greatest key become a filter of the scan, so row groups
    outside are never read.
    """
    wanted = keys.toDF(key)
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    return table.filter(F.col(key).between(low, high)).join(wanted, key, "left_semi")


def listed_articles(contenturls: DataFrame, sites: DataFrame, sid: int = 0) -> DataFrame:
    """The visible articles of one site or all, before paging."""
    return visible_articles(of_one_site(contenturls, sid), sites, "islocal", "sitename")


def content_list(
    contenturls: DataFrame, sites: DataFrame, images: DataFrame, sid: int = 0, page: int = 1, count: int = 10
) -> DataFrame:
    """One page of visible articles, newest first.

    The page is cut on narrow columns; texts and images are then read for its
    rows only.
    """
    keys = stored(article_page(listed_articles(contenturls, sites, sid).select("cuid", "titleimageid"), page, count))
    rows = listed_articles(of_keys(contenturls, "cuid", keys.select("cuid")), sites)
    shown = with_title_image(rows, of_keys(images, "imgid", keys.select("titleimageid")))
    return shown.withColumn("content", excerpt(F.col("contenttext"))).select(*ROW_COLUMNS)


def content_count(contenturls: DataFrame, sites: DataFrame, sid: int = 0) -> DataFrame:
    """How many articles all pages hold together."""
    return row_total(listed_articles(contenturls, sites, sid))


def content_details(
    contenturls: DataFrame,
    sites: DataFrame,
    images: DataFrame,
    contenttags: DataFrame,
    articletags: DataFrame,
    cuid: int | None = None,
) -> DataFrame:
    """Visible articles in full, one or all: reader's body, title image, tags."""
    wanted = contenturls if cuid is None else contenturls.filter(F.col("cuid") == cuid)
    bridge = contenttags if cuid is None else contenttags.filter(F.col("cuid") == cuid)
    return _details(wanted, wanted, sites, images, bridge, articletags)


def _details(
    chosen: DataFrame, contenturls: DataFrame, sites: DataFrame, images: DataFrame, bridge: DataFrame, articletags: DataFrame
) -> DataFrame:
    """The chosen articles in full. Sites, images and tags meet on keys and flags; texts and bodies join once, last."""
    narrow = chosen.select("cuid", "sid", "status", "imagefinish", "titleimageid")
    no_tags = F.array().cast("array<struct<tagid:bigint,tagname:string>>")
    shown = (
        with_title_image(visible_articles(narrow, sites, "islocal", "sitename"), images)
        .join(tag_lists(bridge, articletags), "cuid", "left")
        .select("cuid", "sitename", "islocal", "titleimage", F.coalesce("tags", no_tags).alias("tags"))
    )
    body = F.when(F.col("islocal") == 0, F.col("contentabsurl")).otherwise(F.col("contentlocalurl"))
    rows = contenturls.join(shown, "cuid").withColumn("content", reader_body(body))
    return rows.select("cuid", *DETAIL_COLUMNS)


def index_feed(contenturls: DataFrame, contenttags: DataFrame, articletags: DataFrame, count: int) -> DataFrame:
    """The next articles for the index with their tags as one text.

    The batch is cut on narrow columns; texts and tags are then read for its
    rows only.
    """
    keys = stored(index_batch(contenturls.select("cuid", "status", "indexfinish"), count).select("cuid"))
    batch = of_keys(contenturls, "cuid", keys).select("cuid", "url", "title", "contenttext", "lastupdate")
    tags = tag_strings(of_keys(contenttags, "cuid", keys), articletags)
    return batch.join(tags, "cuid", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def site_list_json(sites: DataFrame) -> DataFrame:
    """The site list as JSON, one object per row: a list of all sites has no size bound."""
    return site_list(sites).select("sid", F.to_json(F.struct("sid", "sitename", "siteurl")).alias("json"))


def content_list_json(
    contenturls: DataFrame, sites: DataFrame, images: DataFrame, sid: int = 0, page: int = 1, count: int = 10
) -> DataFrame:
    """One page of articles as one JSON answer with the total count."""
    rows = content_list(contenturls, sites, images, sid, page, count)
    order = F.struct((-F.col("cuid")).alias("_order"), F.struct(*ROW_COLUMNS).alias("row"))
    listed = rows.agg(F.transform(F.sort_array(F.collect_list(order)), lambda item: item["row"]).alias("contentlists"))
    total = content_count(contenturls, sites, sid).scalar()
    answer = F.struct(F.lit("").alias("errmsg"), "contentlists", total.alias("rscount"))
    return listed.select(F.to_json(answer).alias("json"))


def _detail_answer(found: Column) -> Column:
    return F.to_json(
        F.struct(
            F.when(found, F.lit("")).otherwise(F.lit("content not found")).alias("errmsg"),
            F.when(found, F.struct(*DETAIL_COLUMNS)).alias("content"),
        ),
        {"ignoreNullFields": "false"},
    )


def content_json(
    contenturls: DataFrame,
    sites: DataFrame,
    images: DataFrame,
    contenttags: DataFrame,
    articletags: DataFrame,
    cuids: DataFrame,
) -> DataFrame:
    """A JSON answer for each asked ``cuid``; an article that is not visible is not found."""
    asked = cuids.select("cuid").distinct()
    keys = contenturls.select("cuid", "sid", "status", "imagefinish", "titleimageid").join(asked, "cuid", "left_semi")
    details = _details(keys, contenturls, sites, images, contenttags.join(asked, "cuid", "left_semi"), articletags)
    found = details.select("cuid", _detail_answer(F.lit(True)).alias("json"))
    # Only the asked ids that no visible article has are left to answer.
    missing = asked.join(details.select("cuid"), "cuid", "left_anti")
    nothing = F.struct(*[F.lit(None).cast(details.schema[name].dataType).alias(name) for name in DETAIL_COLUMNS])
    empty = missing.select("cuid", nothing.alias("_row")).select("cuid", "_row.*")
    return found.union(empty.select("cuid", _detail_answer(F.lit(False)).alias("json")))
