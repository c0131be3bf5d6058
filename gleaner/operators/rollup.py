"""Counts and completeness per article, list page and site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.schemas import WAITING


def row_total(rows: DataFrame) -> DataFrame:
    """How many rows there are behind a page."""
    return rows.agg(F.count("*").alias("rscount"))


def images_complete(images: DataFrame, touched: DataFrame) -> DataFrame:
    """Articles of ``touched`` (an image of theirs has a result) with no image left waiting."""
    pending = images.filter(F.col("status") == WAITING).select("cuid").distinct()
    return touched.select("cuid").distinct().join(pending, "cuid", "left_anti")


def complete_by(images: DataFrame, touched: Column) -> DataFrame:
    """Articles with an image that is ``touched`` and none left waiting, in one pass over the images."""
    counts = images.groupBy("cuid").agg(F.count_if(F.col("status") == WAITING).alias("_waiting"), F.count_if(touched).alias("_touched"))
    return counts.filter("_waiting = 0 AND _touched > 0").select("cuid")


def mark_complete(contenturls: DataFrame, complete: DataFrame) -> DataFrame:
    """Articles with ``imagefinish`` set for those that are complete."""
    marks = complete.select("cuid", F.lit(1).alias("_complete"))
    finished = F.coalesce(F.col("_complete"), F.col("imagefinish")).alias("imagefinish")
    return contenturls.join(marks, "cuid", "left").select(
        *[finished if name == "imagefinish" else F.col(name) for name in contenturls.columns]
    )


def without_body_images(articles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Articles with ``imagefinish`` 1 when their body holds no image, whatever their title image does."""
    counts = manifest.groupBy("cuid").agg(F.count("*").alias("_images"))
    none = F.coalesce(F.col("_images"), F.lit(0)) == 0
    return articles.join(counts, "cuid", "left").select("cuid", none.cast("int").alias("imagefinish"))


def latest_fetch(*results: DataFrame) -> DataFrame:
    """Last fetch per site over all kinds of results (``sid, fetched_at``); they share one clock."""
    together = results[0].select("sid", "fetched_at")
    for more in results[1:]:
        together = together.unionByName(more.select("sid", "fetched_at"))
    return together.groupBy("sid").agg(F.max("fetched_at").alias("lastfetch"))


def move_clocks(sites: DataFrame, latest: DataFrame) -> DataFrame:
    """Sites with ``lastfetch`` moved forward to their latest fetch."""
    moved = latest.select("sid", F.col("lastfetch").alias("_latest"))
    clock = F.greatest("lastfetch", "_latest").alias("lastfetch")
    return sites.join(moved, "sid", "left").select(
        *[clock if name == "lastfetch" else F.col(f"`{name}`") for name in sites.columns]
    )


def attempts(results: DataFrame, key: str) -> DataFrame:
    """Attempts per key, and the last of them."""
    return results.groupBy(key).agg(F.count("*").alias("tries"), F.max("attempt").alias("attempt"))


def add_attempts(listurls: DataFrame, tried: DataFrame) -> DataFrame:
    """List pages with both counters raised by their attempts, failed ones too."""
    added = tried.select("luid", F.col("tries").cast("int").alias("_tries"))
    more = F.coalesce(F.col("_tries"), F.lit(0))
    return listurls.join(added, "luid", "left").select(
        *[
            (F.col(name) + more).alias(name) if name in ("connectcount", "parsecount") else F.col(name)
            for name in listurls.columns
        ]
    )
