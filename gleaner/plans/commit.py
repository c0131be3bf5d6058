"""Commit jobs: results of a batch of fetches into the next snapshot of the state tables.

Results come as a stored table with a unique ``attempt`` number; the jobs read
it several times. Every job returns the new tables by name, lazily.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.columns import counts_caption, result_status, strip, upload_path
from gleaner.functions.rules import wxconfig_contenttype
from gleaner.operators.accounts import account_articles, account_items, explode_items
from gleaner.operators.bodies import filename_column, manifest_rows, normal_body
from gleaner.operators.extract import explode_links
from gleaner.operators.keys import EXACT, new_ids
from gleaner.operators.links import insert_account_items, insert_links
from gleaner.operators.rollup import (
    add_attempts,
    attempts,
    complete_by,
    latest_fetch,
    mark_complete,
    move_clocks,
)
from gleaner.operators.select import due_account_sites
from gleaner.operators.tags import upsert_bridge, upsert_tags
from gleaner.schemas import DONE
from gleaner.session import BODY_FILES, stored
from gleaner.sources.tables import conform


def last_attempts(results: DataFrame, key: str) -> DataFrame:
    """The last result per key.

    Found on the two narrow columns; the wide rows are then joined by key and
    attempt together, which is unique, so a key tried very often stays spread.
    """
    last = attempts(results.select(key, "attempt"), key).select(key, "attempt")
    return results.join(last, [key, "attempt"])


def update(table: DataFrame, changes: DataFrame, key: str, *keep: Column) -> DataFrame:
    """A table with the columns of ``changes`` put in place, by key; ``keep`` may use ``_hit``, set where a row changed."""
    names = [name for name in changes.columns if name != key]
    staged = changes.select(key, F.lit(True).alias("_hit"), *[F.col(name).alias(f"_{name}") for name in names])
    joined = table.join(staged, key, "left")
    return joined.select(
        *[
            (F.when(F.col("_hit"), F.col(f"_{name}")).otherwise(F.col(name)) if name in names else F.col(f"`{name}`")).alias(name)
            for name in table.columns
        ],
        *keep,
    )


SENT_KEYS = 1 << 22  # keys of changed rows that are sent to all tasks at most, some 200 MB


def update_bodies(table: DataFrame, changes: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``update`` for changes that bring bodies; ``keys`` are theirs, on their own.

    Rows that stay and rows that change are taken apart, so stored bodies meet no change: which stay is told by keys alone, before
    the table's own joins where it has some, and of rows that change only the columns that are kept are read. The keys (stored ones) are
    sent to all tasks up to ``SENT_KEYS``: Spark, left to itself, moves all stored bodies to a few million keys.
    """
    changed = keys.select(key)
    changed = F.broadcast(changed) if changed.count() <= SENT_KEYS else changed
    stay = table.join(changed, key, "left_anti")
    held = table.select(key, *[name for name in table.columns if name not in changes.columns]).join(changed, key, "left_semi")
    return stay.unionByName(held.join(changes, key).select(*table.columns))


def status_of_result() -> Column:
    """Status by the three errors of a result."""
    return result_status(F.col("joberror"), F.col("connecterror"), F.col("parseerror"))


def commit_list_pages(results: DataFrame, listurls: DataFrame) -> DataFrame:
    """List pages with source, status, errors and counters of their results."""
    changes = last_attempts(results, "luid").select(
        "luid",
        "source",
        status_of_result().alias("status"),
        F.col("fetched_at").alias("lastupdate"),
        "duration",
        "connecterror",
        "parseerror",
    )
    counted = add_attempts(listurls, attempts(results.select("luid", "attempt"), "luid"))
    return update(counted, changes, "luid")


def commit_links(results: DataFrame, contenturls: DataFrame, now: int, equality: str = EXACT) -> DataFrame:
    """Articles with the new ones of the links found."""
    links = explode_links(results, "attempt", "luid", "sid").select(
        F.col("attempt").alias("page"), "pos", "luid", "sid", F.col("link").alias("url")
    )
    return contenturls.unionByName(insert_links(links, contenturls, now, equality))


def commit_clocks(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites with their clocks moved to the last of the results."""
    return move_clocks(sites, latest_fetch(results))


def commit_lists(
    results: DataFrame, sites: DataFrame, listurls: DataFrame, contenturls: DataFrame, now: int, equality: str = EXACT
) -> dict[str, DataFrame]:
    """List page results: status and errors, counters, site clocks, new articles.

    ``results``: attempt, luid, sid, source, links, duration, joberror,
    connecterror, parseerror, fetched_at. ``equality``: the collation under which addresses are one.
    """
    return {
        "listurls": commit_list_pages(results, listurls),
        "sites": commit_clocks(results, sites),
        "contenturls": commit_links(results, contenturls, now, equality),
    }


def image_rows(bodies: DataFrame, titles: DataFrame, images: DataFrame, now: int) -> DataFrame:
    """New image rows, numbered by article, body images before the title image (``is_title``)."""
    title_rows = titles.filter(strip(F.col("titleimage")) != "").select(
        "cuid",
        "sid",
        F.lit(0).alias("pos"),
        F.col("titleimage").alias("urlabs"),
        F.col("titleimage").alias("urlsrc"),
        upload_path(F.col("sid"), now).alias("path"),
        filename_column(F.col("cuid"), F.lit("title")).alias("filename"),
        F.lit(1).alias("is_title"),
    )
    rows = bodies.withColumn("is_title", F.lit(0)).unionByName(title_rows)
    return new_ids(rows, images, "imgid", [F.col("cuid"), F.col("is_title"), F.col("pos")])


def _commit_bodies(
    read: DataFrame, contenturls: DataFrame, images: DataFrame, changed: list[str], now: int
) -> dict[str, DataFrame]:
    """Images and article rows of results whose bodies are read (``_images`` an array, ``changed`` the columns).

    The results are stored first: they are read for the images and again for
    the articles, and parsing the pages is by far the dearest step.
    """
    read = stored(read, **BODY_FILES)
    done = read.filter(F.col("status") == DONE)
    numbered = image_rows(manifest_rows(done, F.col("_images"), now), done, images, now)
    title_ids = numbered.filter("is_title = 1").select("cuid", F.col("imgid").alias("titleimageid"))
    rows = read.join(title_ids, "cuid", "left").withColumn("titleimageid", F.coalesce("titleimageid", F.lit(0)))
    added = numbered.withColumn("dateline", F.lit(now))
    return {
        "images": images.unionByName(conform(added, "images")),
        "contenturls": update_bodies(contenturls, rows.select("cuid", *changed, "titleimageid"), read, "cuid"),
    }


ARTICLE_CHANGES = (
    "source postdate lastupdate title author contenttext contentsource contentabsurl contentlocalurl status "
    "imagefinish connecterror parseerror duration"
).split()


def article_bodies(results: DataFrame, now: int) -> DataFrame:
    """What results of article fetches change, with the images of each body as ``_images``.

    The status is fixed before the body is read: a body that cannot be read
    leaves status 2 with ``parseerror`` set.
    """
    rows = results.withColumn("status", status_of_result())
    done = F.col("status") == DONE
    body = normal_body(F.when(done, F.col("content")), F.col("url"), upload_path(F.col("sid"), now), F.col("cuid"))
    return rows.withColumn("_body", body).select(
        "attempt",
        "cuid",
        "sid",
        "source",
        "postdate",
        F.col("fetched_at").alias("lastupdate"),
        "title",
        "author",
        F.col("_body.text").alias("contenttext"),
        F.col("content").alias("contentsource"),
        F.col("_body.abs").alias("contentabsurl"),
        F.col("_body.local").alias("contentlocalurl"),
        "titleimage",
        "status",
        (done & (F.size("_body.images") == 0)).cast("int").alias("imagefinish"),
        "connecterror",
        F.when(done, F.col("_body.error")).otherwise(F.col("parseerror")).alias("parseerror"),
        "duration",
        F.col("_body.images").alias("_images"),
    )


def commit_article_rows(
    results: DataFrame, contenturls: DataFrame, images: DataFrame, now: int
) -> dict[str, DataFrame]:
    """Articles with their fields and bodies, and images with the new ones."""
    read = article_bodies(last_attempts(results, "cuid"), now)
    return _commit_bodies(read, contenturls, images, ARTICLE_CHANGES, now)


def _tagged(results: DataFrame) -> DataFrame:
    """Tag texts of the articles read."""
    narrow = results.select("attempt", "cuid", "tag", "joberror", "connecterror", "parseerror")
    return last_attempts(narrow, "cuid").filter(status_of_result() == DONE).select("cuid", "tag")


def commit_tag_names(results: DataFrame, articletags: DataFrame, equality: str = EXACT) -> DataFrame:
    """Tags with those of the articles read; their bridge is not looked at."""
    return upsert_tags(_tagged(results), articletags, equality)


def commit_article_tags(results: DataFrame, articletags: DataFrame, contenttags: DataFrame, equality: str = EXACT) -> dict[str, DataFrame]:
    """Tags and their bridge with those of the articles read."""
    names = commit_tag_names(results, articletags, equality)
    return {"articletags": names, "contenttags": upsert_bridge(_tagged(results), names, contenttags, equality)}


def commit_articles(
    results: DataFrame,
    sites: DataFrame,
    contenturls: DataFrame,
    images: DataFrame,
    articletags: DataFrame,
    contenttags: DataFrame,
    now: int,
    equality: str = EXACT,
) -> dict[str, DataFrame]:
    """Article results: fields, bodies, images, tags, completeness, site clocks.

    ``results``: attempt, cuid, sid, url, source, content, title, author,
    postdate, tag, titleimage, duration, joberror, connecterror, parseerror,
    fetched_at. ``equality``: the collation under which tag names are one.
    """
    return {
        **commit_article_rows(results, contenturls, images, now),
        **commit_article_tags(results, articletags, contenttags, equality),
        "sites": commit_clocks(results, sites),
    }


ACCOUNT_CHANGES = (
    "source postdate lastupdate author extrainfo contenttext contentsource contentabsurl contentlocalurl status "
    "imagefinish connecterror parseerror duration"
).split()


def account_bodies(pages: DataFrame, now: int) -> DataFrame:
    """What saved account articles change, with the images of each body as ``_images``."""
    read = account_articles(pages.withColumn("source", F.col("body")), now)
    # Columns are NULL only where nothing was read; then nothing is known, not even that images are missing.
    was_read = F.col("content").isNotNull()

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    return read.select(
        "attempt",
        "cuid",
        "sid",
        F.when(was_read, F.col("source")).otherwise(F.lit("")).alias("source"),
        known("postdate"),
        F.col("fetched_at").alias("lastupdate"),
        known("author"),
        F.when(was_read, counts_caption(F.col("readcount"), F.col("likecount"))).otherwise(F.lit("")).alias("extrainfo"),
        known("contenttext"),
        F.coalesce("content", F.lit("")).alias("contentsource"),
        known("contentabsurl"),
        known("contentlocalurl"),
        known("titleimage"),
        status_of_result().alias("status"),
        F.when(was_read, (F.size("images") == 0).cast("int")).otherwise(0).alias("imagefinish"),
        "connecterror",
        "parseerror",
        "duration",
        F.col("images").alias("_images"),
    )


def commit_account_articles(
    pages: DataFrame, sites: DataFrame, contenturls: DataFrame, images: DataFrame, now: int
) -> dict[str, DataFrame]:
    """Saved account articles: as ``commit_articles``, without tags, keeping the title of the list.

    ``pages``: attempt, cuid, sid, body, duration, joberror, connecterror, fetched_at.
    """
    read = account_bodies(last_attempts(pages, "cuid"), now)
    return {
        **_commit_bodies(read, contenturls, images, ACCOUNT_CHANGES, now),
        "sites": commit_clocks(pages, sites),
    }


def commit_images(results: DataFrame, images: DataFrame, contenturls: DataFrame) -> dict[str, DataFrame]:
    """Image results, and articles complete by them.

    ``results``: attempt, imgid, size, duration, connecterror, fetched_at.
    """
    last = last_attempts(results, "imgid")
    changes = last.select(
        "imgid",
        result_status(F.lit(""), F.col("connecterror"), F.lit("")).alias("status"),
        F.col("fetched_at").alias("lastupdate"),
        "size",
        "duration",
        "connecterror",
    )
    after = update(images, changes, "imgid", F.col("_hit"))
    return {
        "images": after.drop("_hit"),
        "contenturls": mark_complete(contenturls, complete_by(after, F.col("_hit"))),
    }


def due_lists(pages: DataFrame, sites: DataFrame, now: int) -> DataFrame:
    """Saved list pages of the account sites that are due, with their content type."""
    due = due_account_sites(sites, now).select("sid", wxconfig_contenttype().alias("contenttype"))
    return pages.join(due, "sid")


def commit_account_items(pages: DataFrame, sites: DataFrame, contenturls: DataFrame, now: int, equality: str = EXACT) -> DataFrame:
    """Articles with the new ones that the saved lists of due account sites name."""
    listed = account_items(due_lists(pages, sites, now), F.col("contenttype"))
    items = explode_items(listed, "sid").select(
        F.col("sid").alias("page"), "pos", "sid", "title", F.col("link").alias("url"), "postdate"
    )
    return contenturls.unionByName(insert_account_items(items, contenturls, now, equality))


def commit_account_clocks(pages: DataFrame, sites: DataFrame, now: int) -> DataFrame:
    """Sites with the clock and the mark of those whose list was read, in vain or not."""
    touched = due_lists(pages.select("sid"), sites, now).select("sid").distinct()
    return update(sites, touched.select("sid", F.lit(now).alias("lastfetch"), F.lit(1).alias("listcreated")), "sid")


def commit_account_lists(pages: DataFrame, sites: DataFrame, contenturls: DataFrame, now: int, equality: str = EXACT) -> dict[str, DataFrame]:
    """Saved list pages of due account sites: new articles, clocks, and the mark that a list was read.

    ``pages``: one of ``sid, url, body, connecterror`` per site.
    """
    return {
        "sites": commit_account_clocks(pages, sites, now),
        "contenturls": commit_account_items(pages, sites, contenturls, now, equality),
    }
