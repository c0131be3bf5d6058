"""The commit jobs over a store: each writes the buckets and index parts it touches and gives the next snapshot's number.

They make what the jobs of ``commit`` make of whole tables. Results come as a stored table with a unique ``attempt`` number.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gleaner.functions.columns import excerpt, page_arguments, result_status
from gleaner.operators.accounts import account_items, explode_items
from gleaner.operators.bodies import manifest_rows
from gleaner.operators.extract import explode_links
from gleaner.operators.keys import EXACT, first_spellings
from gleaner.operators.links import first_places, numbered_articles
from gleaner.operators.membership import TITLES, URLS, Membership, indexed, store_tables, title_key
from gleaner.operators.rollup import attempts, latest_fetch
from gleaner.operators.tags import missing_pairs, unknown_tags
from gleaner.plans import commit as whole
from gleaner.plans.queries import ROW_COLUMNS, listed_articles, of_keys, with_title_image
from gleaner.schemas import DONE, WAITING
from gleaner.session import stored
from gleaner.sources.store import RANGE_BITS, Commit, Kept, Store
from gleaner.sources.tables import conform

# Finished articles, and those with all images, per range of ids and site.
_COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in ("part", "sid", "done", "complete")])
_COUNT_BITS = 8  # ranges whose counts lie in one folder


def collection(spark: SparkSession, root: str, bits: int | dict[str, int] = RANGE_BITS, urls: Membership = URLS, titles: Membership = TITLES, equality: str = EXACT, **options) -> Store:
    """A store of the six state tables with their indexes: known addresses, known titles, counts of finished articles.

    Under ``equality`` (exact, or ``ANY_CASE``) addresses, titles and tag names are told apart; a store keeps to the one it was started with.
    """
    urls, titles = replace(urls, equality=equality), replace(titles, equality=equality)
    counts = Kept(_COUNTS, "part", lambda: F.shiftright("part", _COUNT_BITS))
    store = Store(spark, root, {**store_tables(urls, titles), "counts": counts}, bits, **options)
    store.urls, store.titles = urls, titles
    return store


def start(store: Store, tables: dict[str, DataFrame]) -> int:
    """The first snapshot with its indexes, from whole state tables."""
    first = store.start(tables)
    commit = store.begin(first)
    articles = commit.read("contenturls")
    indexed(commit, articles, store.urls, store.titles)
    _recount(commit, set(commit.after["contenturls"]))
    return commit.finish()


def _recount(commit: Commit, parts: set[int]) -> None:
    """Count the finished articles of some id ranges anew, from the narrow columns of their files."""
    if not parts:
        return
    rows = commit.narrow("contenturls", sorted(parts)).where(F.col("status") == DONE)
    part = commit.store.tables["contenturls"].bucket().cast("bigint").alias("part")
    new = rows.groupBy(part, "sid").agg(F.count("*").alias("done"), F.count_if(F.col("imagefinish") == 1).alias("complete"))
    wider = {p >> _COUNT_BITS for p in parts}
    touched = commit.spark.createDataFrame([(p,) for p in sorted(parts)], "part bigint")
    kept = commit.read("counts", sorted(wider)).join(touched, "part", "left_anti")
    commit.replace("counts", wider, kept.unionByName(new.select("part", "sid", "done", "complete")))


def _clocks(commit: Commit, latest: DataFrame) -> None:
    """Move the clocks of sites forward to their latest fetch (``sid, lastfetch``)."""
    now = commit.read("sites").select("sid", F.col("lastfetch").alias("_held"))
    commit.update("sites", latest.join(now, "sid").select("sid", F.greatest("lastfetch", "_held").alias("lastfetch")))


def _last(commit: Commit, table: str) -> DataFrame:
    """The rows of a table's last key range: where new ids go on."""
    buckets = commit.after[table]
    return commit.read(table, [max(buckets)] if buckets else [])


def _insert(commit: Commit, fresh: DataFrame, now: int) -> set[int]:
    """Append new articles and index them; gives the ranges they fall into."""
    rows = commit.staged(numbered_articles(fresh, _last(commit, "contenturls"), now))
    indexed(commit, rows, commit.store.urls, commit.store.titles)
    return commit.append("contenturls", rows)


def new_links(commit: Commit, links: DataFrame) -> DataFrame:
    """One row per address of ``links`` (``page, pos, url`` and others) that no article has, told by the index."""
    placed, first = first_places(links, ["url"])
    first = first_spellings(first, ["url"], "_order", commit.store.urls.equality)
    fresh = commit.store.urls.unseen(commit, first.withColumnRenamed("url", "key")).withColumnRenamed("key", "url")
    return placed.join(fresh, ["url", "_order"]).select(*links.columns)


def new_items(commit: Commit, items: DataFrame) -> DataFrame:
    """One row per site and title of ``items`` that no article has, told by the index."""
    keyed = items.withColumn("key", title_key(F.col("sid"), F.col("title")))
    placed, first = first_places(keyed, ["key"])
    first = first_spellings(first, ["key"], "_order", commit.store.titles.equality)
    fresh = commit.store.titles.unseen(commit, first)
    return placed.join(fresh, ["key", "_order"]).select(*items.columns)


def commit_links(store: Store, number: int, links: DataFrame, now: int) -> int:
    """New articles from links (``page, pos, luid, sid, url``) alone."""
    commit = store.begin(number)
    _recount(commit, _insert(commit, new_links(commit, links), now))
    return commit.finish()


def commit_lists(store: Store, number: int, results: DataFrame, now: int) -> int:
    """List page results: status, errors and counters, site clocks, new articles; columns as for ``commit.commit_lists``."""
    commit = store.begin(number)
    changes = results.select(
        "luid", "attempt", "source", whole.status_of_result().alias("status"), F.col("fetched_at").alias("lastupdate"), "duration", "connecterror", "parseerror"
    )
    commit.update("listurls", changes, "attempt", ("connectcount", "parsecount"))
    _clocks(commit, latest_fetch(results))
    links = explode_links(results, "attempt", "luid", "sid")
    links = links.select(F.col("attempt").alias("page"), "pos", "luid", "sid", F.col("link").alias("url"))
    _recount(commit, _insert(commit, new_links(commit, links), now))
    return commit.finish()


def _bodies(commit: Commit, read: DataFrame, changed: list[str], now: int) -> None:
    """Images and article rows of results whose bodies are read: parsed rows are written once for this commit, and go with it."""
    read = commit.staged(read)
    narrow = read.select("attempt", "cuid", "sid", "status", "titleimage", "_images")
    last = attempts(narrow.select("attempt", "cuid"), "cuid").select("cuid", "attempt")
    done = narrow.join(last, ["cuid", "attempt"]).where(F.col("status") == DONE)
    numbered = commit.staged(whole.image_rows(manifest_rows(done, F.col("_images"), now), done, _last(commit, "images"), now))
    commit.append("images", conform(numbered.withColumn("dateline", F.lit(now)), "images"))
    titles = last.join(numbered.where("is_title = 1").select("cuid", F.col("imgid").alias("titleimageid")), "cuid", "left")
    titles = titles.select("cuid", F.coalesce("titleimageid", F.lit(0)).alias("titleimageid"))
    _recount(commit, commit.update("contenturls", read.select("cuid", "attempt", *changed), "attempt", also=titles))


def commit_articles(store: Store, number: int, results: DataFrame, now: int) -> int:
    """Article results: fields, bodies, images, tags, completeness, site clocks; columns as for ``commit.commit_articles``."""
    commit = store.begin(number)
    _bodies(commit, whole.article_bodies(results, now), whole.ARTICLE_CHANGES, now)
    narrow = results.select("attempt", "cuid", "tag", "joberror", "connecterror", "parseerror")
    tagged = whole.last_attempts(narrow, "cuid").where(whole.status_of_result() == DONE).select("cuid", "tag")
    commit.append("articletags", unknown_tags(tagged, commit.read("articletags"), store.urls.equality))
    commit.append("contenttags", missing_pairs(tagged, commit.read("articletags"), commit.read("contenttags"), store.urls.equality))
    _clocks(commit, latest_fetch(results))
    return commit.finish()


def commit_account_articles(store: Store, number: int, pages: DataFrame, now: int) -> int:
    """Saved account articles; columns as for ``commit.commit_account_articles``."""
    commit = store.begin(number)
    _bodies(commit, whole.account_bodies(pages, now), whole.ACCOUNT_CHANGES, now)
    _clocks(commit, latest_fetch(pages))
    return commit.finish()


def commit_images(store: Store, number: int, results: DataFrame) -> int:
    """Image results, and articles complete by them; columns as for ``commit.commit_images``.

    Which articles are complete is read from the article and the status of images alone.
    """
    commit = store.begin(number)
    changes = results.select(
        "imgid", "attempt", result_status(F.lit(""), F.col("connecterror"), F.lit("")).alias("status"), F.col("fetched_at").alias("lastupdate"), "size", "duration", "connecterror"
    )
    touched = commit.update("images", changes, "attempt")
    hit = commit.read("images", sorted(touched)).select("imgid", "cuid").join(results.select("imgid"), "imgid", "left_semi").select("cuid").distinct()
    waiting = commit.read("images").where(F.col("status") == WAITING).select("cuid")
    complete = hit.join(waiting, "cuid", "left_anti").withColumn("imagefinish", F.lit(1))
    _recount(commit, commit.update("contenturls", commit.staged(complete)))
    return commit.finish()


def commit_account_lists(store: Store, number: int, pages: DataFrame, now: int) -> int:
    """Saved list pages of due account sites; columns as for ``commit.commit_account_lists``."""
    commit = store.begin(number)
    due = whole.due_lists(pages, commit.read("sites"), now)
    items = explode_items(account_items(due, F.col("contenttype")), "sid")
    items = commit.staged(items.select(F.col("sid").alias("page"), "pos", "sid", "title", F.col("link").alias("url"), "postdate"))
    parts = _insert(commit, new_items(commit, items), now)
    seen = commit.staged(due.select("sid").distinct().select("sid", F.lit(now).alias("lastfetch"), F.lit(1).alias("listcreated")))
    commit.update("sites", seen)
    _recount(commit, parts)
    return commit.finish()


def _visible_counts(store: Store, number: int, sid: int = 0) -> DataFrame:
    """Visible articles per id range, from the counts and the sites."""
    counts = store.read(number, "counts")
    counts = counts.where(F.col("sid") == sid) if sid else counts
    local = store.read(number, "sites").select("sid", "islocal")
    shown = F.when(F.col("islocal") == 0, F.col("done")).when(F.col("islocal") == 1, F.col("complete")).otherwise(0)
    return counts.join(local, "sid").groupBy("part").agg(F.sum(shown).alias("rows"))


def content_count(store: Store, number: int, sid: int = 0) -> DataFrame:
    """How many articles all pages hold together, of one site or all; no article is read."""
    return _visible_counts(store, number, sid).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rscount"))


def page_parts(store: Store, number: int, sid: int = 0, page: int = 1, count: int = 10) -> tuple[list[int], int]:
    """The id ranges that a page of visible articles touches, and how many visible ones of these come before it."""
    page, count = page_arguments(page, count)
    skip = (page - 1) * count
    newer = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per 65,536 ids.
    before = _visible_counts(store, number, sid).where("rows > 0").withColumn("before", F.coalesce(F.sum("rows").over(newer), F.lit(0)))
    touched = before.where((F.col("before") < skip + count) & (F.col("before") + F.col("rows") > skip)).orderBy(F.desc("part")).collect()
    return [r.part for r in touched], skip - touched[0].before if touched else 0


def content_list(store: Store, number: int, sid: int = 0, page: int = 1, count: int = 10) -> DataFrame:
    """One page of visible articles, newest first, as ``queries.content_list`` gives it; only the ranges it touches are read."""
    parts, skip = page_parts(store, number, sid, page, count)
    _, count = page_arguments(page, count)
    articles, sites = store.read(number, "contenturls", parts), store.read(number, "sites")
    narrow = listed_articles(articles, sites, sid).select("cuid", "titleimageid")
    keys = stored(narrow.orderBy(F.desc("cuid")).offset(skip).limit(count))
    rows = listed_articles(of_keys(articles, "cuid", keys.select("cuid")), sites)
    shown = with_title_image(rows, of_keys(store.read(number, "images"), "imgid", keys.select("titleimageid")))
    return shown.withColumn("content", excerpt(F.col("contenttext"))).select(*ROW_COLUMNS)
