"""Queries over a store: commits that write only what they touch, known addresses by index, pages by counts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gleaner.operators.keys import ANY_CASE
from gleaner.operators.membership import Membership
from gleaner.plans import increments
from gleaner.plans.commit import status_of_result
from gleaner.schemas import STATE_TABLES
from gleaner.session import new_folder, stored
from gleaner.streaming import streams
from workload.native import FRESH_ANY_CASE, FRESH_LINKS, VISIBLE, _host_links, _shouted_links
from workload.pages import CONTENT_RULE, LISTED, NEW_IMAGES, _list_results
from workload.registry import TEXTS, query
from workload.standins import CLOCK, NOW

# Several key ranges for the small tables too; the stand-ins leave gaps in the ids of images and of the bridge.
BITS = {"sites": 8, "listurls": 10, "contenturls": 12, "images": 16, "contenttags": 22}
PAGE_ROWS = 2000  # of an arriving file of pages, about
INDEX = dict(urls=Membership("urls", 8, 1 << 10), titles=Membership("titles", 8, 1 << 10))


def _store(t):
    """A branch of the folder's store, which is started once per session, and its snapshot. Articles stay in their own table, which is the store's base."""
    held = getattr(t.spark, "_store", None)
    if held is None or held[0] != t.folder:
        tables = {name: t.state(name) for name in STATE_TABLES}
        store = increments.collection(t.spark, new_folder(t.spark, "stores"), BITS, base={"contenturls": tables.pop("contenturls")}, **INDEX)
        held = t.spark._store = (t.folder, store, increments.start(store, tables))
    _, store, number = held
    return store.branch(number, new_folder(t.spark, "stores")), number


def _same_as(name: str) -> str:
    """The check of the job over whole tables."""
    return TEXTS[name]


@query("s3_store_list_pages", _same_as("p1_list_results"))
def store_list_pages(t):
    """List pages after a commit of their results into the store."""
    store, number = _store(t)
    after = increments.commit_lists(store, number, _list_results(t), NOW)
    return store.read(after, "listurls").select("luid", "connectcount", "parsecount", "lastupdate", "duration", "status", "source")


@query("s3_store_new_articles", _same_as("p1_new_articles"))
def store_new_articles(t):
    """Articles after a commit of list page results into the store."""
    store, number = _store(t)
    after = increments.commit_lists(store, number, _list_results(t), NOW)
    return store.read(after, "contenturls").select("cuid", "luid", "sid", "url", "title", "dateline")


@query("s3_store_articles", _same_as("p2_article_results"))
def store_articles(t):
    """Articles after a commit of their results into the store."""
    store, number = _store(t)
    after = increments.commit_articles(store, number, t.article_results, NOW)
    return store.read(after, "contenturls").select(
        "cuid", "title", "author", "postdate", "status", "contenttext", "contentabsurl", "contentlocalurl", "contentsource",
        "titleimageid", "imagefinish", "connecterror", "parseerror",
    )


@query("s3_store_article_images", f"WITH {NEW_IMAGES} SELECT imgid, cuid, sid, urlabs, filename FROM v_images UNION ALL SELECT imgid, cuid, sid, urlabs, filename FROM added")
def store_article_images(t):
    """Images after a commit of article results into the store."""
    store, number = _store(t)
    after = increments.commit_articles(store, number, t.article_results, NOW)
    return store.read(after, "images").select("imgid", "cuid", "sid", "urlabs", "filename")


@query("s3_store_account_articles", _same_as("p3_account_article_results"))
def store_account_articles(t):
    """Articles after a commit of saved account articles into the store."""
    store, number = _store(t)
    after = increments.commit_account_articles(store, number, t.account_articles.drop("text"), NOW)
    return store.read(after, "contenturls").select("cuid", "title", "author", "postdate", "extrainfo", "status", "contenttext", "imagefinish", "lastupdate")


@query("s3_store_images", _same_as("p4_image_results"))
def store_images(t):
    """Images after a commit of their results into the store."""
    store, number = _store(t)
    after = increments.commit_images(store, number, t.image_results)
    return store.read(after, "images").select("imgid", "status", "size", "duration", "connecterror")


@query("s3_store_completed_articles", _same_as("p4_completed_articles"))
def store_completed_articles(t):
    """Articles after a commit of image results into the store."""
    store, number = _store(t)
    after = increments.commit_images(store, number, t.image_results)
    return store.read(after, "contenturls").select("cuid", "imagefinish")


@query("j6_indexed_items", _same_as("p5_account_lists"))
def indexed_items(t):
    """Articles after a commit of account lists into the store; known titles are told by the index."""
    store, number = _store(t)
    after = increments.commit_account_lists(store, number, t.site_lists, CLOCK)
    return store.read(after, "contenturls").select("cuid", "sid", "title", "url", "postdate", "dateline")


@query("j5_indexed_links", _same_as("j5_unseen_links"))
def indexed_links(t):
    """Links no article has yet, told by the index of addresses."""
    found, stored = _host_links(t)
    store = increments.collection(t.spark, new_folder(t.spark, "stores"), 20, **INDEX)
    number = increments.start(store, {"contenturls": stored})
    return increments.new_links(store.begin(number), found).select("url", "page", "pos", "luid")


@query("j5_indexed_links_any_case", f"WITH {FRESH_ANY_CASE} SELECT url, page, pos, luid FROM fresh")
def indexed_links_any_case(t):
    """Links that no article has in any case, told by an index of folded addresses."""
    found, stored = _shouted_links(t)
    store = increments.collection(t.spark, new_folder(t.spark, "stores"), 20, equality=ANY_CASE, **INDEX)
    number = increments.start(store, {"contenturls": stored})
    return increments.new_links(store.begin(number), found).select("url", "page", "pos", "luid")


@query("q2_counted_list", f"{LISTED} ORDER BY v.cuid DESC LIMIT 10 OFFSET 20")
def counted_list(t):
    """The third page of articles of all sites, by the counts of id ranges."""
    store, number = _store(t)
    return increments.content_list(store, number, 0, 3, 10)


COMPLETE = "SELECT cuid FROM v_images GROUP BY cuid HAVING count(*) FILTER (status = 0) = 0"


@query(
    "a1_counted_total_after_images",
    f"""SELECT count(*) AS rscount FROM v_contenturls c JOIN v_sites s ON s.sid = c.sid
  WHERE status = 2 AND (islocal = 0 OR imagefinish = 1 OR cuid IN ({COMPLETE}))""",
)
def counted_total_after_images(t):
    """How many articles there are to page through once image results are committed; the commit has moved the counts on."""
    store, number = _store(t)
    return increments.content_count(store, increments.commit_images(store, number, t.image_results))


@query("a1_counted_total", f"SELECT count(*) AS rscount FROM ({VISIBLE}) WHERE sid = 1")
def counted_total(t):
    """How many articles of the hot site there are to page through; no article is read."""
    store, number = _store(t)
    return increments.content_count(store, number, 1)


def _arriving(t, rows, files: int = 4, per_batch: int = 2):
    """Rows as a stream of several micro-batches."""
    folder = new_folder(t.spark, "arriving")
    rows.repartition(files).write.parquet(folder)
    return streams.page_stream(t.spark, folder, rows.schema, per_batch=per_batch)


@query("st2_stored_articles", f"WITH {FRESH_LINKS} SELECT url, CAST(count(*) AS BIGINT) AS articles FROM (SELECT url FROM fresh UNION ALL SELECT DISTINCT url FROM links WHERE page_url LIKE 'http://%') GROUP BY url")
def stored_article_batches(t):
    """Articles after a stream of links has been committed batch by batch to a store that holds some already."""
    found, known = _host_links(t)
    store = increments.collection(t.spark, new_folder(t.spark, "stores"), 20, **INDEX)
    first = increments.start(store, {"contenturls": known.dropDuplicates(["url"])})
    arriving = _arriving(t, found.select("page", "pos", "luid", "sid", "url"))
    streams.new_article_batches(arriving, store, first, new_folder(t.spark, "streams"), NOW).awaitTermination()
    return store.read(store.latest(), "contenturls").groupBy("url").agg(F.count("*").alias("articles"))


def _article_stream(t):
    """The given pages as arriving article pages, committed to an empty store; the schema and folder of what was parsed."""
    pages = t.list_pages.select("attempt", F.col("attempt").alias("cuid"), "sid", "url", "body", "connecterror", "duration", "fetched_at")
    # Two micro-batches, each of as many files as keep its tasks alike in size.
    batch = max(2, math.ceil(pages.count() / (2 * PAGE_ROWS)))
    results = streams.article_stream(_arriving(t, pages, 2 * batch, batch), t.sites)
    store = increments.collection(t.spark, new_folder(t.spark, "stores"), BITS, **INDEX)
    first = increments.start(store, {"sites": t.state("sites"), "contenturls": pages.select("cuid", "sid", "url")})
    folder = new_folder(t.spark, "streams")
    streams.article_batches(results, store, first, folder, NOW).awaitTermination()
    return results.schema, folder, store


# Sites have a good HTML rule, a good JSON rule (which no given page fits) or a bad one, by their number.
PAGE_STATUS = f"CASE WHEN {CONTENT_RULE} AND p.connecterror = '' THEN 2 WHEN (sid - 1) % 8 = 6 AND p.connecterror = '' THEN 4 ELSE 3 END"


@query("st1_article_fields", f"WITH f AS ({TEXTS['x3_html_fields']}) SELECT attempt, title, author, tag FROM f WHERE connecterror = ''")
def article_fields(t):
    """Fields of arriving article pages."""
    schema, folder, _ = _article_stream(t)
    return streams.read_fields(t.spark, schema, folder).select("attempt", "title", "author", "tag")


@query("st1_failed_pages", f"SELECT * FROM (SELECT attempt, {PAGE_STATUS} AS status FROM v_list_pages p) WHERE status <> 2")
def failed_article_pages(t):
    """Arriving article pages that could not be read, with the status they get."""
    schema, folder, _ = _article_stream(t)
    return streams.failed_pages(t.spark, schema, folder).select("attempt", status_of_result().alias("status"))


@query(
    "st1_stored_articles",
    f"WITH f AS ({TEXTS['x3_html_fields']}) SELECT p.attempt AS cuid, sid, {PAGE_STATUS} AS status, title FROM v_list_pages p JOIN f ON f.attempt = p.attempt",
)
def streamed_articles(t):
    """Articles after the stream of their pages has been committed batch by batch."""
    _, _, store = _article_stream(t)
    return store.read(store.latest(), "contenturls").select("cuid", "sid", "status", "title")


@query("st3_completed_articles", COMPLETE)
def completed_articles(t):
    """Articles all of whose images have a result, each once, from a stream of results with late and repeated ones."""
    images = t.images.select("cuid", "imgid", F.lit(0).alias("status"))
    results = stored(t.image_results.join(t.images.select("imgid", "cuid"), "imgid").select("cuid", "imgid", "attempt", F.lit(2).alias("status")))
    late = results.where("imgid % 3 = 0").withColumn("attempt", F.lit(-5).cast("bigint")).withColumn("status", F.lit(0))
    again = results.where("imgid % 4 = 0").withColumn("attempt", F.col("attempt") + 1)
    arriving = _arriving(t, results.union(late).union(again).orderBy(F.xxhash64("imgid", "attempt")))
    return streams.drain_to_parquet(streams.completed_articles(arriving, images, 2), streams.run_folder(t.spark))
