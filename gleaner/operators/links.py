"""New articles from links: unique by address, or by title within an account site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.operators.keys import EXACT, first_spellings, new_ids, reading_order, without_known
from gleaner.sources.tables import conform


def unseen_links(links: DataFrame, contenturls: DataFrame, on: list[str], equality: str = EXACT) -> DataFrame:
    """One row per key of ``links`` that no article has yet.

    ``links`` holds ``page, pos`` and the key columns. A key found several
    times keeps the first page, and on it the last place. That is an aggregate
    over one number with map-side partial results, so a link found on a third
    of all pages never gathers in one task; over texts it would be a sort. The
    other columns are joined back for the keys that are left. ``equality`` is the
    collation that says which texts are one key; the first spelling is kept.
    """
    placed, first = first_places(links, on)
    fresh = without_known(first_spellings(first, on, "_order", equality), contenturls, on, equality)
    return placed.join(fresh, [*on, "_order"]).select(*links.columns)


def first_places(links: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links with their place ``_order`` in the batch, and the first place of each key."""
    placed = links.withColumn("_order", reading_order("page", -F.col("pos")))
    return placed, placed.groupBy(*on).agg(F.min("_order").alias("_order"))


def insert_links(links: DataFrame, contenturls: DataFrame, now: int, equality: str = EXACT) -> DataFrame:
    """New article rows for links (``page, pos, luid, sid, url``) not stored for any site.

    Pages are taken in order and each page's links from the last to the first,
    which is the order of the new ids.
    """
    fresh = unseen_links(links, contenturls, ["url"], equality)
    return numbered_articles(fresh, contenturls, now)


def insert_account_items(items: DataFrame, contenturls: DataFrame, now: int, equality: str = EXACT) -> DataFrame:
    """New article rows for account items (``page, pos, sid, title, url, postdate``).

    An item is known when its site has an article of the same title; the same
    title on two sites is two articles.
    """
    fresh = unseen_links(items, contenturls, ["sid", "title"], equality)
    return numbered_articles(fresh, contenturls, now)


def numbered_articles(fresh: DataFrame, contenturls: DataFrame, now: int) -> DataFrame:
    """New article rows with ids above those of ``contenturls``."""
    numbered = new_ids(fresh, contenturls, "cuid", [F.col("page"), F.desc("pos")])
    return conform(numbered.withColumn("dateline", F.lit(now)), "contenturls")
