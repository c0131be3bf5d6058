"""A third of all rows on one key: results stay whole, and what crosses a shuffle stays small."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import links, rollup, select
from gleaner.operators.keys import ANY_CASE, first_spellings
from gleaner.sources.tables import conform

ROWS = 60000


def hot(spark, name):
    """Rows of which a third share key 1 and the rest have keys of their own."""
    ident = F.col("id")
    return spark.range(0, ROWS, 1, 6).withColumn(name, F.when(ident % 3 == 0, 1).otherwise(ident + 10))


def shuffled_rows(frame):
    """Records written to shuffles by a query, from its executed plan."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name == "ShuffleQueryStageExec":
            node = node.plan()
            name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo.extend(children.apply(place) for place in range(children.size()))
    return total


def test_a_hot_link_is_reduced_before_the_shuffle(spark):
    found = hot(spark, "n").select(
        F.col("id").alias("page"), F.lit(0).alias("pos"), F.lit(1).alias("luid"), F.lit(1).alias("sid"), F.concat(F.lit("u"), "n").alias("url")
    )
    fresh = links.unseen_links(found, conform(spark.range(0).select(), "contenturls"), ["url"])
    assert shuffled_rows(fresh) <= ROWS * 2 // 3 + 10
    rows = fresh.agg(F.count("*"), F.count_distinct("url")).first()
    assert tuple(rows) == (ROWS * 2 // 3 + 1,) * 2
    assert fresh.filter("url = 'u1'").first().page == 0


def test_a_hot_link_in_any_case_is_reduced_before_it_is_sorted(spark):
    found = hot(spark, "n").select(
        F.col("id").alias("page"), F.lit(0).alias("pos"), F.lit(1).alias("luid"), F.lit(1).alias("sid"),
        F.concat(F.when(F.col("id") % 2 == 0, "u").otherwise("U"), "n").alias("url"),
    )
    _, first = links.first_places(found, ["url"])
    kept = first_spellings(first, ["url"], "_order", ANY_CASE)
    # Two spellings of the hot one at most reach the collated grouping, of which each task sends one row a key.
    assert shuffled_rows(kept) <= 2 * (ROWS * 2 // 3 + 20)
    rows = links.unseen_links(found, conform(spark.range(0).select(), "contenturls"), ["url"], ANY_CASE)
    assert rows.agg(F.count("*"), F.count_distinct(F.lower("url"))).first() == (ROWS * 2 // 3 + 1,) * 2


def test_a_hot_site_is_reduced_before_the_shuffle(spark):
    pages = hot(spark, "sid").select(
        F.col("id").alias("luid"), "sid", F.lit(1).alias("isenable"), F.lit(0).alias("status"), F.lit(0).alias("isfirst")
    )
    sites = conform(pages.select("sid").distinct(), "sites")
    best = select.next_list_page(pages, sites, 10**9)
    assert best.count() == ROWS * 2 // 3 + 1
    assert best.filter("sid = 1").first().luid == ROWS - 3
    latest = rollup.latest_fetch(pages.withColumnRenamed("luid", "fetched_at"))
    assert shuffled_rows(latest) <= ROWS * 2 // 3 + 10
    assert latest.filter("sid = 1").first().lastfetch == ROWS - 3
