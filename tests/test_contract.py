"""Every registered query against its check on the smallest tables, and what its plan may not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from workload.compare import check_database, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    return check_database(FOLDER)


# At ten sites nobody has an account whose list is due.
MAY_BE_EMPTY = {"f5_due_account_sites", "f3_due_account_articles"}


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_agrees_with_its_check(spark, base, name):
    verdict = compare(spark, base, FOLDER, contract.queries()[name], contract.oracle_sql().get(name))
    assert verdict == "" or name in MAY_BE_EMPTY and verdict == "no rows in either"


def test_entry_gives_a_page(spark):
    assert contract.entry(spark).count() == 10


def plan(spark, name):
    return contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["x1_html_links", "x2_json_links", "x3_html_fields", "x8_normal_bodies", "x9_image_manifest"])
def test_pages_are_parsed_once(spark, name):
    assert plan(spark, name).count("EvalPython") == 1


@pytest.mark.parametrize("name", ["t1_next_list_page", "t2_next_article", "t3_next_image", "j5_unseen_links", "a2_images_complete", "a5_latest_fetch"])
def test_no_site_or_link_is_gathered_in_one_task(spark, name):
    text = plan(spark, name)
    assert "Window" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SortAggregate" not in text


def test_the_page_filter_reaches_the_scan(spark, tmp_path):
    from gleaner.operators.select import due_images, visible_articles
    from gleaner.plans.queries import of_keys
    from gleaner.sources.tables import read_table, write_table

    for table, key in (("contenturls", "cuid"), ("images", "imgid"), ("sites", "sid")):
        write_table(spark.range(1000).selectExpr(f"id AS {key}"), str(tmp_path), table)
    articles, images, sites = (read_table(spark, str(tmp_path), table) for table in ("contenturls", "images", "sites"))

    def scans(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    rows = of_keys(articles, "cuid", spark.createDataFrame([(7,), (9,)], "cuid bigint"))
    assert "GreaterThanOrEqual(cuid,7), LessThanOrEqual(cuid,9)" in scans(rows) and rows.count() == 2
    assert "In(status, [0,3])" in scans(due_images(images))
    counted = visible_articles(articles, sites).groupBy().count()
    assert "EqualTo(status,2)" in scans(counted) and "contenttext" not in scans(counted)


def wide_shuffles(frame, *columns):
    """Shuffles that carry one of the columns, with broadcast joins switched off."""
    spark = frame.sparkSession
    text = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    return sum(any(re.search(rf"\b{name}#", given) for name in columns) for given in inputs)


@pytest.fixture
def snapshot(spark, tmp_path):
    """Empty state tables as a snapshot, without broadcast joins."""
    from gleaner.schemas import SCHEMAS
    from gleaner.sources.tables import read_table, write_table

    names = ("contenturls", "sites", "images", "contenttags", "articletags")
    for name in names:
        write_table(spark.createDataFrame([], SCHEMAS[name]), str(tmp_path), name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield [read_table(spark, str(tmp_path), name) for name in names]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bodies_move_once_for_an_answer(spark, snapshot):
    from gleaner.plans import queries

    bodies = ("contentabsurl", "contentlocalurl", "contenttext")
    assert wide_shuffles(queries.content_details(*snapshot), *bodies) <= 1
    asked = spark.range(5).select(F.col("id").alias("cuid"))
    assert wide_shuffles(queries.content_json(*snapshot, asked), *bodies) <= 1


def test_items_are_reduced_without_sorting_them(spark):
    from gleaner.operators.links import unseen_links

    items = spark.createDataFrame([], "page bigint, pos int, sid bigint, title string, url string, postdate string")
    known = spark.createDataFrame([], "sid bigint, title string")
    text = unseen_links(items, known, ["sid", "title"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "Window" not in text


def test_a_deep_page_costs_what_the_first_does(spark):
    from gleaner.operators.select import article_page

    rows = spark.range(1000).select(F.col("id").alias("cuid"))
    deep = article_page(rows, 100_000, 100)
    text = deep._jdf.queryExecution().executedPlan().toString()
    assert max(map(int, re.findall(r"limit=(\d+)", text))) <= 100 and "offset" not in text.lower()
    assert deep.count() == 0
    assert [r.cuid for r in article_page(rows, 4, 300).collect()] == list(range(99, -1, -1))


def test_pages_cross_the_ranges_ids_are_counted_in(spark, monkeypatch):
    from gleaner.operators import select

    monkeypatch.setattr(select, "_RANGE_BITS", 3)
    ids = [k for k in range(200) if k % 7]
    rows = spark.createDataFrame([(k,) for k in ids], "cuid bigint")
    for page in (1, 2, 9, 18):
        found = [r.cuid for r in select.article_page(rows, page, 10).collect()]
        assert found == sorted(ids, reverse=True)[(page - 1) * 10 : page * 10]
