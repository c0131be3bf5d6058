"""A store that goes on from a table which stays where it is."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gleaner.plans import increments, queries
from gleaner.schemas import SCHEMAS
from gleaner.session import shared_dir
from gleaner.sources import store as module
from gleaner.sources.store import compact
from gleaner.sources.tables import conform, read_table, write_table
from tests.test_store import SMALL, counted, image_results, list_results, recounted, tables
from workload import stores

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def article_results(spark, keys):
    found = [(k, k, 1, "http://h/", "src", '<p>x<img src="/i.png"></p>', f"T{k}", "w", "d", "a,b", "", 1, "", "", "", 9) for k in keys]
    schema = "attempt bigint, cuid bigint, sid bigint, url string, source string, content string, title string, author string, postdate string, tag string, titleimage string, duration int, joberror string, connecterror string, parseerror string, fetched_at int"
    return spark.createDataFrame(found, schema)


@pytest.fixture
def both(spark, tmp_path):
    """The same tables in a store of their own, and in one whose articles stay where they are."""
    given = tables(spark)
    write_table(given["contenturls"], str(tmp_path / "elsewhere"), "contenturls")
    base = {"contenturls": read_table(spark, str(tmp_path / "elsewhere"), "contenturls")}
    own = increments.collection(spark, str(tmp_path / "own"), 4, **SMALL)
    based = increments.collection(spark, str(tmp_path / "based"), 4, base=base, **SMALL)
    rest = {name: frame for name, frame in given.items() if name != "contenturls"}
    return (own, increments.start(own, given)), (based, increments.start(based, rest))


def test_a_base_gives_what_a_copy_gives(spark, both, tmp_path):
    steps = [
        lambda s, n: n,
        lambda s, n: increments.commit_images(s, n, image_results(spark, [5, 6, 63, 64])),
        lambda s, n: increments.commit_articles(s, n, article_results(spark, [3, 4, 40, 500]), 90),
        lambda s, n: increments.commit_lists(s, n, list_results(spark, ["u1", "new", "other"]), 70),
        lambda s, n: increments.commit_images(s, n, image_results(spark, [7, 8, 199, 200])),
        lambda s, n: compact(s, n, "contenturls"),
    ]
    (own, one), (based, two) = both
    for step in steps:
        one, two = step(own, one), step(based, two)
        for table in SCHEMAS:
            if table in own.tables:
                assert rows(own.read(one, table)) == rows(based.read(two, table))
        assert rows(own.read(one, "contenturls", [0, 2, 5])) == rows(based.read(two, "contenturls", [0, 2, 5]))
        assert own.highest(one, "contenturls") == based.highest(two, "contenturls")
        assert counted(based, two) == recounted(based, two) == counted(own, one)
        assert rows(increments.content_list(own, one, 0, 3, 7)) == rows(increments.content_list(based, two, 0, 3, 7))
    assert rows(queries.content_list(based.read(two, "contenturls"), based.read(two, "sites"), based.read(two, "images"), 0, 2, 5)) == rows(increments.content_list(based, two, 0, 2, 5))


def test_ranges_that_a_commit_leaves_alone_stay_in_the_base(spark, both):
    _, (store, first) = both
    assert all(folders == [f"base:{bucket}"] for bucket, folders in store.manifest(first)["contenturls"].items())
    second = increments.commit_articles(store, first, article_results(spark, [3, 40]), 90)
    moved = {bucket for bucket, folders in store.manifest(second)["contenturls"].items() if folders != [f"base:{bucket}"]}
    assert moved == {0, 2}
    # A page of untouched articles is read from their rows in the base alone.
    low, high = (F.min("cuid"), F.max("cuid"))
    assert store.read(second, "contenturls", [4]).agg(low, high).first() == (64, 79)
    assert store.files("contenturls", store.manifest(second)["contenturls"], [1, 4, 5]).count() == 48


def test_a_base_that_is_not_given_is_missed(spark, both, tmp_path):
    _, (store, first) = both
    again = increments.collection(spark, store.root, 4, **SMALL)
    with pytest.raises(ValueError, match="contenturls"):
        again.read(first, "contenturls")
    again = increments.collection(spark, store.root, 4, base=store.base, **SMALL)
    assert rows(again.read(first, "contenturls")) == rows(conform(tables(spark)["contenturls"], "contenturls"))


@pytest.mark.parametrize("name", ["j6_indexed_items", "q2_counted_list", "s3_store_articles"])
def test_bodies_of_untouched_ranges_are_not_copied(spark, monkeypatch, name):
    monkeypatch.setitem(stores.BITS, "contenturls", 6)
    spark._store = None
    folder = f"{shared_dir(spark)}/stores"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    try:
        contract.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    finally:
        spark._store = None
    written = [f"{folder}/{one}/files" for one in set(os.listdir(folder)) - before]
    found = [d for top in written for d, _, _ in os.walk(top) if "/contenturls-" in d and "_bucket=" in d and module._MARKS not in d]
    copied = sum(spark.read.parquet(d).where("contenttext <> ''").count() for d in found)
    # Every document gives one result, for the articles that come first; ranges without any are left alone.
    results = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert copied <= (0 if name != "s3_store_articles" else (results // 64 + 1) * 64) < spark.read.parquet(f"{FOLDER}/orders.parquet").count()
