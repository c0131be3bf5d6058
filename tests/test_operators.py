"""Joins, keys, tags, roll-ups and rankings on hand-written rows."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gleaner.operators import audit, keys, links, rollup, select, tags
from gleaner.sources.tables import conform, read_foreign_table, read_table, write_bucketed, write_table


def state(spark, table, rows, columns):
    return conform(spark.createDataFrame(rows, columns), table)


def empty(spark, table):
    from gleaner.schemas import SCHEMAS

    return spark.createDataFrame([], SCHEMAS[table])


def link_rows(spark, *pages):
    rows = [(page, place, 1, 1, url) for page, found in enumerate(pages) for place, url in enumerate(found)]
    return spark.createDataFrame(rows, "page bigint, pos int, luid bigint, sid bigint, url string")


def test_new_links(spark):
    stored = state(spark, "contenturls", [(7, "b")], "cuid bigint, url string")
    found = link_rows(spark, ["a", "b", "a"])
    new = links.insert_links(found, stored, 5)
    assert [(row.cuid, row.url, row.dateline) for row in new.collect()] == [(8, "a", 5)]
    again = links.insert_links(found, stored.unionByName(new), 5)
    assert again.count() == 0


def test_ids_follow_the_page_backwards(spark):
    new = links.insert_links(link_rows(spark, ["a", "b", "c"], ["d", "c"]), empty(spark, "contenturls"), 5)
    assert [row.url for row in new.orderBy("cuid").collect()] == ["c", "b", "a", "d"]


def test_account_items_are_unique_by_site_and_title(spark):
    rows = [(1, 0, 1, "t", "u"), (1, 1, 1, "t", "v"), (2, 0, 2, "t", "w"), (2, 1, 2, "old", "x")]
    items = spark.createDataFrame(rows, "page bigint, pos int, sid bigint, title string, url string")
    stored = state(spark, "contenturls", [(1, 2, "old"), (2, 1, "other")], "cuid bigint, sid bigint, title string")
    new = links.insert_account_items(items.withColumn("postdate", F.lit("")), stored, 5)
    assert sorted((row.sid, row.title, row.url) for row in new.collect()) == [(1, "t", "v"), (2, "t", "w")]


def test_addresses_in_any_case(spark):
    stored = state(spark, "contenturls", [(7, "HTTP://a/B")], "cuid bigint, url string")
    found = link_rows(spark, ["http://A/b", "x/Σας", "É", "x/ΣΑΣ"], ["X/σασ", "é", "e", ""], [None, None])
    new = links.insert_links(found, stored, 5, keys.ANY_CASE)
    # A null address is no address: as in the exact job it meets nothing and is left out.
    assert [r.url for r in new.orderBy("cuid").collect()] == ["x/ΣΑΣ", "É", "", "e"]
    assert new.schema == links.insert_links(found, stored, 5).schema
    assert links.insert_links(found, stored.unionByName(new), 5, keys.ANY_CASE).count() == 0
    assert links.insert_links(found.limit(0), stored, 5, keys.ANY_CASE).count() == 0
    assert links.insert_links(found, stored, 5).where("url IS NOT NULL").count() == 8


def test_titles_in_any_case(spark):
    rows = [(1, 0, 1, "T", "u"), (1, 1, 1, "t", "v"), (2, 0, 2, "t", "w"), (2, 1, 2, "Old", "x")]
    items = spark.createDataFrame([(*r, "") for r in rows], "page bigint, pos int, sid bigint, title string, url string, postdate string")
    stored = state(spark, "contenturls", [(1, 2, "oLD"), (2, 1, "other")], "cuid bigint, sid bigint, title string")
    new = links.insert_account_items(items, stored, 5, keys.ANY_CASE)
    assert sorted((row.sid, row.title, row.url) for row in new.collect()) == [(1, "t", "v"), (2, "t", "w")]


def test_tags_in_any_case(spark):
    articles = spark.createDataFrame([(1, "Red,red,blue"), (2, "RED,Green"), (3, None), (4, "green,BLUE,blue")], "cuid bigint, tag string")
    known = spark.createDataFrame([(5, "Blue"), (6, "blue")], "tid bigint, tagname string")
    names = tags.upsert_tags(articles, known, keys.ANY_CASE)
    assert sorted(map(tuple, names.collect())) == [(5, "Blue"), (6, "blue"), (7, "Red"), (8, "Green")]
    bridge = tags.upsert_bridge(articles, names, spark.createDataFrame([(3, 5, 1)], "ctid bigint, tid bigint, cuid bigint"), keys.ANY_CASE)
    assert sorted(map(tuple, bridge.collect())) == [(3, 5, 1), (4, 7, 1), (5, 7, 2), (6, 8, 2), (7, 8, 4), (8, 5, 4)]
    assert sorted(map(tuple, tags.upsert_bridge(articles, names, bridge, keys.ANY_CASE).collect())) == sorted(map(tuple, bridge.collect()))
    assert tags.upsert_tags(articles, names, keys.ANY_CASE).count() == 4


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aAkKſsSßİiıσςΣé\u212a", max_size=3), min_size=1, max_size=12))
def test_equal_texts_have_one_fold(spark, texts):
    """What the collation holds equal, the index of known keys hashes alike."""
    frame = spark.createDataFrame([(t,) for t in texts], "key string")
    folded = frame.select(F.collate("key", keys.ANY_CASE).alias("same"), F.upper(F.lower("key")).alias("fold"))
    assert folded.groupBy("same").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-50, 50)), unique=True, min_size=1, max_size=40))
def test_numbering_is_dense_and_ordered(spark, pairs):
    rows = spark.createDataFrame(pairs, "a int, b int")
    numbered = keys.number_rows(rows, [F.col("a"), F.desc("b")], "n", 100).collect()
    expected = sorted(pairs, key=lambda pair: (pair[0], -pair[1]))
    assert {(row.a, row.b): row.n for row in numbered} == {pair: 101 + i for i, pair in enumerate(expected)}


def test_numbering_over_many_partitions(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("k"), "id")
    numbered = keys.number_rows(rows, [F.col("k")], "n").agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(numbered) == (20000, 1, 20000)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_multiset_difference(spark, new, old):
    frame = lambda values: spark.createDataFrame([(value,) for value in values], "v string")
    left = Counter(row.v for row in keys.multiset_difference(frame(new), frame(old)).collect())
    assert left == Counter(new) - Counter(old)


def test_reconciliation(spark):
    rule = json.dumps({"url": "http://a/<num>", "numfirst": 1, "numlast": 2})
    countdown = json.dumps({"url": "http://a/<num>", "numfirst": 2, "numlast": 1})
    sites = state(
        spark, "sites", [(1, rule, 0, 1), (2, rule, 1, 1), (3, countdown, 0, 1), (4, rule, 0, 0)], "sid bigint, urlformat string, listcreated int, isenable int"
    )
    stored = state(
        spark,
        "listurls",
        [(1, 1, "http://a/2", 0, 1), (2, 1, "u3", 1, 0), (3, 2, "u3", 1, 1), (4, 3, "u3", 1, 1), (5, 1, "http://a/2", 1, 0)],
        "luid bigint, sid bigint, listurl string, isenable int, isfirst int",
    )
    after = audit.reconcile_listurls(sites, stored, 9)
    rows = sorted((row.luid, row.sid, row.listurl, row.isenable, row.isfirst) for row in after.collect())
    assert rows == [
        (1, 1, "http://a/2", 0, 0), (2, 1, "u3", 0, 0), (3, 2, "u3", 1, 1), (4, 3, "u3", 1, 1), (5, 1, "http://a/2", 1, 0),
        (6, 1, "http://a/1", 1, 1), (7, 4, "http://a/1", 0, 1), (8, 4, "http://a/2", 0, 0),
    ]


def test_entry_page_equal_to_a_generated_one_is_inserted_twice(spark):
    rule = json.dumps({"url": "http://a/<num>", "numfirst": 1, "numlast": 2})
    sites = state(spark, "sites", [(1, rule, "http://a/1")], "sid bigint, urlformat string, entryurl string")
    stored = state(spark, "listurls", [(1, 1, "http://a/1")], "luid bigint, sid bigint, listurl string")
    after = audit.reconcile_listurls(sites, stored, 9).orderBy("luid").collect()
    assert [(row.luid, row.listurl, row.isfirst) for row in after] == [(1, "http://a/1", 1), (2, "http://a/1", 1), (3, "http://a/2", 0)]


def test_tags(spark):
    articles = spark.createDataFrame([(1, "a,,b,,"), (2, ",b"), (3, " "), (4, ",,"), (5, "b,b, a")], "cuid bigint, tag string")
    names = tags.upsert_tags(articles, spark.createDataFrame([(5, "a")], "tid bigint, tagname string"))
    assert {(row.tid, row.tagname) for row in names.collect()} == {(5, "a"), (6, ""), (7, "b"), (8, " a")}
    bridge = tags.upsert_bridge(articles, names, spark.createDataFrame([(3, 5, 1)], "ctid bigint, tid bigint, cuid bigint"))
    rows = sorted((row.ctid, row.tid, row.cuid) for row in bridge.collect())
    assert rows == [(3, 5, 1), (4, 6, 1), (5, 7, 1), (6, 6, 2), (7, 7, 2), (8, 7, 5), (9, 8, 5)]
    again = tags.upsert_bridge(articles, names, bridge)
    assert again.count() == bridge.count()
    texts = {row.cuid: row.tags for row in tags.tag_strings(bridge, names).collect()}
    assert texts == {1: "a,,b", 2: ",b", 5: "b, a"}


def test_completeness(spark):
    images = spark.createDataFrame([(1, 2), (1, 3), (2, 2), (2, 0), (3, 1), (4, 0)], "cuid bigint, status int")
    complete = rollup.images_complete(images, images.filter("status <> 0"))
    assert sorted(row.cuid for row in complete.collect()) == [1, 3]
    manifest = spark.createDataFrame([(1,), (1,)], "cuid bigint")
    flags = rollup.without_body_images(spark.createDataFrame([(1,), (2,)], "cuid bigint"), manifest)
    assert {row.cuid: row.imagefinish for row in flags.collect()} == {1: 0, 2: 1}


def test_counters_rise_with_failed_attempts(spark):
    listurls = state(spark, "listurls", [(1, 3, 4), (2, 0, 0)], "luid bigint, connectcount int, parsecount int")
    results = spark.createDataFrame([(1, 1), (2, 1)], "attempt bigint, luid bigint")
    counted = rollup.add_attempts(listurls, rollup.attempts(results, "luid")).collect()
    assert {(row.luid, row.connectcount, row.parsecount) for row in counted} == {(1, 5, 6), (2, 0, 0)}


@pytest.mark.parametrize("last, order", [(3, [5, 1, 3]), (5, [1, 3, 5]), (0, [1, 3, 5])])
def test_turns(spark, last, order):
    sites = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (5, 1, 0)], "sid bigint, isenable int, isweixin int")
    turns = {row.turn: row.sid for row in select.cyclic_order(sites, last).collect()}
    assert [turns[place] for place in (1, 2, 3)] == order
    assert select.next_site(sites, last).first().sid == order[0]


def test_due_list_pages(spark):
    sites = state(spark, "sites", [(1, 100, 20, 3600), (2, 5000, 20, 3600)], "sid bigint, lastfetch int, interval int, schedule int")
    rows = [(1, 1, 1, 0, 0), (2, 1, 1, 0, 0), (3, 1, 0, 0, 0), (4, 1, 1, 2, 1), (5, 1, 1, 2, 0), (6, 1, 1, 4, 1), (7, 2, 1, 2, 1), (8, 2, 1, 0, 0)]
    listurls = state(spark, "listurls", rows, "luid bigint, sid bigint, isenable int, status int, isfirst int")

    def due(now):
        found = select.due_list_pages(listurls, sites, now)
        best = {row.sid: row.luid for row in select.next_list_page(listurls, sites, now).collect()}
        ids = {}
        for row in found.collect():
            ids.setdefault(row.sid, []).append(row.luid)
        assert best == {sid: max(luids) for sid, luids in ids.items()}
        return sorted(luid for luids in ids.values() for luid in luids)

    assert due(120) == [] and due(121) == [1, 2] and due(3701) == [1, 2, 4] and due(9000) == [1, 2, 4, 7, 8]


def test_reset(spark):
    rows = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (4, 1)], "status int, indexfinish int")
    assert [tuple(row) for row in select.reset_in_flight(rows).collect()] == [(0, 0), (0, 2), (2, 0), (4, 0)]


def test_snapshots(spark, tmp_path):
    write_table(spark.createDataFrame([(1, "a")], "tid int, tagname string"), str(tmp_path), "articletags")
    assert [tuple(row) for row in read_table(spark, str(tmp_path), "articletags").collect()] == [(1, "a")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_table(spark.createDataFrame([(1, "a")], "tid int, tagname string"), str(tmp_path), "articletags")


def test_foreign_tables_are_completed(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "a")], "tid int, tagname string").write.parquet(str(tmp_path / "t"))
    rows = read_foreign_table(spark, str(tmp_path / "t"), "articletags").collect()
    assert sorted(tuple(row) for row in rows) == [(1, ""), (2, "a")]


def test_missing_values_take_their_defaults(spark):
    row = conform(spark.createDataFrame([(1, None)], "sid int, schedule int"), "sites").first()
    assert (row.sid, row.interval, row.schedule, row.sitename, row.islocal) == (1, 20, 3600, "", 0)


def test_a_bucketed_table_is_updated_without_shuffling_it(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("cuid"), F.lit("x").alias("contenttext"))
    write_bucketed(rows, "bucketed_articles", str(tmp_path / "t"), "contenturls", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        complete = spark.range(500).select(F.col("id").alias("cuid"))
        marked = rollup.mark_complete(spark.table("bucketed_articles"), complete)
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and marked.agg(F.sum("imagefinish")).first()[0] == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_articles")
