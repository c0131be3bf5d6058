"""Snapshots that share files: what a commit writes, reads and moves."""

from __future__ import annotations

import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gleaner.operators import keys
from gleaner.operators.links import unseen_links
from gleaner.operators.membership import Membership
from gleaner.operators.select import visible_articles
from gleaner.plans import commit as whole, increments, queries
from gleaner.schemas import SCHEMAS
from gleaner.sources import store as module
from gleaner.sources.store import Commit, Store, compact
from gleaner.sources.tables import conform

SMALL = dict(urls=Membership("urls", 4, 16), titles=Membership("titles", 4, 16))


def article_rows(spark, count: int = 100):
    return spark.range(1, count + 1).select(
        F.col("id").alias("cuid"), (F.col("id") % 3 + 1).alias("sid"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("t"), "id").alias("title"),
        F.concat(F.lit("body"), "id").alias("contenttext"), F.when(F.col("id") % 4 > 0, 2).otherwise(0).alias("status"), (F.col("id") % 2).cast("int").alias("imagefinish"),
    )


def tables(spark, count: int = 100):
    sites = spark.range(1, 4).select(F.col("id").alias("sid"), F.lit(1).alias("isenable"), (F.col("id") == 2).cast("int").alias("islocal"), F.lit("s").alias("sitename"))
    images = spark.range(1, 2 * count + 1).select(F.col("id").alias("imgid"), F.ceil(F.col("id") / 2).alias("cuid"), F.lit(0).alias("status"))
    lists = spark.range(1, 30).select(F.col("id").alias("luid"), (F.col("id") % 3 + 1).alias("sid"), F.lit("page").alias("source"))
    return {"contenturls": article_rows(spark, count), "sites": sites, "images": images, "listurls": lists, "articletags": spark.createDataFrame([], SCHEMAS["articletags"]), "contenttags": spark.createDataFrame([], SCHEMAS["contenttags"])}


@pytest.fixture
def started(spark, tmp_path):
    store = increments.collection(spark, str(tmp_path / "store"), 4, **SMALL)
    return store, increments.start(store, tables(spark))


def image_results(spark, ids):
    return spark.createDataFrame([(k, k, 9, 1, "", 50) for k in ids], "attempt bigint, imgid bigint, size bigint, duration int, connecterror string, fetched_at int")


def list_results(spark, links, luid=1, sid=1):
    row = (1, luid, sid, "a page", links, 1, "", "", "", 60)
    return spark.createDataFrame([row], "attempt bigint, luid bigint, sid bigint, source string, links array<string>, duration int, joberror string, connecterror string, parseerror string, fetched_at int")


def recounted(store, number):
    rows = visible_articles(store.read(number, "contenturls"), store.read(number, "sites"))
    return {r.cuid >> 4: r["count"] for r in rows.groupBy(F.shiftleft(F.shiftright("cuid", 4), 4).alias("cuid")).count().collect()}


def counted(store, number):
    return {r.part: r.rows for r in increments._visible_counts(store, number).where("rows > 0").collect()}


def test_a_commit_leaves_other_buckets_alone(spark, started):
    store, first = started
    before = store.manifest(first)
    text = {r.cuid: r.contenttext for r in store.read(first, "contenturls").collect()}
    # Images 5 and 6 belong to article 3, in its first range.
    second = increments.commit_images(store, first, image_results(spark, [5, 6, 9]))
    after = store.manifest(second)
    assert {b for b in after["images"] if after["images"][b] != before["images"][b]} == {0}
    assert {b for b in after["contenturls"] if after["contenturls"][b] != before["contenturls"][b]} == {0}
    for table in ("sites", "listurls", "urls_keys", "urls_bits"):
        assert after[table] == before[table]
    # Both snapshots are whole.
    assert {r.cuid: r.contenttext for r in store.read(second, "contenturls").collect()} == text
    done = {r.cuid for r in store.read(second, "contenturls").where("imagefinish = 1").collect()}
    assert done == {r.cuid for r in store.read(first, "contenturls").where("imagefinish = 1").collect()} | {3}
    assert store.read(first, "images").where("status = 2").count() == 0 and store.read(second, "images").where("status = 2").count() == 3
    assert store.latest() == second


@pytest.mark.parametrize("batch", [7, 10**6])
def test_groups_of_any_size_give_what_whole_tables_give(spark, tmp_path, batch):
    store = increments.collection(spark, str(tmp_path / "store"), 4, **SMALL, batch=batch)
    first = increments.start(store, tables(spark))
    old = {name: conform(rows, name) for name, rows in tables(spark).items()}
    results = image_results(spark, [1, 2, 40, 41, 77, 199, 200, 500])
    second = increments.commit_images(store, first, results)
    expect = whole.commit_images(results, old["images"], old["contenturls"])
    for table in ("images", "contenturls"):
        assert sorted(map(tuple, store.read(second, table).collect())) == sorted(map(tuple, expect[table].select(*SCHEMAS[table].names).collect()))
    lists = list_results(spark, ["u1", "new", "u99", "new", "other"])
    third = increments.commit_lists(store, second, lists, 70)
    expect = whole.commit_lists(lists, old["sites"], old["listurls"], expect["contenturls"], 70)
    for table in ("sites", "listurls", "contenturls"):
        assert sorted(map(tuple, store.read(third, table).collect())) == sorted(map(tuple, expect[table].select(*SCHEMAS[table].names).collect()))


def wide_exchanges(frame) -> int:
    """Shuffles that carry a body column."""
    spark = frame.sparkSession
    text = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    return sum(any(re.search(rf"\b{name}#", given) for name in module.WIDE) for given in inputs)


def test_no_body_is_shuffled(spark, started, monkeypatch):
    store, first = started
    plans = []
    write = Commit._write

    def seen(self, rows, table):
        plans.append((table, wide_exchanges(rows)))
        return write(self, rows, table)

    monkeypatch.setattr(Commit, "_write", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        second = increments.commit_images(store, first, image_results(spark, range(1, 60)))
        increments.commit_lists(store, second, list_results(spark, ["u1", "new"]), 70)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {table for table, _ in plans} >= {"contenturls", "listurls", "images"}
    assert not any(count for _, count in plans)


def test_new_addresses_read_no_stored_one(spark, started, monkeypatch):
    store, first = started
    reads = []
    read = Commit.read

    def seen(self, table, buckets=None):
        reads.append((table, None if buckets is None else sorted(buckets)))
        return read(self, table, buckets)

    monkeypatch.setattr(Commit, "read", seen)
    second = increments.commit_lists(store, first, list_results(spark, [f"https://fresh.example.org/{k}" for k in range(5)]), 70)
    assert not [r for r in reads if r[0] == "urls_keys"]
    # Reading articles for new ids stays in the last range.
    assert all(buckets for table, buckets in reads if table == "contenturls")
    assert store.read(second, "contenturls").count() == 105
    reads.clear()
    third = increments.commit_lists(store, second, list_results(spark, ["https://fresh.example.org/3", "u7"]), 80)
    assert [len(b) for t, b in reads if t == "urls_keys"] in ([1], [2])
    assert store.read(third, "contenturls").count() == 105


@pytest.mark.parametrize("index", [Membership("urls", 2, 1), Membership("urls", 1, 1 << 12)])
def test_a_full_filter_still_answers_exactly(spark, tmp_path, index):
    store = increments.collection(spark, str(tmp_path / "store"), 8, urls=index, titles=SMALL["titles"])
    first = increments.start(store, {"contenturls": article_rows(spark, 3000)})
    if index.blocks == 1:
        bits = store.read(first, "urls_bits").collect()
        assert all(value == -1 for r in bits for value in r[1:])
    links = spark.createDataFrame([(k % 7, k, 1, 1, f"u{k}") for k in range(2900, 3200)] * 2, "page bigint, pos int, luid bigint, sid bigint, url string")
    got = increments.new_links(store.begin(first), links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, unseen_links(links, article_rows(spark, 3000), ["url"]).collect()))
    assert {r.url for r in got.collect()} == {f"u{k}" for k in range(3001, 3200)}


@pytest.mark.parametrize("blocks", [1, 1 << 12])
def test_the_index_in_any_case(spark, tmp_path, blocks):
    store = increments.collection(spark, str(tmp_path / "store"), 8, Membership("urls", 2, blocks), SMALL["titles"], keys.ANY_CASE)
    stored = article_rows(spark, 300)
    first = increments.start(store, {"contenturls": stored})
    links = spark.createDataFrame([(k % 7, k, 1, 1, f"{'uU'[k % 2]}{k // 2}") for k in range(560, 660)], "page bigint, pos int, luid bigint, sid bigint, url string")
    got = increments.new_links(store.begin(first), links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, unseen_links(links, stored, ["url"], keys.ANY_CASE).collect()))
    after = increments.commit_links(store, first, links, 5)
    assert store.read(after, "contenturls").count() == 300 + got.count()
    assert increments.new_links(store.begin(after), links.withColumn("url", F.upper("url"))).count() == 0
    with pytest.raises(ValueError):
        increments.collection(spark, str(tmp_path / "other"), 8, equality="UNICODE_CI")


def test_a_page_reads_only_its_ranges(spark, started):
    store, first = started
    assert counted(store, first) == recounted(store, first)
    for sid, page, count in ((0, 1, 5), (0, 3, 7), (2, 2, 4), (0, 99, 10), (0, 0, 0)):
        expect = queries.content_list(store.read(first, "contenturls"), store.read(first, "sites"), store.read(first, "images"), sid, page, count)
        assert list(map(tuple, increments.content_list(store, first, sid, page, count).orderBy(F.desc("cuid")).collect())) == list(map(tuple, expect.orderBy(F.desc("cuid")).collect()))
        assert increments.content_count(store, first, sid).first()[0] == queries.content_count(store.read(first, "contenturls"), store.read(first, "sites"), sid).first()[0]
    parts, _ = increments.page_parts(store, first, 0, 3, 7)
    assert 0 < len(parts) <= 3
    folders = [f for p in parts for f in store.manifest(first)["contenturls"][p]]
    assert all(any(folder in name for folder in folders) for name in store.read(first, "contenturls", parts).inputFiles())


def test_counts_follow_every_commit(spark, started):
    store, first = started
    second = increments.commit_images(store, first, image_results(spark, range(1, 41)))
    assert counted(store, second) == recounted(store, second) != counted(store, first)
    third = increments.commit_lists(store, second, list_results(spark, ["a", "b", "c"]), 70)
    assert counted(store, third) == recounted(store, third)


def test_tables_with_bodies_are_packed_tightly(spark, tmp_path):
    from pyarrow import parquet

    from gleaner.sources.tables import write_table

    write_table(article_rows(spark), str(tmp_path / "snapshot"), "contenturls")
    store = Store(spark, str(tmp_path / "store"), bits=4)
    store.start({"contenturls": article_rows(spark)})
    for folder in ("snapshot", "store/files"):
        files = [*(tmp_path / folder).rglob("*.parquet")]
        found = [parquet.ParquetFile(f).metadata for f in files]
        assert files and {m.row_group(0).column(k).compression for m in found for k in range(m.num_columns)} == {"ZSTD"}


def test_the_second_of_two_commits_fails(spark, started):
    store, first = started
    one, two = store.begin(first), store.begin(first)
    one.append("articletags", spark.createDataFrame([(1, "a")], SCHEMAS["articletags"]))
    two.append("articletags", spark.createDataFrame([(1, "b")], SCHEMAS["articletags"]))
    second = one.finish()
    with pytest.raises(AnalysisException):
        two.finish()
    assert [r.tagname for r in store.read(second, "articletags").collect()] == ["a"]


def test_a_branch_shares_files_and_goes_its_own_way(spark, started, tmp_path):
    store, first = started
    other = store.branch(first, str(tmp_path / "other"))
    assert other.manifest(first) == store.manifest(first)
    second = increments.commit_images(other, first, image_results(spark, [1]))
    assert store.latest() == first and other.latest() == second


def test_crowded_buckets_are_put_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), bits=4)
    number = store.start({"articletags": spark.createDataFrame([], SCHEMAS["articletags"])})
    for k in range(5):
        commit = store.begin(number)
        commit.append("articletags", spark.createDataFrame([(k + 1, f"n{k}"), (100 + k, "far")], SCHEMAS["articletags"]))
        number = commit.finish()
    assert len(store.manifest(number)["articletags"][0]) == 5
    after = compact(store, number, "articletags", 2)
    assert all(len(folders) == 1 for folders in store.manifest(after)["articletags"].values())
    assert sorted(map(tuple, store.read(after, "articletags").collect())) == sorted(map(tuple, store.read(number, "articletags").collect()))


def test_parsed_rows_do_not_stay(spark, started, tmp_path):
    store, first = started
    rows = [(k, k % 50 + 1, 1, "http://h/", "src", '<p>x<img src="/i.png"></p>', f"T{k}", "w", "d", "a,b", "", 1, "", "", "", 9) for k in range(1, 61)]
    schema = "attempt bigint, cuid bigint, sid bigint, url string, source string, content string, title string, author string, postdate string, tag string, titleimage string, duration int, joberror string, connecterror string, parseerror string, fetched_at int"
    results = spark.createDataFrame(rows, schema)
    second = increments.commit_articles(store, first, results, 90)
    assert not list((tmp_path / "store" / "files").glob("*/staged"))
    old = {name: conform(frame, name) for name, frame in tables(spark).items()}
    expect = whole.commit_articles(results, *(old[n] for n in ("sites", "contenturls", "images", "articletags", "contenttags")), 90)
    for table, frame in expect.items():
        assert sorted(map(tuple, store.read(second, table).collect())) == sorted(map(tuple, frame.select(*SCHEMAS[table].names).collect()))
    assert counted(store, second) == recounted(store, second)


def test_flags_are_set_without_the_bodies(spark, started):
    store, first = started
    text = {r.cuid: r.contenttext for r in store.read(first, "contenturls").collect()}
    second = increments.commit_images(store, first, image_results(spark, [5, 6, 9, 10, 63, 64]))
    for bucket, folders in store.manifest(second)["contenturls"].items():
        # What was written holds no body, and the files with bodies are those of the first snapshot.
        assert folders[: 1] == store.manifest(first)["contenturls"][bucket]
        for folder in folders[1:]:
            assert not module.WIDE & set(spark.read.parquet(folder).columns)
    assert len(store.manifest(second)["contenturls"][0]) == 2
    # Marks are put in place of marks, rows added later stay beside them, and new bodies make the bucket whole again.
    third = increments.commit_images(store, second, image_results(spark, [7, 8, 199, 200]))
    fourth = increments.commit_lists(store, third, list_results(spark, ["new", "newer"]), 70)
    fifth = increments.commit_images(store, fourth, image_results(spark, [197, 198]))
    rows = {r.cuid: r for r in store.read(fifth, "contenturls").collect()}
    assert {key: row.contenttext for key, row in rows.items()} == {**text, 101: "", 102: ""}
    flagged = {key for key, row in rows.items() if row.imagefinish == 1}
    assert flagged == {r.cuid for r in store.read(first, "contenturls").where("imagefinish = 1").collect()} | {3, 4, 5, 32, 99, 100}
    assert counted(store, fifth) == recounted(store, fifth)
    columns = "attempt bigint, cuid bigint, source string, contenttext string, status int"
    commit = store.begin(fifth)
    commit.update("contenturls", spark.createDataFrame([(1, 4, "s", "a new body", 2)], columns), "attempt")
    sixth = commit.finish()
    rows = {r.cuid: r for r in store.read(sixth, "contenturls").collect()}
    assert (rows[4].contenttext, rows[4].imagefinish, rows[5].contenttext, rows[5].imagefinish) == ("a new body", 1, "body5", 1)
    assert len(rows) == 102 and len(store.manifest(sixth)["contenturls"][0]) == 1
    last = compact(store, sixth, "contenturls")
    assert not any(module._MARKS in f for folders in store.manifest(last)["contenturls"].values() for f in folders)
    assert sorted(map(tuple, store.read(last, "contenturls").collect())) == sorted(map(tuple, store.read(sixth, "contenturls").collect()))


def test_many_changes_are_one_job(spark, tmp_path, monkeypatch):
    store = increments.collection(spark, str(tmp_path / "store"), 4, **SMALL, batch=7)
    first = increments.start(store, tables(spark))
    writes = []
    write = Commit._write
    monkeypatch.setattr(Commit, "_write", lambda self, rows, table: writes.append(table) or write(self, rows, table))
    increments.commit_images(store, first, image_results(spark, range(1, 150)))
    assert writes.count("images") == writes.count("contenturls") == 1
