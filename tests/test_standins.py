"""Stand-in tables move only what a query needs of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from gleaner.session import shared_dir
from workload import standins

FOLDER = "/root/testdata/sf0.001"
WIDE = [
    "a2_images_complete", "a3_without_body_images", "f3_due_account_articles", "f3_due_articles", "f4_due_images", "f6_visible_articles", "f10_title_images",
    "f11_page_arguments", "j1_articles_with_site", "j2_articles_with_title_image", "j3_optional_site", "q2_content_count", "t2_next_article", "t3_next_image", "t5_article_page",
    "t6_index_batch", "x10_reader_bodies",
]


@pytest.mark.parametrize("name", WIDE)
def test_no_copy_of_articles_or_images_is_written(spark, name):
    spark._standins = (FOLDER, {})
    folder = f"{shared_dir(spark)}/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    contract.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    written = set(os.listdir(folder)) - before if os.path.isdir(folder) else set()  # texts of documents stay where they are
    columns = {column for path in written for column in spark.read.parquet(f"{folder}/{path}").columns}
    assert not columns & {"contenttext", "contentabsurl", "urlabs"}


def test_written_standins_have_more_files_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(standins, "FILE_ROWS", 10)
    spark._standins = (FOLDER, {})
    try:
        rows = standins.standin(spark, FOLDER, "v_items")
        assert len(rows.inputFiles()) > standins.FILES
    finally:
        spark._standins = (FOLDER, {})


def test_arriving_pages_come_in_more_files_as_they_grow(spark, monkeypatch):
    from workload import stores

    seen = []
    monkeypatch.setattr(stores, "PAGE_ROWS", 5)
    monkeypatch.setattr(stores, "_arriving", lambda t, rows, files=4, per_batch=2: seen.append((files, per_batch)) or rows)
    def stop(*_):
        raise InterruptedError

    monkeypatch.setattr(stores.streams, "article_batches", stop)
    monkeypatch.setattr(stores.increments, "start", lambda *a: 0)
    with pytest.raises(InterruptedError):
        contract.queries()["st1_failed_pages"](spark, FOLDER)
    ((files, per_batch),) = seen
    assert files == 2 * per_batch and files > 4
