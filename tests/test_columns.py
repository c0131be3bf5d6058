"""Scalar columns on hand-written values."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import columns, urls


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_dates(spark):
    for text, seconds in [("2016-05-11", 1462924800), ("2016-5-1", 1462060800), ("2016-13-01", 0), ("x", 0), ("", 0), ("2200-01-01", 7258118400 - (2 << 32)), ("2040-01-01", 2208988800 - (1 << 32))]:
        assert one(spark, columns.to_epoch(F.lit(text))) == seconds
    assert one(spark, columns.to_epoch(F.lit("20160511"), "yyyyMMdd")) == 1462924800
    assert one(spark, columns.from_epoch(F.lit(1462924801))) == "2016-05-11 00:00:01"
    assert one(spark, columns.from_epoch(F.lit(None).cast("int"))) == ""


def test_text_values(spark):
    assert one(spark, columns.md5_hex(F.lit("a"))) == "0CC175B9C0F1B6A831C399E269772661"
    document = F.lit('{"a":" x ","b":{"c":1},"d":2,"n":null}')
    assert [one(spark, columns.json_text(document, key)) for key in "abdzn"] == ["x", '{"c":1}', "2", "", "null"]
    numbers = [("12", 12), ("-3", -3), ("+4", 4), ("1.5", 9), (" 1", 9), ("", 9), ("99999999999", 9)]
    for text, number in numbers:
        assert one(spark, columns.to_int(F.lit(text), 9)) == number


def test_status(spark):
    cases = {("x", "x", "x"): 4, ("", "x", "x"): 3, ("", "", "x"): 4, ("", "", ""): 2}
    for errors, status in cases.items():
        assert one(spark, columns.result_status(*map(F.lit, errors))) == status


def test_presentation(spark):
    assert one(spark, columns.excerpt(F.lit("ab" * 150))) == "ab" * 100
    image = [F.lit("u"), F.lit("p/"), F.lit("f")]
    assert one(spark, columns.title_image(F.lit(0), *image)) == "u"
    assert one(spark, columns.title_image(F.lit(1), *image)) == "p/f"
    assert one(spark, columns.title_image(F.lit(1), *[F.lit(None).cast("string")] * 3)) == ""
    assert one(spark, columns.counts_caption(F.lit("7"), F.lit("2"))) == "阅读: 7, 点赞: 2"
    assert columns.page_arguments(0, -1) == (1, 10) and columns.page_arguments(3, 5) == (3, 5)
    assert one(spark, columns.upload_path(F.lit(3), 1462924800)) == "upload/3/201605/11/"


def test_json_links(spark):
    page = F.lit("http://h/a/b/c.json")
    root, folder = urls.site_root(page), urls.folder_url(page)
    for link, absolute in [("/x", "http://h/x"), ("y", "http://h/a/b/y"), ("https://z/1", "https://z/1")]:
        assert one(spark, urls.resolve_json_link(F.lit(link), root, folder)) == absolute
    assert one(spark, urls.fill_template(F.lit("http://h/p/<id>"), F.lit("7"))) == "http://h/p/7"
