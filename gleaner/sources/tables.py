"""Stored pages and state tables in and out.

State tables are immutable snapshots: a job reads one and writes the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.schemas import KEYS, SCHEMAS, defaults
from gleaner.session import BODY_FILES


def conform(df: DataFrame, table: str) -> DataFrame:
    """Give a frame the columns, types and non-null defaults of a state table."""
    fill, have = defaults(table), set(df.columns)
    return df.select(
        *[
            (
                F.coalesce(F.col(f"`{field.name}`").cast(field.dataType), F.lit(fill[field.name]).cast(field.dataType))
                if field.name in have
                else F.lit(fill[field.name]).cast(field.dataType)
            ).alias(field.name)
            for field in SCHEMAS[table].fields
        ]
    )


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Already fetched pages: url, body, connect error, duration, fetch time."""
    filled = {name: value for name, value in defaults("raw_pages").items() if name != "url"}
    return spark.read.schema(SCHEMAS["raw_pages"]).parquet(path).na.fill(filled)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One state table of a snapshot folder, with its fixed schema.

    Written by ``write_table`` it holds no NULL, and nothing is put around its
    columns here: filters on keys, status and flags reach the scan.
    """
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


def read_foreign_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A state table written by others: missing columns and NULLs take their defaults."""
    return conform(spark.read.parquet(path), table)


def write_table(df: DataFrame, folder: str, table: str) -> None:
    """Write one state table into the next snapshot folder; refuses to overwrite.

    Files are sorted by key, so a filter on a few keys skips row groups and
    pages of the wide columns.
    """
    rows = conform(df, table).sortWithinPartitions(KEYS[table])
    rows.write.mode("errorifexists").parquet(f"{folder}/{table}", **BODY_FILES)


def write_paged_by_site(pages: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write fetched pages (with ``sid``) as a catalog table in buckets of their site.

    Read from it, pages meet the rules of their sites without moving, whatever
    the rules weigh. A site is split over files of its bucket, not over buckets.
    """
    pages.write.mode("errorifexists").option("path", path).bucketBy(buckets, "sid").saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, path: str, table: str, buckets: int) -> None:
    """Write a state table as a catalog table bucketed on its key.

    The commit jobs join the wide tables on their keys. Read from buckets, the
    wide side of such a join needs no shuffle.
    """
    key = KEYS[table]
    (
        conform(df, table)
        .write.mode("errorifexists")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(name)
    )
