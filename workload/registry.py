"""Registration of a query next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import prepare
from gleaner.sources.tables import conform
from workload.standins import given, sql, standin, with_standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
TEXTS: dict[str, str] = {}  # the checks as written, over stand-ins


class Tables:
    """The stand-in tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return standin(self.spark, self.folder, f"v_{name}")

    def given(self, name: str) -> DataFrame:
        """One of the given tables."""
        return given(self.spark, self.folder, name)

    def sql(self, text: str) -> DataFrame:
        """A query over given tables and stand-ins."""
        return sql(self.spark, self.folder, text)

    def state(self, name: str) -> DataFrame:
        """A state table with its full schema."""
        return conform(getattr(self, name), name)


def query(name: str, check: str | None = None):
    """Register ``function(tables)`` under a name, with its DuckDB check if SQL can express one."""

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(prepare(spark), folder))

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if check:
            CHECKS[name], TEXTS[name] = with_standins(check), check
        return function

    return register
