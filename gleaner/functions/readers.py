"""How page readers run on Spark."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T


def page_reader(result: T.DataType):
    """A scalar Pandas UDF that reads each page once.

    It is declared non-deterministic for the optimizer's sake: a filter it
    infers for an exploded result would else be moved below the reader with a
    second call in it, and every page would be parsed twice.
    """

    def declare(function):
        return F.pandas_udf(function, result).asNondeterministic()

    return declare
