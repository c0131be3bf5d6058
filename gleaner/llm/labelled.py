"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_GRAINS = 1 << 30


def fold(parts: int) -> Column:
    """Remainder of crc32 of the id's digits; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(0))


def bounded(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows of distinct ids, all if there are fewer, chosen by a hash of the id.

    The share to keep follows from a count, so no task gathers candidates; what
    is kept exceeds the bound by chance only, by about its square root.
    """
    total = rows.count()
    if total <= bound:
        return rows
    grain = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(_GRAINS))
    return rows.where(grain < int(bound / total * _GRAINS))


def labelled(labels: DataFrame, held_out: Column, bound: int, label: str = "quality") -> DataFrame:
    """``doc_id`` and 0/1 ``label`` to learn from.

    Rows with a null id or another label take no part; of several labels of one
    document the lowest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out)
    return bounded(known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")), bound)


def one_each(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key, with the least ``value``: however many rows an id has, it counts once.

    Partial minima are taken before rows move, so a task sends one row per key and
    what is collected is bounded by the number of keys.
    """
    return rows.groupBy(*keys).agg(F.min(value).alias(value))
