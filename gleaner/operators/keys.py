"""Surrogate ids, equality of keys, and multiset and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gleaner.session import stored

# monotonically_increasing_id keeps the place within a partition in the low bits.
_PLACE_BITS = 33

# Collations that say which texts are one key: byte for byte, or without regard to case.
EXACT, ANY_CASE = "UTF8_BINARY", "UTF8_LCASE"


def reading_order(page: str, place: Column) -> Column:
    """Page and place on it as one number.

    Aggregates over a plain number stay in the hash aggregate with its
    map-side partial results; a struct would force a sort of all rows.
    """
    return F.col(page).cast("decimal(38,0)") * (1 << 32) + place


def number_rows(rows: DataFrame, order: list[Column], name: str, after: Column | int = 0) -> DataFrame:
    """Number rows 1, 2, 3 ... in an order, on top of ``after``.

    ``order`` must tell all rows apart, so range partitions come out even. The
    sorted rows are written once with their partition and place (narrow rows
    only, please); a second pass counts them per partition and adds up the
    partitions before. No task ever holds more than its range, and the join
    brings one row per partition.
    """
    sorted_rows = rows.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    saved = stored(sorted_rows)
    part = F.shiftright("_slot", _PLACE_BITS)
    place = F.col("_slot").bitwiseAND((1 << _PLACE_BITS) - 1)
    # One row per partition: this window runs over a few thousand rows at most.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        saved.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    start = after if isinstance(after, Column) else F.lit(after)
    return (
        saved.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*rows.columns, (start + F.col("_start") + place + 1).cast("bigint").alias(name))
    )


def new_ids(rows: DataFrame, table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Give new rows ids above all ids of a table, ascending in an order."""
    highest = table.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    return number_rows(rows, order, key, highest)


def collated(rows: DataFrame, on: list[str], equality: str) -> list[Column]:
    """Key columns of ``rows``, texts under a collation."""
    texts = {f.name for f in rows.schema if isinstance(f.dataType, T.StringType)}
    return [F.collate(F.col(c), equality).alias(c) if c in texts else F.col(c) for c in on]


def first_spellings(first: DataFrame, on: list[str], order: str, equality: str = EXACT) -> DataFrame:
    """One row per key under an equality, as spelled where ``order`` is least (then the least spelling).

    ``first`` holds ``on`` and ``order``, each spelling once. Grouping by a collated text is a sort, so
    rows are to be put together by their exact spelling before, in a hash aggregate: what is sorted
    here is one row per spelling, however often each occurs.
    """
    if equality == EXACT:
        return first
    spelled = F.struct(order, *[F.col(c) for c in on])
    same = [c.alias(f"_same{k}") for k, c in enumerate(collated(first, on, equality))]
    return first.groupBy(*same).agg(F.min(spelled).alias("_first")).select("_first.*")


def without_known(rows: DataFrame, table: DataFrame, on: list[str], equality: str = EXACT) -> DataFrame:
    """Rows whose key under an equality ``table`` does not have; collated keys are joined by their sort keys."""
    if equality == EXACT:
        return rows.join(table.select(*on), on, "left_anti")
    names = [f"_same{k}" for k in range(len(on))]
    keyed = rows.select(*rows.columns, *[c.alias(n) for n, c in zip(names, collated(rows, on, equality), strict=True)])
    known = table.select(*[c.alias(n) for n, c in zip(names, collated(table, on, equality), strict=True)])
    return keyed.join(known, names, "left_anti").select(*rows.columns)


def multiset_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` left after each row of ``old`` took away one equal row."""
    return new.exceptAll(old.select(*new.columns))


def split_by_presence(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``old`` with ``kept``: whether ``new`` has them too."""
    marks = new.select(*on).distinct().withColumn("_mark", F.lit(True))
    return old.join(marks, on, "left").withColumn("kept", F.col("_mark").isNotNull()).drop("_mark")
