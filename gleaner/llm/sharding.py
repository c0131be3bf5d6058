"""Shards of bounded bytes by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.session import stored

SHARD_BYTES = 1 << 20
BITS = 60  # of the key's MD5; a directory entry is a prefix of them
_AHEAD = 4  # bits that a round looks beyond those an even spread would need
_SLICE_DOCS = 100_000  # documents of one key that share a slice of its overflow pages


def key_hash(key: str) -> Column:
    """The first 60 bits of the MD5 of the key's text; null as the empty text."""
    digits = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digits, 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(depth: Column | int) -> Column:
    return F.expr(f"shiftright(hash, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col("hash"), (F.lit(BITS) - depth).cast("int"))


_SUMS = {"shard_bytes": "sum(n_bytes)", "shard_docs": "count(*)", "least": "min(hash)", "most": "max(hash)"}
_OVER = {"shard_bytes": "sum(shard_bytes)", "shard_docs": "sum(shard_docs)", "least": "min(least)", "most": "max(most)"}


def _sums(exprs: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in exprs.items()]


def sharded(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``shard``, ``page``, ``shard_bytes``, ``shard_docs`` of every document.

    ``shard`` is the bits of the hash prefix that the shard's directory entry holds. A
    bucket over ``limit`` bytes is split on the next bit, no other is, so a shard is the
    shortest prefix that fits. Documents are summed once into cells of a few bits more than an
    even spread needs; prefixes are summed from the cells, not from documents. Only
    cells still over the limit are looked at again, some bits further on.

    A bucket of one hash cannot be split by bits. Its documents, if there are several
    and they exceed the limit, go to overflow ``page`` 0, 1, ... by running size (pages of a
    slice of the key's documents each, so a hot key is many tasks); a page fits the
    limit too. A single larger document has a shard or page of its own. Null and empty texts
    have no bytes; null keys are one key; repeated rows are documents of their own. An empty table
    gives an empty result; other columns are not read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = stored(docs.select(F.col("doc_id").cast("bigint"), key_hash(key).alias("hash"), size.alias("n_bytes"), F.xxhash64("text").alias("salt")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + _AHEAD)
    placed: DataFrame | None = None
    while True:
        cells = rows.groupBy(_prefix(high).alias("cell")).agg(*_sums(_SUMS))
        steps = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
        entries = steps.groupBy("depth", "prefix").agg(*_sums(_OVER)).withColumn("fits", F.expr(f"shard_bytes <= {limit} OR least = most"))
        # A shard is an entry that fits below one that does not: every entry meets its two halves only.
        above = entries.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("fits").alias("parent_fits"))
        leaves = entries.where("fits").withColumn("parent", F.shiftright("prefix", 1)).join(above, ["depth", "parent"], "left").where("parent_fits IS NULL OR NOT parent_fits")
        # It holds the directory's cells of its prefix.
        wide = (F.lit(high) - F.col("depth")).cast("int")
        first = F.call_function("shiftleft", F.col("prefix"), wide)
        held = F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("bigint"), wide) - 1)
        directory = stored(leaves.select(F.explode(held).alias("cell"), "depth", "prefix", "shard_bytes", "shard_docs"))
        here = rows.withColumn("cell", _prefix(high))
        settled = here.join(directory, "cell").drop("cell")
        placed = settled if placed is None else placed.union(settled)
        rest = stored(cells.select("cell").join(directory, "cell", "left_anti"))
        if high == BITS or rest.isEmpty():
            break
        rows = here.join(rest, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(BITS, high + 2 * _AHEAD)
    bits = F.expr("lpad(conv(CAST(prefix AS STRING), 10, 2), depth, '0')")
    placed = placed.withColumn("shard", bits)
    over = F.expr(f"shard_bytes > {limit} AND shard_docs > 1")
    fits = placed.where(~over).withColumn("page", F.lit(0).cast("bigint"))
    return fits.select("doc_id", "n_bytes", "shard", "page", "shard_bytes", "shard_docs").union(_paged(placed.where(over), limit))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    # Documents over half the limit stand alone; the others start a page at each half limit, so a page ends within the limit.
    slices = F.ceil(F.col("shard_docs") / _SLICE_DOCS)
    sliced = rows.withColumn("slice", F.pmod("salt", slices)).withColumn("large", F.expr(f"2 * n_bytes > {limit}"))
    order = Window.partitionBy("shard", "slice", "large").orderBy("doc_id", "n_bytes", "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(F.col("large"), F.count("*").over(order)).otherwise(F.floor(F.coalesce(F.sum("n_bytes").over(order), F.lit(0)) * 2 / limit))
    numbered = sliced.withColumn("place", before)
    pages = numbered.groupBy("shard", "slice", "large", "place").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    numbers = pages.withColumn("page", F.row_number().over(Window.partitionBy("shard").orderBy("slice", "large", "place")).cast("bigint") - 1)
    return numbered.drop("shard_bytes", "shard_docs").join(numbers, ["shard", "slice", "large", "place"]).select("doc_id", "n_bytes", "shard", "page", "shard_bytes", "shard_docs")
