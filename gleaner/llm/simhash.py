"""Near-duplicate documents by 64-bit fingerprints, found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.components import components
from gleaner.llm.rows import unpacked, whole
from gleaner.llm.text import flat, normal, text_blocks, words
from gleaner.session import stored

SEED = 42
# A segment value shared by more distinct fingerprints than this is resolved by midpoints instead of pairs.
CROWD = 64
_HALF = 32


def _fingerprints(table: pa.Table, shingle: int) -> np.ndarray:
    """Fingerprint of every text: bit k is set if it is in over half the shingle hashes."""
    data, offsets = flat(table.column("text"))
    lowered = data.copy()
    upper = (lowered >= 65) & (lowered <= 90)
    lowered[upper] += 32
    starts, ends, doc = words(lowered, offsets)
    data, _, starts, ends = normal(lowered, offsets, starts, ends, doc)
    counts = np.bincount(doc, minlength=table.num_rows)
    digest, text = xxhash.xxh64_intdigest, memoryview(data)
    prints = np.zeros(table.num_rows, np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    first = 0
    for row, count in enumerate(counts.tolist()):
        if count:
            begins = starts[first : first + max(1, count - shingle + 1)].tolist()
            finishes = ends[first + min(shingle, count) - 1 : first + count].tolist()
            hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begins, finishes, strict=True)), np.uint64, len(begins))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            prints[row] = powers[bits.sum(axis=0, dtype=np.int64) * 2 > len(begins)].sum(dtype=np.uint64)
        first += count
    return prints


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``row_key`` and ``print`` (the 64 bits as a signed number) of every document.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space,
    shingles are ``shingle`` words joined by a space, repeats included. A text
    of fewer words is one shingle; one without words, or a null text, has
    fingerprint 0. Every whole text is read, a block of documents at a time.
    ``row_key`` hashes id and text and finds the row again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            prints = pa.array(_fingerprints(table, shingle).view(np.int64))
            kept = [table.column(name).combine_chunks() for name in ("doc_id", "row_key")]
            yield pa.RecordBatch.from_arrays([*kept, prints], ["doc_id", "row_key", "print"])

    keyed = docs.select(F.col("doc_id").cast("bigint"), "text", _row_key())
    return keyed.mapInArrow(run, "doc_id bigint, row_key bigint, print bigint")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))).alias("row_key")


def _ball(value: Column, only_up: bool) -> Column:
    """A 32-bit value and its neighbours at one bit, or only those with one more bit set."""
    flips = F.transform(F.array([F.lit(1 << k) for k in range(_HALF)]), lambda bit: value.bitwiseXOR(bit.cast("bigint")))
    flips = F.filter(flips, lambda other: other > value) if only_up else flips
    return F.concat(F.array(value), flips)


def linked(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join every two distinct fingerprints (column ``print``) that differ in one or two bits.

    Multi-index hashing over the two halves of a fingerprint. Of two differing
    bits the high half holds at most one, or the low half none. So the table
    holds each fingerprint under both its halves; it is asked for the high half's
    ball of radius one (the pair's smaller high half asks, so each pair meets
    once) and for the low half itself. Full distances are checked in the join.

    A half that over ``CROWD`` distinct fingerprints share would compare them
    pairwise. They, and all that ask for that half, are instead joined through
    the 65 points within one bit of each: two fingerprints differ in at most two bits
    exactly if they share such a point, so every one is linked to the smallest that
    shares a point with it. That costs 65 rows each, at any size of the crowd, and
    is exact; links between members of a crowd are then given up to connection.
    """
    prints = prints.select(F.col("print").alias("a")).distinct()
    high = F.shiftrightunsigned("a", _HALF)
    low = F.col("a").bitwiseAND((1 << _HALF) - 1)
    table = stored(
        prints.select("a", F.explode(F.array(F.struct(F.lit(0).alias("half"), high.alias("key")), F.struct(F.lit(1).alias("half"), low.alias("key")))).alias("s")).select("a", "s.*")
    )
    crowds = stored(table.groupBy("half", "key").count().where(F.col("count") > CROWD).select("half", "key", F.lit(True).alias("crowd")))
    asked = (
        table.select(
            "a",
            "half",
            F.explode(F.when(F.col("half") == 0, _ball(F.col("key"), True)).otherwise(F.array("key"))).alias("key"),
        )
        .join(crowds, ["half", "key"], "left")
        .withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    )
    calm = asked.where("NOT crowd").drop("crowd")
    other = table.join(crowds, ["half", "key"], "left_anti").withColumnRenamed("a", "b")
    pairs = calm.join(other, ["half", "key"]).where("a <> b AND bit_count(a ^ b) <= 2").select("a", "b")
    members = asked.where("crowd").select("a").union(table.join(crowds, ["half", "key"], "left_semi").select("a")).distinct()
    points = stored(
        members.select("a", F.explode(F.concat(F.array("a"), F.transform(F.array([F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)]), lambda bit: F.col("a").bitwiseXOR(bit)))).alias("point"))
    )
    least = points.groupBy("point").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b <> top").drop("top")
    through = points.join(least, "point").where("a <> b").select("a", "b")
    return pairs.union(through).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``row_key``, ``print``, ``root`` and ``component_id`` of every document.

    Documents whose fingerprints differ in at most two bits are linked, also
    over others; ``component_id`` is the smallest ``doc_id`` so reachable.
    Copies meet in their fingerprint first, so a group of any size is one row in
    the search. Null and empty texts share fingerprint 0 and are linked like any
    other. Rows with a null ``doc_id`` take part and get the component's
    smallest id, null if it has none. Repeated rows stay. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = stored(fingerprints(docs, shingle))
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(linked(prints), "a", "b")
    classes = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    classes = stored(classes)
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(ids, "root").select("print", "root", "component_id"), "print")


def first_of_each_group(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents that stay when one of each group of near-duplicates does: that with the smallest id.

    All columns of ``docs`` are kept. A null id comes after all others; equal ids
    are settled by a hash of the text; of rows with equal id and text one stays, and
    they meet within each task before they move. An empty table gives an empty result.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    kept = near_duplicates(docs, shingle).groupBy("root").agg(first).select(*_found("first.doc_id", F.col("first.row_key")))
    # Columns of the same name in the documents stay apart from the key.
    keyed = docs.select(whole(docs), *_found("doc_id", _row_key())).dropDuplicates(_FOUND)
    return unpacked(keyed.join(kept, _FOUND, "left_semi"), docs)


_FOUND = ["_id", "_none", "_key"]


def _found(doc_id: str, key: Column) -> list[Column]:
    """What finds a row again: its id, never null, whether it was, and its key."""
    own = F.col(doc_id).cast("bigint")
    return [F.coalesce(own, F.lit(0).cast("bigint")).alias("_id"), own.isNull().alias("_none"), key.alias("_key")]
