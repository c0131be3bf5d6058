"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.rows import row_key, unpacked, whole
from gleaner.operators.keys import number_rows
from gleaner.session import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix over words of the input
MOST = 2.0  # times a document may be taken
BLOCK_UNITS = 2000  # documents that one flight passes over before its rest goes to the next level
MEET = 500  # blocks whose rests fly together at the next level
HELD = 48  # documents whose chances a flight moves together
LANDED = 12  # documents of a source that are settled together at its end
PORTION = 1000  # copies of one row that are made at once
_EXACT = 1e-9

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_rank``, ``source_docs``, ``source_size``, ``target`` of every source.

    ``sizes`` has a row per document with ``source`` and ``size``. Sources by code
    point, null last, have the weights in turn and share ``share`` of all sizes.
    A target stops at ``most`` times its source's size; what is above is shared again by
    weight among the others, until none is above. Each round of that brings two sums to the driver.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    ranked = number_rows(sources, [F.col("source").asc_nulls_last()], "source_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    table = stored(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, bound = 0.0, -1.0
    while level > bound:
        # Sources whose cap the level has passed hold their cap; the level rises for the others.
        bound = level
        full = F.col("weight") * bound >= F.col("cap")
        held, rest = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        level = max(bound, (total - held) / rest) if rest else bound
    return table.select("source", "source_rank", "source_docs", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


class Flight:
    """Settles the chances of units as they come; at most two keep a chance between 0 and 1.

    Up to ``HELD`` units are held at a time. A move is along a direction that changes neither their summed chances nor
    their summed sizes, in one sense or the other with the probability that keeps every chance in expectation, until
    some unit is at 0 or 1. The direction moves the longest unit and spreads what balances it over the others, in
    proportion to the room they have, so long units settle while there are many others.
    """

    def __init__(self, *seed: object):
        self.draw = random.Random(zlib.crc32(repr(seed).encode()))
        self.held: list[list] = []

    def add(self, key: tuple, chance: float, size: int) -> list[tuple]:
        """Take one unit; return those that are settled now as (key, 0.0 or 1.0, size)."""
        if not _EXACT < chance < 1 - _EXACT:
            return [(key, float(round(chance)), size)]
        self.held.append([key, chance, size])
        return self._moved() if len(self.held) >= HELD else []

    def _moved(self) -> list[tuple]:
        """Those that one move settles; none if no direction is left."""
        chances = np.array([unit[1] for unit in self.held])
        u = _direction(chances, np.array([unit[2] for unit in self.held], float))
        if u is None:
            return []
        up, down = np.where(u > 0, 1 - chances, chances), np.where(u > 0, chances, 1 - chances)
        moving = np.abs(u) > 0
        forth, back = (float((room[moving] / np.abs(u[moving])).min()) for room in (up, down))
        chances = chances + (forth if self.draw.random() * (forth + back) < back else -back) * u
        settled, rest = [], []
        for unit, chance in zip(self.held, chances.tolist(), strict=True):
            unit[1] = chance
            if _EXACT < chance < 1 - _EXACT:
                rest.append(unit)
            else:
                settled.append((unit[0], float(round(chance)), unit[2]))
        self.held = rest
        return settled

    def rest(self, final: bool) -> list[tuple]:
        """The units left, moved as far as they go; in the source's last flight the last few land together."""
        out: list[tuple] = []
        while len(self.held) > (LANDED if final else 0) and (settled := self._moved()):
            out += settled
        return out + (_landing(self.held) if final else [tuple(unit) for unit in self.held])


def _direction(chances: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """A change of chances that leaves their sum and the sum of sizes as they are; None if there is none."""
    count = len(sizes)
    if count < 2:
        return None
    longest = int(np.argmax(sizes))
    room = np.minimum(chances, 1 - chances)
    room[longest] = 0
    base = sizes[longest] or 1.0
    share = sizes / base
    w0, w1, w2 = room.sum(), (room * share).sum(), (room * share * share).sum()
    det = w0 * w2 - w1 * w1
    u = np.zeros(count)
    if count > 2 and det > 1e-9 * w0 * w2:
        # The others give up a + b * size of their room each: together 1 unit and the longest one's size.
        u = -room * ((w2 - w1) + (w0 - w1) * share) / det
        u[longest] = 1
        return u / np.abs(u).max()
    # The others are of one size: two units of one size may change places.
    order = np.argsort(sizes, kind="stable")
    same = np.flatnonzero(sizes[order][1:] == sizes[order][:-1])
    if len(same):
        u[order[same[0]]], u[order[same[0] + 1]] = 1, -1
        return u
    if count > 2:
        x, y, z = order[-1], order[-2], order[-3]
        u[x], u[y], u[z] = sizes[z] - sizes[y], sizes[x] - sizes[z], sizes[y] - sizes[x]
        return u / np.abs(u).max()
    return None


def _landing(rest: list[tuple]) -> list[tuple]:
    """Settle the last units of a source: the choice whose words, then documents, come nearest to what is expected."""
    if not rest:
        return []
    taken = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
    off = taken - np.array([unit[1] for unit in rest])
    words, docs = np.abs(off @ np.array([unit[2] for unit in rest], float)), np.abs(off.sum(axis=1))
    best = taken[np.lexsort((docs, np.round(words, 6)))[0]]
    return [(key, float(t), s) for t, (key, _, s) in zip(best.tolist(), rest, strict=True)]


def balanced(units: DataFrame, blocks: str = "blocks", seed: int = 0) -> DataFrame:
    """``units`` with ``chance`` settled to 0 or 1, balancing units and sizes within each ``source_rank``.

    Columns used: ``source_rank``, ``chance``, ``size``, ``mark`` (a hash that orders and
    spreads units) and ``blocks`` (into how many blocks the source is dealt). Each
    block is one flight over its stream, from long documents to short ones, so a source of any size is many
    tasks and a task holds ``HELD`` units. What is left, two units a block at most, flies
    again with the rests of ``MEET`` blocks, until a source is one block and its last
    few units land. The seed and the marks fix every draw; equal units are interchangeable.
    """
    columns = units.columns
    schema = units.withColumn("block", F.lit(0).cast("bigint")).schema
    most = units.agg(F.max(blocks)).first()[0] or 1
    level, done = 0, []
    flying = units.withColumn("block", F.pmod("mark", F.col(blocks)))
    while True:
        final = most == 1

        def fly(batches: Iterator[pa.RecordBatch], final: bool = final, level: int = level) -> Iterator[pa.RecordBatch]:
            yield from _fly(batches, final, seed, level)

        # From long to short, so that what is left to the end and lands is short.
        ordered = flying.repartition("source_rank", "block").sortWithinPartitions("source_rank", "block", F.desc("size"), "mark", *[c for c in columns if c == "doc_id"])
        flown = stored(ordered.mapInArrow(fly, schema))
        if final:
            break
        done.append(flown.where("chance IN (0, 1)"))
        flying = flown.where("chance NOT IN (0, 1)").withColumn("block", F.floor(F.col("block") / MEET))
        most, level = -(-most // MEET), level + 1
    for part in done:
        flown = flown.union(part)
    return flown.drop("block")


def _fly(batches: Iterator[pa.RecordBatch], final: bool, *seed: object) -> Iterator[pa.RecordBatch]:
    """Flights over a stream sorted by source and block; ``final``: each source's flight lands."""
    group, flight, batch = None, Flight(), None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in batch.schema.names]
        ranks, blocks, chances, sizes = (columns[batch.schema.names.index(n)] for n in ("source_rank", "block", "chance", "size"))
        out: list[tuple] = []
        for k, row in enumerate(zip(*columns, strict=True)):
            if (ranks[k], blocks[k]) != group:
                out += flight.rest(final)
                group = ranks[k], blocks[k]
                flight = Flight(*seed, *group)
            out += flight.add(row, chances[k], sizes[k])
        if out:
            yield _batch(out, batch.schema)
    if batch is not None and flight.held:
        yield _batch(flight.rest(final), batch.schema)


def _batch(units: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    place = schema.names.index("chance")
    columns = [list(column) for column in zip(*(u[0] for u in units), strict=True)]
    columns[place] = [u[1] for u in units]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id``, ``row_key``, ``size``, ``source_size``, ``target``, ``copies`` of every document.

    A document's size is its words (runs of bytes other than ASCII white space; null
    or empty text: 0). Its source's target over its source's size says how often it is
    taken on average: the whole part always, the fraction as a chance that the cube method
    settles, balancing words and documents of the source. Null sources are one
    source. Null ids and repeated rows are documents of their own (equal rows are
    interchangeable; ``row_key`` is the id with a hash of all columns). An empty table gives an empty result.
    """
    sizes = stored(
        docs.select(
            F.col("doc_id").cast("bigint"),
            row_key(docs).alias("row_key"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("bigint").alias("size"),
        )
    )
    goal = targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["_source"])).drop("source", "_source")
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("often", F.floor(often)).withColumn("chance", often - F.floor(often))
    rows = rows.withColumn("mark", F.xxhash64("row_key", F.lit("mix"))).withColumn("blocks", F.ceil(F.col("source_docs") / BLOCK_UNITS))
    settled = balanced(rows)
    return settled.select("doc_id", "row_key", "size", "source_size", "target", (F.col("often") + F.col("chance")).cast("bigint").alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns.

    Nulls, empty texts and repeated rows as in ``mixed``; columns of any name and type are passed on. An empty table gives an empty result.
    """
    # Equal rows share a key; one of them stands for all their copies, made in portions.
    copies = mixed(docs, weights, share, most).groupBy("row_key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    keyed = docs.select(whole(docs), row_key(docs).alias("row_key")).dropDuplicates(["row_key"])
    taken = keyed.join(copies, "row_key")
    portions = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / PORTION))
    dealt = taken.select("_row", "copies", F.explode(portions).alias("_portion"))
    left = F.least(F.lit(PORTION), F.col("copies") - F.col("_portion") * PORTION).cast("int")
    return unpacked(dealt.select("_row", F.explode(F.sequence(F.lit(1), left))), docs)
