"""Collocations: frequent phrases mined shard by shard at lowered support, counted exactly, scored by their weakest cut."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.text import distinct, flat, gathered, lowered, mix, text_blocks, word_hashes, words
from gleaner.session import stored

SUPPORT = 30
LONGEST = 4  # words of a phrase
REPORTED = 2000
SHARDS = 10  # parts of the corpus that are mined apart
KEY_BITS = 48  # bits of a phrase's key while shards are mined
MARK_BITS = 27  # bits of the table of locally frequent phrases: 16 MB
BLOCK = 4 << 20  # bytes of text handled at once, half of it while shards are mined; a block in work takes up to 40 times as much
HELD = 2_000_000  # counts that a mining task keeps before it sends them
SENT = 1 << 16  # phrases of a block that leave for Spark at once
BUCKET_TEXT = 12 << 20  # bytes of text whose phrases meet in one bucket
SALTS = 64  # parts in which a language's ranking begins

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?")] = _BREAK[10:14] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[9, 32]] = True


class Words:
    """The words of a block of documents, with a key for each phrase that starts at a word."""

    def __init__(self, table: pa.Table):
        data, offsets = flat(table.column("text"))
        self.data = lowered(data)
        self.starts, self.ends, doc = words(self.data, offsets, _BETWEEN)
        self.codes, self.known = distinct(self.data, self.starts, self.ends)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        breaks = np.flatnonzero(_BREAK[self.data])
        # Whether the next word follows in the same piece.
        self.joined = np.zeros(len(self.starts), bool)
        self.joined[:-1] = (doc[1:] == doc[:-1]) & (np.searchsorted(breaks, self.starts[1:]) == np.searchsorted(breaks, self.ends[:-1]))
        own, edges = flat(self.known)
        self.hashes = word_hashes(own, edges[:-1], edges[1:])[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        own, edges = flat(self.langs.cast(pa.binary()))
        self.seed = mix(word_hashes(own, edges[:-1], edges[1:]) + np.uint64(1))[self.lang] if len(self.codes) else np.zeros(0, np.uint64)

    def keys(self, size: int, at: np.ndarray) -> np.ndarray:
        """``KEY_BITS`` bits of a hash of language and words of the phrases of ``size`` words at the given places."""
        total = self.seed[at]
        for k in range(size):
            total = total * _MULTIPLIER + self.hashes[at + k]
        return mix(total + np.uint64(size)) >> np.uint64(64 - KEY_BITS)

    def longer(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those places whose phrase of ``size`` words goes on by one word in its piece."""
        return at[self.joined[at + size - 1]]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and their counts, each by planes of bytes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(part.view(np.uint8).reshape(len(part), 8).T) for part in (steps, counts.astype(np.uint64))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes)
    return np.cumsum(steps), counts.astype(np.int64)


def locally_frequent(texts: DataFrame, buckets: int, support: int = SUPPORT, shards: int = SHARDS) -> np.ndarray:
    """A table of bits: set for the key of every phrase that some shard holds often enough.

    A shard is every ``shards``-th partition of the input, mined by as many tasks as it has. If a
    phrase occurs ``support`` times in all, one of the shards holds it at least ``support / shards`` times. Tasks count the phrases
    they read and send keys and counts, in order and compressed, to buckets of keys, where each shard's counts are summed. Keys that meet by
    chance only add phrases to the candidates. The table has the same size whatever the corpus.
    """
    least = math.ceil(support / shards)
    bits = MARK_BITS - int(math.log2(buckets))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        edges = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(KEY_BITS)) // np.uint64(buckets)

        def sent(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            cuts = np.searchsorted(keys, edges)
            filled = np.flatnonzero(np.diff(cuts))
            blobs = [_packed(keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]) for b in filled.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([shard] * len(filled), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "shard", "blob"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for table in text_blocks(batches, size=BLOCK // 2):
            block, parts = Words(table), []
            at = np.arange(len(block.starts))
            for size in range(1, LONGEST + 1):
                parts.append(block.keys(size, at))
                at = block.longer(at, size)
            held.append(_tallied(np.concatenate(parts)))
            del block, parts, at
            if sum(len(k) for k, _ in held) > HELD:
                held = [summed(*(np.concatenate(part) for part in zip(*held, strict=True)))]
            if len(held[0][0]) > HELD:
                yield sent(*held.pop())
        if held:
            yield sent(*summed(*(np.concatenate(part) for part in zip(*held, strict=True))))

    def mark(table: pa.Table) -> pa.Table:
        bucket, shard = table.column("bucket")[0].as_py(), table.column("shard").to_numpy()
        blobs = table.column("blob").to_pylist()
        found = np.zeros(1 << bits, bool)
        for one in np.unique(shard):
            parts = [_unpacked(blobs[k]) for k in np.flatnonzero(shard == one)]
            keys, counts = summed(*(np.concatenate(part) for part in zip(*parts, strict=True)))
            often = keys[counts >= least]
            found[(often >> np.uint64(KEY_BITS - MARK_BITS)).astype(np.int64) - (bucket << bits)] = True
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "marks": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    sent = texts.mapInArrow(mine, "bucket bigint, shard bigint, blob binary")
    marked = stored(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(mark, "bucket bigint, marks binary"))
    out = np.zeros(1 << MARK_BITS - 3, np.uint8)
    for row in marked.toLocalIterator():  # 16 MB in all
        out[row.bucket << bits - 3 : (row.bucket + 1) << bits - 3] = np.frombuffer(row.marks, np.uint8)
    return out


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key's number, and for each number one place that has it and how many do."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    return number, order[first], np.diff(np.concatenate((first, [len(keys)])))


def _counts(block: Words, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Size, language codes, phrases and counts of a block's marked phrases of each size.

    Phrases are told apart by the numbers of their words, one word after another, so no hash decides. A phrase is looked at only if
    its parts were: whatever is frequent has frequent parts.
    """
    lengths = block.ends - block.starts
    # The words once more, each with one space after it.
    opening = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.full(int(opening[-1] + lengths[-1] + 1), 32, np.uint8)
    inside = np.ones(len(text), bool)
    inside[opening + lengths] = False
    text[inside] = block.data[~_BETWEEN[block.data]]
    at, many = np.arange(len(block.starts)), len(block.known) + 1
    number = block.lang  # of the phrase so far, at its first word
    unmarked = np.uint64(KEY_BITS - 3 - int(math.log2(len(marks))))
    for size in range(1, LONGEST + 1):
        key = block.keys(size, at) >> unmarked
        hit = marks[(key >> np.uint64(3)).astype(np.int64)] >> (key & np.uint64(7)).astype(np.uint8) & 1 > 0
        at = at[hit]
        ids, one, counts = _numbered(number[at] * many + block.codes[at + size - 1])
        yield size, block.lang[at[one]], gathered(text, opening[at[one]], (opening + lengths)[at[one] + size - 1]), counts
        number = np.zeros(len(block.starts), np.int64)
        number[at] = ids
        alive = np.zeros(len(block.starts) + 1, bool)
        alive[at] = True
        at = block.longer(at, size)
        at = at[alive[at + 1]]


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``f`` of all phrases of 1 to ``LONGEST`` words with f >= ``support``, and per language all words as size 0."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_TEXT))
    buckets = 1 << min(MARK_BITS - 6, max(0, math.ceil(math.log2(wanted))))
    shared = spark.sparkContext.broadcast(locally_frequent(texts, buckets, support, shards))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, size=BLOCK):
            block = Words(table)
            if not len(block.starts):
                continue
            every = np.bincount(block.lang, minlength=len(block.langs))
            parts = [(0, np.arange(len(every)), pa.array([b""] * len(every), pa.large_binary()), every), *_counts(block, shared.value)]
            for size, lang, phrases, counts in parts:
                for first in range(0, len(counts), SENT):
                    some = slice(first, first + SENT)
                    yield pa.RecordBatch.from_arrays(
                        [block.langs.take(pa.array(lang[some])), pa.array(np.full(len(counts[some]), size), pa.int32()), phrases[some].cast(pa.binary()).cast(pa.string()), pa.array(counts[some], pa.int64())],
                        ["lang", "size", "phrase", "f"],
                    )

    rows = texts.mapInArrow(count, "lang string, size int, phrase string, f bigint")
    return stored(rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= support)))


def _part(first: Column | int, size: Column) -> Column:
    """``size`` words of a phrase from its ``first``, counted from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, reported: int = REPORTED, covered: int = 80) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's highest ``reported`` phrases.

    A-Z are lower-cased; texts are split at ``. , ; : ! ?`` and line breaks, pieces into words at spaces and tabs. ``n`` counts
    a language's words, f a phrase's occurrences within pieces, overlaps included. Candidates are phrases of 2 to ``LONGEST`` words with a = f >= ``support``.
    The cut after k words gives l and r, the counts of both parts, and floor(2000000 a / (l + r)); the cut with the lowest counts, of equal ones the first.
    A candidate goes if a longer candidate holds it contiguously and has at least ``covered`` percent of its count. Ranks go by score, then a, then
    the phrase's bytes. A null text is empty, a null language ``und``. Repeated rows and null ids are documents like others; a text of any length is one
    document, read whole. An empty table gives an empty result; other columns are not read.

    SON partitioning: shards of the corpus are mined completely at a support lowered in proportion; what is frequent in any shard is
    counted over all texts by its words. The parts of a frequent phrase are frequent too, so all counts that the scores need are among these.
    """
    found = phrase_counts(docs, support, shards)
    counted = found.where("size > 0").select("lang", "phrase", "f")
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    candidates = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    places = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "size", "a", places)
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("_left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    left = counted.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(38, 0)) * a) DIV (CAST(l AS DECIMAL(38, 0)) + r) AS BIGINT)")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = [F.struct(F.lit(first).alias("first"), F.lit(size).alias("size")) for size in range(2, LONGEST) for first in range(1, LONGEST - size + 2)]
    inside = candidates.where("size > 2").select("lang", "phrase", "size", "a", F.explode(F.array(*inner)).alias("part")).where("part.size < size AND part.first + part.size - 1 <= size")
    inside = inside.select("lang", _part(F.col("part.first"), F.col("part.size")).alias("phrase"), F.col("a").alias("f"))
    covering = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(covering, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covered)
    )
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # A language's ranking begins in parts, so one task sees at most the first of each.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= reported)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= reported)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
