"""Passages that repeat across documents, found window by window in minimiser buckets, and their removal."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.llm.rows import names
from gleaner.llm.text import flat, mix, normal, runs, text_blocks, word_hashes, words

WINDOW = 13
GRAM = 3  # words of which a minimiser is the hash
BUCKET_BYTES = 16 << 20  # of packed words that a bucket holds on average
SLOTS = 8  # groups of minimisers in a bucket whose bytes are counted apart
_LAST = np.iinfo(np.int64).max  # in place of a null id: after all others


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def later_windows(text: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Which windows have words that also stand in a window of a smaller id.

    ``first`` is each window's first word, ``ids`` its document's id. Windows are
    sorted by a hash; within a run of equal hashes the bytes themselves are compared.
    """
    later = np.zeros(len(first), bool)
    if not len(first):
        return later
    keys = runs(hashes, size)[first]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    crowd = ~fresh
    crowd[:-1] |= ~fresh[1:]
    if not crowd.any():
        return later
    group = np.cumsum(fresh)[crowd]
    members = order[crowd]
    begins, finishes = starts[first[members]], ends[first[members] + size - 1]
    heads = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.maximum.accumulate(np.where(heads, np.arange(len(group)), 0))
    same = [text[a:b] == text[c:d] for a, b, c, d in zip(begins.tolist(), finishes.tolist(), begins[head].tolist(), finishes[head].tolist(), strict=True)]
    if not all(same):  # equal hashes of different words: group those by their bytes
        known: dict[bytes, int] = {}
        top = int(group[-1]) + 1
        for k in np.flatnonzero(~np.array(same)).tolist():
            group[k] = known.setdefault(text[begins[k] : finishes[k]], top + len(known))
    _, group = np.unique(group, return_inverse=True)
    least = np.full(group.max() + 1, _LAST)
    np.minimum.at(least, group, ids[members])
    later[members] = ids[members] > least[group]
    return later


def _spans(hit: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of hits; ``following`` says that an entry directly follows the one before."""
    begin = hit.copy()
    begin[1:] &= ~(hit[:-1] & following[1:])
    end = hit.copy()
    end[:-1] &= ~(hit[1:] & following[1:])
    return np.flatnonzero(begin), np.flatnonzero(end)


def _pack(*parts: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts))


def _slots(seeds: np.ndarray, buckets: int) -> np.ndarray:
    """The group of minimisers that each one is in; a bucket has ``SLOTS`` of them."""
    return (mix(seeds) % np.uint64(buckets * SLOTS)).astype(np.int64)


def _weights(table: pa.Table, size: int, buckets: int) -> np.ndarray:
    """Bytes of words that a block's windows would send to each slot."""
    data, offsets = flat(table.column("text"))
    starts, ends, doc = words(data, offsets)
    data, _, starts, ends = normal(data, offsets, starts, ends, doc)
    count = len(starts) - size + 1
    first = np.flatnonzero(doc[: max(count, 0)] == doc[size - 1 :])
    if not len(first):
        return np.zeros(buckets * SLOTS)
    seeds = _least(runs(word_hashes(data, starts, ends), GRAM), size - GRAM + 1)[first]
    a, b = _spans(np.ones(len(first), bool), np.concatenate(([False], (np.diff(first) == 1) & (seeds[1:] == seeds[:-1]))))
    return np.bincount(_slots(seeds[a], buckets), ends[first[b] + size - 1] - starts[first[a]], buckets * SLOTS)


def _packed(table: pa.Table, size: int, buckets: int, heavy: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Bucket and blob of what one block of documents sends.

    A window that a smaller id of the same block also holds is settled here, so
    of a passage that many documents share the block sends one copy; the settled
    ranges travel in a blob of their own, past the last bucket. Windows whose
    minimiser is in a slot of ``heavy`` go one by one to the bucket of their own hash.
    """
    data, offsets = flat(table.column("text"))
    starts, ends, doc = words(data, offsets)
    data, _, starts, ends = normal(data, offsets, starts, ends, doc)
    if len(starts) < size:
        return
    ids = table.column("row_id").to_numpy()
    keys = table.column("row_key").to_numpy()
    places = np.arange(len(starts)) - np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(ids)))))[doc]
    hashes = word_hashes(data, starts, ends)
    count = len(starts) - size + 1
    first = np.flatnonzero(doc[:count] == doc[size - 1 :])
    if not len(first):
        return
    text = data.tobytes()
    owner = doc[first]
    settled = later_windows(text, starts, ends, hashes, first, ids[owner], size)
    following = np.concatenate(([False], np.diff(first) == 1))
    if settled.any():
        a, b = _spans(settled, following)
        rows = ids[owner[a]], keys[owner[a]], places[first[a]], places[first[b]] + size
        yield buckets + int(abs(ids[0]) % buckets), _pack(np.array([len(a)]), *rows)
    seeds = _least(runs(hashes, GRAM), size - GRAM + 1)[first]
    left = ~settled
    slots = _slots(seeds, buckets)
    alone = np.isin(slots, heavy)
    following[1:] &= (seeds[1:] == seeds[:-1]) & ~alone[1:]
    a, b = _spans(left, following)
    target = slots[a] % buckets
    own = alone[a]
    target[own] = (runs(hashes, size)[first[a[own]]] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    a, b, target = a[order], b[order], target[order]
    begins, finishes = starts[first[a]], ends[first[b] + size - 1]
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))), [len(target)])) if len(a) else [0]
    row = owner[a]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = slice(low, high)
        strings = b"".join([text[x:y] for x, y in zip(begins[part].tolist(), finishes[part].tolist(), strict=True)])
        yield (
            int(target[low]),
            _pack(np.array([high - low]), ids[row[part]], keys[row[part]], places[first[a[part]]], finishes[part] - begins[part], strings),
        )


def _settled(table: pa.Table, size: int, buckets: int) -> pa.Table:
    """Ranges of words to remove, from all blobs of one bucket."""
    unpack = zstandard.ZstdDecompressor().decompress
    blobs = [unpack(blob) for blob in table.column("blob").to_pylist()]
    if table.column("bucket")[0].as_py() >= buckets:
        parts = [np.frombuffer(blob, np.int64)[1:].reshape(4, -1) for blob in blobs]
        row, keys, begin, end = np.concatenate(parts, axis=1)
    else:
        heads = [np.frombuffer(blob, np.int64, 4 * n, 8).reshape(4, -1) for blob in blobs for n in [int.from_bytes(blob[:8], "little")]]
        ids, owners, places, lengths = np.concatenate(heads, axis=1)
        text = b"".join(blob[8 + 32 * head.shape[1] :] for blob, head in zip(blobs, heads, strict=True))
        del blobs
        data = np.frombuffer(text, np.uint8)
        starts, ends, string = words(data, np.concatenate(([0], np.cumsum(lengths))))
        hashes = word_hashes(data, starts, ends)
        count = len(starts) - size + 1
        first = np.flatnonzero(string[:count] == string[size - 1 :])
        owner = string[first]
        later = later_windows(text, starts, ends, hashes, first, ids[owner], size)
        a, b = _spans(later, np.concatenate(([False], np.diff(first) == 1)))
        # The place of a window within its string, after the string's own place.
        opening = np.searchsorted(string, owner[a])
        row, keys = ids[owner[a]], owners[owner[a]]
        begin = places[owner[a]] + first[a] - opening
        end = begin + (first[b] - first[a]) + size
    return pa.table({"row_id": row, "row_key": keys, "begin": begin, "end": end})


def _row(docs: DataFrame) -> list[Column]:
    """What finds a row again: its id, and a hash of its text if any id is null or repeats.

    Most corpora have an id per row; a hash would then be an eighth of all that is sent.
    """
    unique = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    twin = F.lit(0).cast("bigint") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST))).alias("row_id"), twin.alias("row_key")]


def repeated_ranges(docs: DataFrame, row: list[Column], window: int = WINDOW) -> DataFrame:
    """``row_id``, ``row_key``, ``begin``, ``end``: words ``begin`` to before ``end`` lie in windows that a smaller id holds too.

    Super-k-mers: a window's minimiser is the least hash of ``GRAM`` consecutive
    words in it. Consecutive windows with the same minimiser travel as one string
    of words to the minimiser's bucket, where equal windows meet and are sorted
    and compared by their words. Strings of a block and bucket share one compressed
    blob. There are as many buckets as keep one at ``BUCKET_BYTES`` on average.

    All windows around a frequent gram have one minimiser. So the bytes of each slot
    of minimisers are counted first, and the windows of one that alone is over
    ``BUCKET_BYTES`` are dealt by their own hash instead: equal windows still
    meet, and different ones part.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    span = (window - GRAM + 2) / 2
    packed = total * (span + window - 1) / span
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(packed / BUCKET_BYTES))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets * SLOTS)
        for table in text_blocks(batches):
            sums += _weights(table, window, buckets)
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(sums[filled].astype(np.int64))], ["slot", "bytes"])

    weights = docs.select("text").mapInArrow(weigh, "slot bigint, bytes bigint").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    # At most one for every BUCKET_BYTES sent.
    heavy = np.array([r.slot for r in weights.where(F.col("bytes") > BUCKET_BYTES).select("slot").collect()], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            rows = list(_packed(table, window, buckets, heavy))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    def settle(table: pa.Table) -> pa.Table:
        return _settled(table, window, buckets)

    sent = docs.select(*row, "text").mapInArrow(send, "bucket bigint, blob binary")
    # As many partitions as buckets, so a task's share does not grow with the input.
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, "row_id bigint, row_key bigint, begin bigint, end bigint")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, the words left as ``kept``, and ``n_words``, ``n_removed``.

    A word goes if it lies in a window of ``window`` consecutive words that also
    stands in a document with a smaller id. Windows are those of the input, not
    of what is left; repeats within one document stay. Words are runs of bytes other
    than ASCII white space, unchanged; kept words are joined by one space.
    A null or empty text has no words and an empty ``kept``. A null id comes after
    all others, and two null ids do not remove from each other; nor do rows
    with equal ids. Repeated rows get equal results, from one set of ranges. An empty table gives an empty
    result. Columns of other names are passed on, whatever they are called.
    """
    row = _row(docs)
    ranges = (
        repeated_ranges(docs, row, window)
        .groupBy("row_id", "row_key")
        .agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    )
    rows = docs.select(F.struct(*names([c for c in docs.columns if c != "text"])).alias("row"), "text", *row)
    joined = rows.join(ranges, ["row_id", "row_key"], "left").drop("row_id", "row_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            yield _cut(table)

    counts = [T.StructField(name, T.LongType()) for name in ("n_words", "n_removed")]
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), *counts])
    return joined.mapInArrow(cut, schema)


def _cut(table: pa.Table) -> pa.RecordBatch:
    column = table.column("ranges").combine_chunks()
    data, offsets = flat(table.column("text"))
    starts, ends, doc = words(data, offsets)
    data, _, starts, ends = normal(data, offsets, starts, ends, doc)
    counts = np.bincount(doc, minlength=table.num_rows)
    opening = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(table.num_rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    inner = column.flatten()
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, opening[row] + inner.field("begin").to_numpy(zero_copy_only=False), 1)
    np.add.at(change, opening[row] + inner.field("end").to_numpy(zero_copy_only=False), -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.bincount(doc[kept], minlength=table.num_rows)
    # A word goes with the space after it; the last space of a text is dropped.
    sizes = (ends - starts + 1) * kept
    out = data[np.repeat(kept, ends - starts + 1)]
    lengths = np.bincount(doc, weights=sizes, minlength=table.num_rows).astype(np.int64)
    whole, closing = out.tobytes(), np.cumsum(lengths)
    texts = [whole[b - n : max(b - n, b - 1)] for b, n in zip(closing.tolist(), lengths.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            table.column("row").combine_chunks(),
            table.column("text").combine_chunks(),
            pa.array(texts, pa.binary()).cast(pa.string()),
            pa.array(counts, pa.int64()),
            pa.array(counts - left, pa.int64()),
        ],
        ["row", "text", "kept", "n_words", "n_removed"],
    )
