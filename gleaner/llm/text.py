"""Texts as flat byte arrays: words, word hashes and sequence hashes for whole blocks of documents at once.

Words are runs of bytes other than the six ASCII white-space bytes, taken
unchanged. UTF-8 never uses these bytes inside a character, so byte and
character words are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20  # bytes of text that a task handles at once; a longer text stands alone

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 19  # bytes that one prefix sum spans
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[pa.Table]:
    """Arrow batches regrouped into tables of about ``size`` bytes of text."""
    held: list[pa.RecordBatch] = []
    filled = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        total = np.cumsum(lengths)
        while first < batch.num_rows:
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + max(size - filled, 1), "right")))
            held.append(batch.slice(first, last - first))
            filled += int(total[last - 1] - before)
            first = last
            if filled >= size:
                yield pa.Table.from_batches(held)
                held, filled = [], 0
    if held:
        yield pa.Table.from_batches(held)


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more offset at the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of its document; ``between`` marks the bytes that part words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~between[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    # A document's edge parts words too.
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from each start to its end as binary values; places are worked out for ``_STEP`` bytes at a time, as they take many times the room."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    out = np.empty(int(offsets[-1]), np.uint8)
    first = 0
    while first < len(starts):
        begin = offsets[first]
        last = max(first + 1, int(np.searchsorted(offsets, begin + _STEP, "right")) - 1)
        place = np.repeat(starts[first:last] - offsets[first:last], lengths[first:last])
        place += np.arange(begin, offsets[last])
        out[begin : offsets[last]] = data[place]
        first = last
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's number, and the different words by number; words are told apart by their bytes."""
    coded = gathered(data, starts, ends).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def normal(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
    """The same texts with one space after each word: bytes, document offsets, word starts and ends."""
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64), starts, ends
    keep = ~SPACE[data]
    lengths = ends - starts
    new_starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    letters = np.ones(int(new_starts[-1] + lengths[-1] + 1), bool)
    letters[new_starts + lengths] = False
    out = np.full(len(letters), 32, np.uint8)
    out[letters] = data[keep]
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    closing = np.concatenate((new_starts, [len(out)]))
    return out, closing[np.concatenate(([0], np.cumsum(counts)))], new_starts, new_starts + lengths


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(max(size, _STEP + 1), base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes, the same wherever the word stands.

    Prefix sums of bytes times powers of an odd base modulo 2^64: a word is the
    difference of two sums, divided by the power at its start.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + _STEP, "right")))
        begin, end = starts[first:last] - origin, ends[first:last] - origin
        power, inverse = _power(int(end[-1]) + 1)
        sums = np.zeros(int(end[-1]) + 1, np.uint64)
        np.cumsum((data[origin : origin + end[-1]].astype(np.uint64) + np.uint64(1)) * power[: end[-1]], out=sums[1:])
        out[first:last] = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        first = last
    return out


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive words that start at each word (len - size + 1 values)."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + hashes[k : k + count]
    return mix(total)
