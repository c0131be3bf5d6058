"""Sequences of bounded size: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.text import SPACE, distinct, flat, text_blocks, word_hashes

TOKENS = 1024  # tokens of a sequence
SEGMENTS = 64  # pieces of a sequence
POOL = 1024  # pieces a task chooses from
_SLOT = 33  # a sequence's number is its task's, then its own
_KNOWN = 1_000_000  # parts of texts whose ids a worker remembers


_BLANK = SPACE.copy()
_BLANK[0x1C:0x20] = True
_SIGN = np.zeros(256, bool)
# Not the bar: it closes the string of the special token, which the tokenizer takes as a whole.
_SIGN[list(b"!#$%&*+,-./:;<=>?@^_`~)]}")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123))] = True


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of parts of texts whose tokens do not depend on what stands around them.

    The tokenizer never joins what stands before a single space with it, nor a letter or
    digit with signs after it. So a text is cut before each space between two bytes that are surely
    no white space, and each piece between an ASCII letter, digit or Latin-1 letter and its
    closing ``_SIGN``s. Where a cut is in doubt there is none, which only makes a part longer.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~edge[at] & ~edge[at + 1]]
    before, after = data[at - 1], data[at + 1]
    # White space beyond ASCII begins with one of four bytes, and ends within two bytes after it.
    odd = np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))
    near = odd[np.maximum(at - 2, 0)] | odd[np.maximum(at - 3, 0)]
    doubt = _BLANK[before] | _BLANK[after] | odd[at + 1] | (before >= 128) & near
    edge[at[~doubt]] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    plain = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data))))
    last = plain[ends - 1]
    # The accumulated place may lie in an earlier piece: then the piece is signs only.
    inside = (last >= starts) & (last < ends - 1)
    final, lead = data[np.maximum(last, 0)], data[np.maximum(last - 1, 0)]
    letter = _ALNUM[final] | (lead == 0xC3) & (final >= 128) & (final != 0x97) & (final != 0xB7)
    edge[last[inside & letter] + 1] = True
    bounds = np.flatnonzero(edge)
    return bounds[:-1], bounds[1:]


class _Known:
    """Ids of parts of texts seen before, found by a hash and checked by their bytes; a million parts take about 80 MB."""

    def __init__(self):
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.texts, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.closing = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The entry of each part, -1 for those not seen before."""
        out = np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        hit = np.flatnonzero(at < len(self.hashes))
        hit = hit[self.hashes[at[hit]] == hashes[hit]]
        entry = self.entry[at[hit]]
        lengths = np.diff(edges)[hit]
        same = lengths == self.ends[entry + 1] - self.ends[entry]
        hit, entry, lengths = hit[same], entry[same], lengths[same]
        if not len(hit):
            return out
        # Equal hashes and lengths: the bytes decide.
        closing = np.cumsum(lengths)
        place = np.arange(int(closing[-1])) - np.repeat(closing - lengths, lengths)
        differs = data[np.repeat(edges[hit], lengths) + place] != self.texts[np.repeat(self.ends[entry], lengths) + place]
        good = np.ones(len(hit), bool)
        good[np.repeat(np.arange(len(hit)), lengths)[differs]] = False
        out[hit[good]] = entry[good]
        return out

    def add(self, hashes: np.ndarray, texts: pa.Array, ids: list[list[int]]) -> np.ndarray:
        """Entries of new parts. One whose hash another part has already is kept, but not found again."""
        first = len(self.ends) - 1
        data, edges = flat(texts)
        self.texts = np.concatenate((self.texts, data))
        self.ends = np.concatenate((self.ends, self.ends[-1] + edges[1:]))
        closing = self.closing[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), "<u4", int(closing[-1] - self.closing[-1]))))
        self.closing = np.concatenate((self.closing, closing))
        entries = np.arange(first, first + len(ids))
        hashes, one = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, hashes)
        taken = self.hashes[np.minimum(at, max(len(self.hashes) - 1, 0))] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        self.hashes = np.insert(self.hashes, at[~taken], hashes[~taken])
        self.entry = np.insert(self.entry, at[~taken], entries[one[~taken]])
        return entries


class Tokens:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Texts are cut into parts, equal parts of a block are told by their bytes, and each
    different part is looked up; parts not seen before go through the tokenizer together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known()

    def encode(self, column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more place at the end)."""
        data, offsets = flat(column)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        starts, ends = _parts(data, offsets)
        codes, different = distinct(data, starts, ends)
        own, edges = flat(different)
        hashes = word_hashes(own, edges[:-1], edges[1:])
        if len(self.known.ends) > _KNOWN:
            self.known = _Known()
        entry = self.known.find(hashes, own, edges)
        new = np.flatnonzero(entry < 0)
        if len(new):
            texts = different.take(pa.array(new))
            found = self.tokenizer.encode_batch_fast(texts.cast(pa.large_string()).to_pylist(), add_special_tokens=False)
            entry[new] = self.known.add(hashes[new], texts, [e.ids for e in found])
        opening, counts = self.known.closing[entry], self.known.closing[entry + 1] - self.known.closing[entry]
        lengths = counts[codes]
        closing = np.cumsum(lengths)
        place = np.repeat(opening[codes] - (closing - lengths), lengths) + np.arange(int(closing[-1]))
        before = np.concatenate(([0], closing))
        return self.known.ids[place], before[np.searchsorted(starts, offsets)]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One tokenizer with its known pieces per worker."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Packer:
    """Fills one sequence at a time from a pool of items with several demands.

    ``limits`` has one number per demand (tokens first, segments second). The next item is, of
    those that fit in all demands, the one with the largest dot product of its demands and the
    room left, both as shares of the limits. ``cut(item, tokens)`` parts an item into one
    of that many tokens and the rest, or gives None; a sequence that no whole item fits into is
    filled with a cut one.
    """

    def __init__(self, limits: tuple[int, ...], cut):
        self.limits, self.cut = np.array(limits, float), cut
        self.items: list = []
        self.demands = np.zeros((len(limits), 0))

    def add(self, items: list, demands: list[tuple[int, ...]]) -> None:
        if not items:
            return
        more = np.array(demands, float).T
        over = np.flatnonzero((more > self.limits[:, None]).any(axis=0))
        if len(over):
            raise ValueError(f"an item's demands {demands[over[0]]} exceed the limits {self.limits}")
        self.items += items
        self.demands = np.concatenate((self.demands, more), axis=1)

    def fill(self) -> list:
        """One sequence's items, taken from the pool."""
        room, chosen = self.limits.copy(), []
        free = np.ones(len(self.items), bool)
        rest: list[tuple] = []
        tokens = self.demands[0]
        while room[0] > 0:
            fits = free & (tokens <= room[0])
            for demand, left in zip(self.demands[1:], room[1:], strict=True):
                fits &= demand <= left
            last = len(room) > 1 and room[1] <= 1
            whole = np.flatnonzero(fits & (tokens == room[0]) if last else fits)
            if not len(whole):
                # Cut the longest item that is left to what there is room for.
                longest = int(np.argmax(np.where(free, tokens, -1)))
                parted = self.cut(self.items[longest], int(room[0])) if free[longest] and tokens[longest] > room[0] and room[1:].min(initial=1) >= 1 else None
                if parted and (np.array(parted[0][1]) <= room).all():
                    free[longest] = False
                    chosen.append(parted[0][0])
                    rest.append(parted[1])
                    break
                whole = np.flatnonzero(fits)
                if not len(whole):
                    break
            # The largest dot product of demands and room, both as shares of the limits.
            best = int(whole[np.argmax((room / self.limits**2) @ self.demands[:, whole])])
            free[best] = False
            chosen.append(self.items[best])
            room -= self.demands[:, best]
        self.items = list(compress(self.items, free.tolist()))
        self.demands = self.demands[:, free]
        if rest:
            self.add([r[0] for r in rest], [r[1] for r in rest])
        return chosen


# A piece of a document: (id, start, ids, tokens of the whole document, whether it ends the document).
Piece = tuple[int | None, int, bytes, int]


def _demand(piece: Piece) -> tuple[int, int, int]:
    """Tokens, segments and tokens that bear loss: all but the closing id."""
    count = len(piece[2]) // 4
    return count, 1, count - (piece[1] + count == piece[3])


def _cut(piece: Piece, count: int):
    head, tail = piece[2][: 4 * count], piece[2][4 * count :]
    a, b = (piece[0], piece[1], head, piece[3]), (piece[0], piece[1] + count, tail, piece[3])
    return (a, _demand(a)), (b, _demand(b))


def _closed(pieces: list[Piece], size: int) -> Iterator[list[Piece]]:
    """A sequence as it is if full, else cut into sequences of powers of two, which need no padding."""
    total = sum(len(p[2]) // 4 for p in pieces)
    if total == size:
        yield pieces
        return
    queue = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        want, taken = total & 1 << bit, []
        while want:
            piece = queue.pop()
            count = len(piece[2]) // 4
            if count > want:
                (piece, _), (rest, _) = _cut(piece, want)
                queue.append(rest)
                count = want
            taken.append(piece)
            want -= count
        if taken:
            yield taken


def _sequences(batches: Iterator[pa.RecordBatch], path: str, size: int, segments: int) -> Iterator[list[list[Piece]]]:
    packer = Packer((size, segments, size), _cut)
    known = tokens(path)
    end = (0).to_bytes(4, "little")
    for table in text_blocks(batches):
        ready: list[list[Piece]] = []
        rests: list[Piece] = []
        ids, offsets = known.encode(table.column("text"))
        own, edges = ids.tobytes(), (4 * offsets).tolist()
        for row, doc in enumerate(table.column("doc_id").to_pylist()):
            text = own[edges[row] : edges[row + 1]] + end
            count = len(text) // 4
            full = count - count % size
            ready += [[(doc, at, text[4 * at : 4 * (at + size)], count)] for at in range(0, full, size)]
            if count > full:
                rests.append((doc, full, text[4 * full :], count))
        packer.add(rests, [_demand(p) for p in rests])
        while len(packer.items) > POOL:
            ready += _closed(packer.fill(), size)
        yield ready
    ready = []
    while packer.items:
        ready += _closed(packer.fill(), size)
    yield ready


def packed(docs: DataFrame, path: str | None = None, size: int = TOKENS, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset`` of every piece.

    A document is its text's ids and a closing id 0; null and empty texts are the closing id
    alone. Whole sequences of ``size`` tokens are cut off first; what is left of each document
    is packed under limits on tokens, segments and tokens that bear loss (all but the
    closing id), and cut again where a sequence has room that nothing fits. A
    sequence that stays short is cut into powers of two, so none is padded. In a plain document all ids but the last bear
    loss, so the limit on tokens is reached before that on loss-bearing ones; in ``packed_examples`` each can be first. ``ids``
    are little-endian unsigned 32-bit numbers; a document's pieces are in order of ``start``.

    Tasks pack the documents they read, so nothing is shuffled, and a task holds a
    batch and ``POOL`` pieces of under ``size`` tokens. Long texts are cut while
    they stream. Null ids and repeated rows are documents of their own; other columns are not
    read; an empty table gives an empty result.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _SLOT
        for ready in _sequences(batches, path, size, segments):
            rows = []
            for pieces in ready:
                offset = 0
                for doc, start, ids, count in pieces:
                    rows.append((doc, start, len(ids) // 4, ids, count, number, offset))
                    offset += len(ids) // 4
                number += 1
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def packed_examples(examples: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)) -> DataFrame:
    """``example_id``, ``sequence_id``, ``place`` of instruction examples, which are never cut.

    ``examples``: ``example_id``, ``tokens``, ``segments`` (turns), ``loss_tokens`` (those of the answers).
    A sequence stays within all three ``limits``. An example that exceeds one alone has a sequence of
    its own (``place`` 0); null demands count as 0. Tasks pack the examples they read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _SLOT
        packer = Packer(limits, lambda item, count: None)

        def placed(sequences: list[list]) -> pa.RecordBatch:
            nonlocal number
            rows = [(item, number + k, place) for k, items in enumerate(sequences) for place, item in enumerate(items)]
            number += len(sequences)
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays(columns, ["example_id", "sequence_id", "place"])

        for batch in batches:
            ids, *demands = (batch.column(k).to_pylist() for k in range(4))
            rows = list(zip(ids, zip(*demands, strict=True), strict=True))
            fits = [all(d <= limit for d, limit in zip(demand, limits, strict=True)) for _, demand in rows]
            packer.add([i for (i, _), fit in zip(rows, fits, strict=True) if fit], [d for (_, d), fit in zip(rows, fits, strict=True) if fit])
            ready = [[i] for (i, _), fit in zip(rows, fits, strict=True) if not fit]
            while len(packer.items) > POOL:
                ready.append(packer.fill())
            yield placed(ready)
        ready = []
        while packer.items:
            ready.append(packer.fill())
        yield placed(ready)

    demands = [F.coalesce(F.col(name).cast("bigint"), F.lit(0)) for name in ("tokens", "segments", "loss_tokens")]
    return examples.select(F.col("example_id").cast("bigint"), *demands).mapInArrow(run, "example_id bigint, sequence_id bigint, place bigint")
