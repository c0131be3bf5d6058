"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.labelled import _GRAINS, fold, one_each
from gleaner.llm.text import flat, text_blocks

LENGTH = 256  # bytes of a window
WIDTHS = (2, 3, 4)  # bytes that a filter spans
FILTERS = 16  # filters of each width
TRAIN_DOCS = 4000  # labelled documents the network is fitted on, about, at most
TRAIN_WINDOWS = 6  # windows of each of them, evenly spread over the whole text
_SALTS = 64  # tasks that the rows of one language are dealt to
_BATCH, _MANY = 64, 8192  # windows that are convolved, and cut out, at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen ones of the consecutive windows over every whole text, ended with zeros: bytes, text index and length of each."""
    sizes = np.diff(offsets)
    counts = -(-sizes // LENGTH)
    doc = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    doc, place = doc[chosen], place[chosen]
    begin = offsets[doc] + place * LENGTH
    length = np.minimum(LENGTH, offsets[doc + 1] - begin)
    index = np.minimum(begin[:, None] + np.arange(LENGTH), max(len(data) - 1, 0))
    taken = _LOWER[data[index]] if len(data) else np.zeros((0, LENGTH), np.uint8)
    taken[np.arange(LENGTH) >= length[:, None]] = 0
    return taken, doc, length


@dataclass
class Network:
    """Filters as tables of byte weights (position, byte, filter), pooled by maximum, then a softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    shift: np.ndarray
    _pairs: list = field(default_factory=list, repr=False)

    def pooled(self, taken: np.ndarray) -> np.ndarray:
        """Maximum of each filter over a batch of windows.

        Two neighbouring bytes are looked up at once, in tables made on first use.
        """
        if not self._pairs:
            for table in self.tables:
                steps = [(j, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, len(table) - 1, 2)]
                self._pairs.append(steps + ([(len(table) - 1, table[-1])] if len(table) % 2 else []))
        both = taken[:, :-1].astype(np.int32) << 8 | taken[:, 1:]
        out = []
        for table, steps in zip(self.tables, self._pairs, strict=True):
            span = LENGTH - len(table) + 1
            total = None
            for j, rows in steps:
                part = np.take(rows, (both if len(rows) > 256 else taken)[:, j : j + span], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1)

    def chances(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + self.bias, 0)
        logits = hidden @ self.weight + self.shift
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean chances of every language over each text's windows, weighed by their length."""
        sizes = np.diff(offsets)
        total = np.zeros((len(sizes), len(self.languages)))
        for first in range(0, int((-(-sizes // LENGTH)).sum()), _MANY):
            taken, doc, length = windows(data, offsets, slice(first, first + _MANY))
            pooled = np.concatenate([self.pooled(taken[k : k + _BATCH]) for k in range(0, len(taken), _BATCH)])
            np.add.at(total, doc, self.chances(pooled) * length[:, None])
        return total / np.maximum(sizes, 1)[:, None]


def fit(taken: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 5, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam over batches of windows; the gradient of a maximum goes to the place it came from."""
    draw = np.random.default_rng(seed)
    tables = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    wide = FILTERS * len(WIDTHS)
    weight, shift = draw.normal(0, 0.2, (wide, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    bias = np.zeros(wide, np.float32)
    params = [*tables, bias, weight, shift]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = 0
    column = np.arange(FILTERS)
    for _ in range(rounds):
        order = draw.permutation(len(taken))
        for at in range(0, len(order), _BATCH):
            x, y = taken[order[at : at + _BATCH]], labels[order[at : at + _BATCH]]
            row = np.arange(len(x))
            tops, pooled = [], []
            for table in tables:
                span = LENGTH - len(table) + 1
                total = sum(table[j][x[:, j : j + span]] for j in range(len(table)))
                tops.append(total.argmax(axis=1))
                pooled.append(np.take_along_axis(total, tops[-1][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ weight + shift
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = odds / odds.sum(axis=1, keepdims=True)
            slope[row, y] -= 1
            slope /= len(x)
            back = (slope @ weight.T) * (raw > 0)
            grads = []
            for k, (table, top) in enumerate(zip(tables, tops, strict=True)):
                grad = np.zeros_like(table)
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(table)):
                    np.add.at(grad[j], (x[row[:, None], top + j], column), part)
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            steps += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return Network(languages, tables, bias, weight, shift)


def known_windows(docs: DataFrame, held_out: int = 2, parts: int = 4, bound: int = TRAIN_DOCS) -> DataFrame | None:
    """``doc_id``, ``lang`` and chosen windows, joined as ``bytes``, of about ``bound`` documents at most; None if no document has a language.

    Of several rows of one id and language that with the least bytes counts. Texts without a byte have no windows and give no row.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(parts) != held_out))
    counts = known.groupBy("lang").agg(F.count("*").alias("docs"))
    languages = counts.count()
    if not languages:
        return None
    # Ids are chosen on narrow rows, a language over many tasks; only the sample, as small as its bound, meets the texts.
    share = F.lit(bound / languages) / F.col("docs")
    grain = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(_GRAINS))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    shares = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spread = known.select("doc_id", "lang", salt.cast("int").alias("salt")).join(shares, ["lang", "salt"])
    chosen = spread.where(grain < share * _GRAINS).select("doc_id", "lang").distinct()
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            data, offsets = flat(table.column("text"))
            counts = -(-np.diff(offsets) // LENGTH)
            opening = np.cumsum(counts) - counts
            chosen = np.concatenate([np.unique(o + np.linspace(0, c - 1, min(c, TRAIN_WINDOWS)).astype(int)) for o, c in zip(opening, counts, strict=True) if c] or [np.zeros(0, int)])
            taken, doc, _ = windows(data, offsets, chosen)
            some = np.flatnonzero(counts)
            edges = np.searchsorted(doc, some), np.searchsorted(doc, some, "right")
            joined = pa.array([taken[lo:hi].tobytes() for lo, hi in zip(*edges, strict=True)], pa.binary())
            own = [table.column(name).combine_chunks().take(pa.array(some)) for name in ("doc_id", "lang")]
            yield pa.RecordBatch.from_arrays([*own, joined], ["doc_id", "lang", "bytes"])

    texts = sample.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return one_each(texts.mapInArrow(cut, "doc_id bigint, lang string, bytes binary"), ["doc_id", "lang"], "bytes")


def learn(docs: DataFrame, held_out: int = 2, parts: int = 4, bound: int = TRAIN_DOCS) -> Network | None:
    """A network fitted on about ``bound`` documents at most, one row of each, as many of each language, none of the held-out fold.

    Only text and non-null ``lang`` of rows with an id are used. None if no document has a language, as in an empty table.
    """
    known = known_windows(docs, held_out, parts, bound)
    if known is None:
        return None
    rows = known.select("lang", "bytes").toArrow()
    texts = zip(rows.column("lang").to_pylist(), rows.column("bytes").to_pylist(), strict=True)
    pairs = sorted((lang, text[at : at + LENGTH]) for lang, text in texts for at in range(0, len(text), LENGTH))
    names = sorted({p[0] for p in pairs})
    if not names:
        return None
    taken = np.frombuffer(b"".join(p[1] for p in pairs), np.uint8).reshape(-1, LENGTH)
    return fit(taken, np.array([names.index(p[0]) for p in pairs]), names)


def lettered(column: pa.ChunkedArray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    ascii_letter = (data >= 97) & (data <= 122) | (data >= 65) & (data <= 90)
    sums = np.concatenate(([0], np.cumsum(ascii_letter)))
    some = sums[offsets[1:]] > sums[offsets[:-1]]
    for row in np.flatnonzero(~some & (np.diff(offsets) > 0)).tolist():
        some[row] = any(map(str.isalpha, column[row].as_py()))
    return some


def identified(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every document.

    The network sees every window of the whole text; the language with the highest mean
    chance wins, and that chance is the score. A text that is null, empty or without a letter is
    ``und`` with score 0, and so is every text if nothing could be learned. Null ids and
    repeated rows are passed on; an empty table gives an empty result; other columns are not read.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            data, offsets = flat(table.column("text"))
            some = lettered(table.column("text"), data, offsets)
            languages, scores = np.full(table.num_rows, "und", object), np.zeros(table.num_rows)
            if network and some.any():
                chances = network.predict(data, offsets)
                best = chances.argmax(axis=1)
                languages[some] = np.array(network.languages, object)[best[some]]
                scores[some] = np.clip(chances.max(axis=1)[some], 0, 1)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(name, "doc_id bigint, lang_pred string, score double")
