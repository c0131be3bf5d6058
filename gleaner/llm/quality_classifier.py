"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.llm.labelled import fold, labelled, one_each
from gleaner.llm.text import SPACE, flat, text_blocks, word_hashes

BUCKETS = 1 << 15  # word vectors; words are hashed to them
SIZE = 32  # components of a vector
MARKS = 2  # components that a word's index vector has, one up and one down
REACH = 2  # neighbours on either side that a context holds
TRAIN_ROWS = 20_000  # labelled documents the network is fitted on, about, at most
FEATURES = 2 * SIZE + 5  # pooled numbers per text
HIDDEN = 24
ACCEPT = 0.3
_EQUAL = 0.9999  # from here on two unit vectors count as equal
_PIECES = 64  # parts in which the contexts are summed up

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 other signs
_KIND[SPACE] = 0
_KIND[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vector numbers of all terms, and their text: runs of letters and digits, and runs of signs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    hashes = word_hashes(data, starts, ends)
    return (hashes >> np.uint64(64 - 15)).astype(np.int64) % BUCKETS, np.searchsorted(offsets, starts, "right") - 1


def index_vectors() -> np.ndarray:
    """Places of the marks of every term's sparse index vector: the first up, the second down."""
    draw = np.random.default_rng(7)
    first = draw.integers(0, SIZE, BUCKETS)
    return np.stack([first, (first + draw.integers(1, SIZE, BUCKETS)) % SIZE], axis=1)


def contexts(term: np.ndarray, doc: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of all neighbours, by term."""
    total = np.zeros(BUCKETS * SIZE)
    for step in range(1, REACH + 1):
        near = doc[:-step] == doc[step:]
        for own, other in ((term[:-step][near], term[step:][near]), (term[step:][near], term[:-step][near])):
            for k, sign in enumerate((1, -1)):
                total += sign * np.bincount(own * SIZE + marks[other, k], minlength=BUCKETS * SIZE)
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all terms, summed over every whole text.

    A task adds up its texts and sends one compressed array of fixed size per
    piece; pieces are added up as streams in two steps. ``BUCKETS`` x ``SIZE`` numbers
    reach the driver, whatever the input.
    """
    marks = index_vectors()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * SIZE)
        salt = 0
        for table in text_blocks(batches):
            data, offsets = flat(table.column("text"))
            salt += len(data)
            term, doc = terms(data, offsets)
            if len(term) > 1:
                total += contexts(term, doc, marks)
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(part.astype(np.int64).tobytes()) for part in np.split(total, _PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PIECES)), pa.array(np.full(_PIECES, salt % _PIECES)), pa.array(parts, pa.binary())], ["piece", "salt", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for piece, salt, sums in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                # Sorted by piece and salt, so only the current one is held.
                if held and (piece, salt) not in held:
                    yield _sums(held, pack)
                    held = {}
                part = np.frombuffer(unpack(sums), np.int64)
                held[piece, salt] = held.get((piece, salt), 0) + part
        if held:
            yield _sums(held, pack)

    schema = "piece bigint, salt bigint, sums binary"
    sums = docs.select(F.col("text").cast("string")).mapInArrow(gather, schema)
    sums = sums.repartition("piece", "salt").sortWithinPartitions("piece", "salt").mapInArrow(add, schema)
    sums = sums.withColumn("salt", F.lit(0).cast("bigint")).repartition("piece").sortWithinPartitions("piece").mapInArrow(add, schema)
    vectors = np.zeros((_PIECES, BUCKETS * SIZE // _PIECES), np.float32)
    for row in sums.collect():
        vectors[row.piece] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.sums), np.int64)
    vectors = vectors.reshape(BUCKETS, SIZE)
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return vectors / np.maximum(length, 1)


def _sums(held: dict, pack) -> pa.RecordBatch:
    ((piece, salt), total), = held.items()
    return pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([salt]), pa.array([pack(total.tobytes())], pa.binary())], ["piece", "salt", "sums"])


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its terms' vectors, how alike and how often equal neighbours are, and its length."""
    rows = len(offsets) - 1
    term, doc = terms(data, offsets)
    counts = np.bincount(doc, minlength=rows)
    some = np.flatnonzero(counts)
    out = np.zeros((rows, FEATURES), np.float32)
    if not len(term):
        return out
    own = vectors[term]
    opening = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
    number = counts[some][:, None]
    mean = np.add.reduceat(own, opening, axis=0) / number
    out[some, :SIZE] = mean
    out[some, SIZE : 2 * SIZE] = np.sqrt(np.maximum(np.add.reduceat(own * own, opening, axis=0) / number - mean**2, 0))
    for step in (1, 2):
        if len(term) > step:
            near = doc[:-step] == doc[step:]
            alike = np.einsum("ij,ij->i", own[:-step], own[step:]) * near
            for k, pairs in enumerate((alike, alike > _EQUAL)):
                out[:, 2 * SIZE + 2 * k + step - 1] = np.bincount(doc[:-step], pairs, rows) / np.maximum(counts - step, 1)
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class Network:
    """Standardised features, a tanh layer, and a logit divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logit(self, features: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((features - self.centre) / self.scale @ w + b) @ v + c

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features) / self.temperature, -50, 50)))


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.005, seed: int = 3) -> Network:
    """Adam on four fifths of the rows; the temperature that gives the least log loss on the others.

    Without labels of both kinds the score is the labels' smoothed share.
    """
    width = features.shape[1]
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(labels))
    share = (labels.sum() + 1) / (len(labels) + 2)
    start = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.log(share / (1 - share))]
    net = Network(np.zeros(width), np.ones(width), [np.array(p, float) for p in start])
    if len(np.unique(labels)) < 2:
        net.layers[2][:] = 0
        return net
    net.centre, net.scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    aside, rest = order[: len(order) // 5], order[len(order) // 5 :]
    x = (features - net.centre) / net.scale
    first, second, steps = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    for _ in range(rounds):
        rest = draw.permutation(rest)
        for at in range(0, len(rest), 128):
            rows = rest[at : at + 128]
            w, b, v, c = net.layers
            hidden = np.tanh(x[rows] @ w + b)
            slope = (1 / (1 + np.exp(-np.clip(hidden @ v + c, -50, 50))) - labels[rows]) / len(rows)
            back = slope[:, None] * v * (1 - hidden**2)
            grads = [x[rows].T @ back + 1e-4 * w, back.sum(axis=0), hidden.T @ slope, slope.sum()]
            steps += 1
            for p, g, m, s in zip(net.layers, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
    if len(aside):
        logit = net.logit(features[aside])
        heats = np.exp(np.linspace(-1.5, 2.5, 81))
        losses = [np.mean(np.logaddexp(0, -logit / t * (2 * labels[aside] - 1))) for t in heats]
        net.temperature = float(heats[int(np.argmin(losses))])
    return net


def _pooled_rows(docs: DataFrame, vectors, extra: list[str], schema: T.StructType, answer) -> DataFrame:
    """``answer(pooled features)`` as columns after ``extra``, one block of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            features = pooled(*flat(table.column("text")), vectors.value)
            kept = [table.column(name).combine_chunks() for name in extra]
            yield pa.RecordBatch.from_arrays([*kept, *answer(features)], schema.names)

    return docs.select(*extra, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def known_rows(docs: DataFrame, labels: DataFrame, vectors, bound: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, ``label`` and pooled ``features`` to learn from: one row for each of about ``bound`` ids at most.

    Of several rows of one id that with the least features counts. Rows with a null id take no part.
    """
    sample = labelled(labels, fold(5) == 0, bound)
    known = docs.where("doc_id IS NOT NULL").join(F.broadcast(sample), "doc_id")
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])
    rows = _pooled_rows(known, vectors, ["doc_id", "label"], shape, lambda features: [pa.array([f.tobytes() for f in features], pa.binary())])
    return one_each(rows, ["doc_id", "label"], "features")


def scored(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document.

    Word vectors are gathered from every whole text; the network learns from about ``bound``
    labelled documents at most, one row of each, none of them of fold 0 of five (``held_out``). Neither labels nor other columns
    but the text enter a score. Null and empty texts have no terms and get the network's
    score for zeros. A null id is in fold 0. Repeated rows are passed on; an empty table gives an empty
    result; with labels of one kind or none the score is their smoothed share.
    """
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col("doc_id").cast("bigint"), "text")
    # Fixed size: BUCKETS x SIZE numbers.
    vectors = context.broadcast(word_vectors(own))
    rows = sorted(known_rows(own, labels, vectors, bound).collect(), key=lambda r: r.doc_id)
    features = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, FEATURES).astype(float)
    network = fit(features, np.array([r.label for r in rows], float))

    def answer(features: np.ndarray) -> list[pa.Array]:
        score = network.score(features)
        return [pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))]

    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return _pooled_rows(own.withColumn("held_out", fold(5) == 0), vectors, ["doc_id", "held_out"], T.StructType(kinds), answer)
