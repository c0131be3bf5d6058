"""Quality rules: gradient-boosted trees over document statistics, learned from labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.llm.labelled import fold, labelled, one_each
from gleaner.llm.rows import names
from gleaner.llm.text import SPACE, flat, mix, runs, text_blocks, word_hashes, words

TRAIN_ROWS = 20_000  # labelled documents the trees are fitted on, about, at most
LEAST_WORDS = 50
REPEAT_PERCENT = 50
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# What the trees see, and in which direction quality may follow it: -1 never up, 0 either way.
FEATURES = {
    "words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "exclamation_share": 0,
    "stop_share": 0,
    "comma_share": 0,
}


def _table(letters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(letters)] = True
    return table


_SYMBOL, _DIGIT, _UPPER = _table(SYMBOLS), _table(b"0123456789"), _table(bytes(range(65, 91)))
_BANG, _STOP, _COMMA, _LINE = _table(b"!"), _table(b".?"), _table(b",;:"), _table(b"\n")


def statistics(column: pa.ChunkedArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts of every text, and the features made from them and from kinds of characters."""
    data, offsets = flat(column)
    rows = len(offsets) - 1
    starts, ends, doc = words(data, offsets)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    n_words = np.bincount(doc, minlength=rows)
    word_chars = per_text(~SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[data])
    # Three-word windows found twice in their text cover their words.
    repeat = np.zeros(rows, np.int64)
    if len(starts) >= 3:
        triples = runs(word_hashes(data, starts, ends), 3)
        first = np.flatnonzero(doc[:-2] == doc[2:])
        keys = mix(triples[first] ^ (doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(keys)
        equal = np.zeros(len(order) + 1, bool)
        equal[1:-1] = keys[order[1:]] == keys[order[:-1]]
        found = first[order[equal[1:] | equal[:-1]]]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[found + k] = True
        repeat = np.bincount(doc[covered], minlength=rows)
    line_breaks = per_text(_LINE[data])
    dup_lines, lines = np.zeros(rows, np.int64), np.ones(rows, np.int64)
    whole, edges = data.tobytes(), offsets.tolist()
    for row in np.flatnonzero(line_breaks).tolist():
        full = [line for line in whole[edges[row] : edges[row + 1]].split(b"\n") if line.strip()]
        lines[row] = max(1, len(full))
        dup_lines[row] = len(full) - len(set(full))
    counts = dict(zip(COUNTS, (n_words, word_chars, symbols, dup_lines, repeat), strict=True))
    chars, some = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    features = [
        np.log1p(n_words), word_chars / some, symbols / chars, dup_lines / lines, repeat / some, per_text(_UPPER[data]) / chars,
        per_text(_DIGIT[data]) / chars, per_text(_BANG[data]) / some, per_text(_STOP[data]) / some, per_text(_COMMA[data]) / some,
    ]
    return counts, np.stack(features, axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth as node arrays: a row per tree, children of node k at 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def logit(self, features: np.ndarray) -> np.ndarray:
        """Sum of all trees' leaves, walked level by level for all rows at once."""
        total = np.full(len(features), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        rows = np.arange(len(features))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(features), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (features[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return total

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(features)))


def fit(features: np.ndarray, labels: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss with histogram splits.

    A split on a signed feature must order its children's values by the sign, and
    each child's subtree stays on its side of their middle, so the whole sum is
    monotonic in the feature. Without labels of both kinds the score is a constant.
    """
    width = 2**depth
    empty = Trees(0.0, np.zeros((0, width - 1), np.int64), np.zeros((0, width - 1)), np.zeros((0, width)))
    share = (labels.sum() + 1) / (len(labels) + 2)
    empty.base = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return empty
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in features.T]
    binned = np.stack([np.searchsorted(cut, column, "left") for cut, column in zip(cuts, features.T, strict=True)], axis=1)
    logit = np.full(len(labels), empty.base)
    grown = ([], [], [])
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-logit))
        slope, bend = labels - chance, chance * (1 - chance)
        feature, threshold, value = np.zeros(width - 1, np.int64), np.full(width - 1, np.inf), np.zeros(width)
        node = np.zeros(len(labels), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for k in range(width - 1):
            inside = np.flatnonzero(node == k)
            found = _split(binned[inside], slope[inside], bend[inside], signs, cuts, ridge, low[k], high[k])
            low[2 * k + 1] = low[2 * k + 2] = low[k]
            high[2 * k + 1] = high[2 * k + 2] = high[k]
            if found:
                f, b, left, right = found
                feature[k], threshold[k] = f, cuts[f][b]
                middle = (left + right) / 2
                if signs[f]:
                    upper = 2 * k + (1 if signs[f] < 0 else 2)
                    lower = 2 * k + (2 if signs[f] < 0 else 1)
                    low[upper], high[lower] = max(low[k], middle), min(high[k], middle)
                node[inside] = 2 * k + 1 + (binned[inside, f] > b)
            else:
                node[inside] = 2 * k + 1
        leaf = node - (width - 1)
        up, down = np.bincount(leaf, slope, width), np.bincount(leaf, bend, width)
        value = np.clip(up / (down + ridge), [low[width - 1 + k] for k in range(width)], [high[width - 1 + k] for k in range(width)]) * rate
        logit = logit + value[leaf]
        for store, part in zip(grown, (feature, threshold, value), strict=True):
            store.append(part)
    return Trees(empty.base, *map(np.array, grown))


def _split(binned, slope, bend, signs, cuts, ridge, low, high):
    """Best feature and bin, with both children's values; None if no split gains."""
    if len(binned) < 20:
        return None
    best, found = 1e-6, None
    total, weight = slope.sum(), bend.sum()
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        up = np.cumsum(np.bincount(binned[:, f], slope, len(cut) + 1))[:-1]
        down = np.cumsum(np.bincount(binned[:, f], bend, len(cut) + 1))[:-1]
        held = np.cumsum(np.bincount(binned[:, f], minlength=len(cut) + 1))[:-1]
        left = np.clip(up / (down + ridge), low, high)
        right = np.clip((total - up) / (weight - down + ridge), low, high)
        # What the second-order loss falls by with these values.
        gain = left * up - left**2 * (down + ridge) / 2 + right * (total - up) - right**2 * (weight - down + ridge) / 2
        whole = np.clip(total / (weight + ridge), low, high)
        gain = gain - (whole * total - whole**2 * (weight + ridge) / 2)
        allowed = (held >= 5) & (len(binned) - held >= 5)
        if signs[f]:
            allowed &= (right - left) * signs[f] >= 0
        gain = np.where(allowed, gain, -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, found = gain[b], (f, b, left[b], right[b])
    return found


def known_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, ``label`` and statistics to learn from: one row for each of about ``bound`` ids at most.

    Of several rows of one id that with the least statistics counts. Null ids take no part.
    """
    sample = labelled(labels, fold(5) == 0, bound)
    # The bound proves the sample small.
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    names = list(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            features = statistics(table.column("text"))[1]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("label").combine_chunks(), *map(pa.array, features.T)], ["doc_id", "label", *names])

    schema = ", ".join(["doc_id bigint", "label int", *(f"{n} double" for n in names)])
    rows = texts.mapInArrow(measure, schema).select("doc_id", "label", F.struct(*names).alias("features"))
    return one_each(rows, ["doc_id", "label"], "features").select("doc_id", "label", "features.*")


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on about ``bound`` labelled documents at most, one row of each; fold 0 of five is never learned from.

    Without labels of both kinds the trees say the labels' smoothed share; an empty table is one without labels.
    """
    names = list(FEATURES)
    rows = known_rows(docs, labels, bound).toPandas().sort_values("doc_id")
    return fit(rows[names].to_numpy(float), rows["label"].to_numpy(float), list(FEATURES.values()))


def judged(docs: DataFrame, trees: Trees) -> DataFrame:
    """All columns of ``docs`` but the text as struct ``row``, ``text``, the five counts, ``base_failed``, ``score``, ``kept``.

    Words are runs of bytes other than ASCII white space. ``word_chars`` counts
    code points in words, ``n_symbols`` the characters of ``SYMBOLS``,
    ``n_dup_lines`` lines with a word that equal an earlier line, ``n_repeat_words`` words in
    three-word windows that the text holds twice or more. The base rules fail
    texts of under ``LEAST_WORDS`` words or with over ``REPEAT_PERCENT`` percent of repeated
    words; of the others those are kept that the trees score at ``KEEP_FROM`` or
    more. A null or empty text has no words, so it fails. Every whole text is
    read. Null ids, repeated rows and further columns are passed on; an empty table
    gives an empty result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            counts, features = statistics(table.column("text"))
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
            score = trees.score(features)
            arrays = [pa.array(counts[name], pa.int64()) for name in COUNTS]
            arrays += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_FROM))]
            yield pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), table.column("text").combine_chunks(), *arrays], schema.names)

    rows = docs.select(F.struct(*names([c for c in docs.columns if c != "text"])).alias("row"), F.col("text").cast("string").alias("text"))
    kinds = [T.StructField(name, T.LongType()) for name in COUNTS]
    kinds += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([rows.schema["row"], rows.schema["text"], *kinds])
    return rows.mapInArrow(judge, schema)


def passed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    rows = judged(docs, learn(docs, labels)).where("kept")
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
