"""Counts against a plain reading of the definition; trees against their constraints and held-out labels."""

from __future__ import annotations

import re
import zlib

import numpy as np

from gleaner.llm.quality_rules import FEATURES, fit, judged, known_rows, learn, passed
from gleaner.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows: dict = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeat = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(repeat) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed


def test_counts_and_verdicts_of_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    assert np.mean([r.kept == labels[r.doc_id] for r in held]) > 0.95


def test_signed_features_are_monotonic():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 4))
    y = ((x[:, 0] + np.sin(9 * x[:, 1]) / 4 + draw.normal(0, 0.2, 3000)) < 0.6).astype(float)
    trees = fit(x, y, [-1, 0, 1, 0])
    base = draw.random((200, 4))
    for feature, sign in ((0, -1), (2, 1)):
        steps = []
        for value in np.linspace(0, 1, 40):
            moved = base.copy()
            moved[:, feature] = value
            steps.append(trees.score(moved))
        assert (np.diff(np.array(steps), axis=0) * sign >= -1e-12).all()
    assert np.mean((trees.score(x) > 0.5) == y) > 0.75
    # The node arrays against a walk row by row.
    for row in base[:20]:
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - trees.score(row[None])[0]) < 1e-12


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, "a b c " * 40), (None, long), (4, long), (4, long), (5, "é x \x1c y"), (6, "l x\nl x\n\n \nl x\r\nl x")]
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id bigint, text string, score int, kept boolean")
    labels = spark.createDataFrame([(4, 1), (4, 0), (1, None), (None, 1), (3, 7)], "doc_id bigint, quality int")
    none = learn(frame, labels.limit(0))
    got = judged(frame, none).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
    assert len(got) == len(rows) and len(none.value) == 0
    assert learn(frame, labels).base < 0
    kept = passed(frame, labels.limit(0))
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "None"]
    assert judged(frame.limit(0), none).count() == 0
    assert len(FEATURES) == 10


def test_an_id_with_many_rows_counts_once(spark):
    """A third of all rows on one id: one row of it is learned from, and reaches the driver."""
    frame = spark.createDataFrame([(k, f"word{k % 7} and # {k} more\n" * (1 + k % 9)) for k in range(600)], "doc_id bigint, text string")
    hot = frame.unionByName(frame.where("doc_id = 5").crossJoin(spark.range(300)).select("doc_id", "text")).repartition(8)
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id bigint, quality int")
    assert sorted(map(tuple, known_rows(hot, labels).collect())) == sorted(map(tuple, known_rows(frame, labels).collect()))
    one, other = learn(hot, labels), learn(frame, labels)
    assert one.base == other.base and (one.value == other.value).all()
