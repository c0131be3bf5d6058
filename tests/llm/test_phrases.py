"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import phrases
from gleaner.llm.phrases import collocations, locally_frequent
from gleaner.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support: int = 30, reported: int = 2000) -> list[tuple]:
    """``rows``: (text, lang)."""
    f: dict = defaultdict(Counter)
    n: Counter = Counter()
    for text, lang in rows:
        own = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[own] += len(ws)
            for size in range(1, 5):
                f[own].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        covered = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * counts[p[i:j]]}
        rated = []
        for p, a in candidates.items():
            if p in covered:
                continue
            score, _, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, _, p, left, right) in enumerate(sorted(rated)[:reported], 1):
            out.append((lang, rank, p, -a, left, right, n[lang], -score))
    return sorted(out)


def got(frame) -> list[tuple]:
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in frame.collect())


def test_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expect = brute(rows)
    assert len(expect) >= 50
    assert got(QUERIES["op12_collocations"](spark, folder)) == expect


@pytest.mark.parametrize(("shards", "block", "held", "marks"), [(1, 1 << 20, 10**6, 27), (3, 200, 50, 27), (7, 1000, 10, 8)])
def test_shards_blocks_and_tables_of_any_size_give_the_same(spark, monkeypatch, shards, block, held, marks):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "MARK_BITS", marks)
    draw = random.Random(shards)
    known = ["Alpha", "beta", "gamma,", "delta.", "é", "É\x0b", " ", "x!y", "\x1f"]
    rows = [(" ".join(draw.choices(known, k=draw.randrange(30))), draw.choice(["de", "fr", None, "und", ""])) for _ in range(120)]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(9)
    assert got(collocations(frame, 7, shards, 40)) == brute(rows, 7, 40)


def test_a_shard_marks_what_it_holds_often_and_little_else(spark):
    rows = [(f"common pair u{k} v{k} w{k}", "en") for k in range(400)]
    frame = spark.createDataFrame(rows, "text string, lang string").select("lang", "text").repartition(10)
    marks = np.unpackbits(locally_frequent(frame, 4))
    # Two words and their pair; the words that stand once in a shard are not marked.
    assert marks.sum() == 3


def test_edge_rows(spark):
    long = "eins zwei drei vier " * 30_000 + "y" * 50_000
    rows = [(None, None), ("", "de"), (" \t . ,", "de"), ("a b a b a b", "de"), ("a b a b a b", "de"), ("A\tb", "de"), (long, "fr"), ("a b", None), ("a b", "und"), ("a.b", "und")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, size int, f int")
    assert got(collocations(frame, 2)) == brute(rows, 2)
    assert got(collocations(frame, 10**6)) == []
    assert collocations(frame.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    counts = [("en", 0, "", 10**18), ("en", 1, "a", 9 * 10**15), ("en", 1, "b", 7 * 10**15 + 1), ("en", 2, "a b", 6 * 10**15 + 7)]
    frame = spark.createDataFrame(counts, "lang string, size int, phrase string, f bigint")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: frame)
    (row,) = collocations(frame).collect()
    assert row.score == 2000000 * (6 * 10**15 + 7) // (16 * 10**15 + 1)


def test_a_block_is_counted_within_bounded_memory():
    import tracemalloc

    words = np.random.default_rng(3).integers(0, 4000, 400_000)
    text = " ".join(f"word{w}" for w in words)
    table = pa.table({"text": [text], "lang": ["en"]})
    marks = np.full(1 << phrases.MARK_BITS - 3, 255, np.uint8)
    tracemalloc.start()
    try:
        rows = sum(len(counts) for _, _, _, counts in phrases._counts(phrases.Words(table), marks))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 1_000_000 and peak < 45 * len(text)
