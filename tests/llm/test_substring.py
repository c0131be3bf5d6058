"""Removal of passages that repeat across documents, against a plain reading of the definition."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from gleaner.llm import substring, text
from gleaner.llm.queries import QUERIES
from gleaner.llm.substring import later_windows, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs: list[tuple], size: int = 13) -> list[tuple]:
    """(id, words, removed, kept) of (id, text) rows."""
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    held: dict[tuple, list] = {}
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            held.setdefault(tuple(ws[k : k + size]), []).append(float("inf") if i is None else i)
    out = []
    for i, ws in split:
        own, gone = float("inf") if i is None else i, set()
        for k in range(len(ws) - size + 1):
            if min(held[tuple(ws[k : k + size])]) < own:
                gone.update(range(k, k + size))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def got(frame) -> list[tuple]:
    return [(r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in frame.collect()]


def test_all_documents_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expect = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(docs)}
    rows = QUERIES["op3_substring_dedup"](spark, folder).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == expect and len(rows) == len(docs)
    assert sum(gone for _, gone, _ in expect.values()) > 0


@pytest.mark.parametrize("block", [64, 2 << 20])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(text, "BLOCK", block)
    monkeypatch.setattr(substring, "text_blocks", lambda batches: text.text_blocks(batches, size=block))
    draw = random.Random(5)
    shared = [[draw.choice("abcdefgé") * draw.randrange(1, 4) for _ in range(draw.randrange(10, 60))] for _ in range(6)]
    docs = []
    for i in range(60):
        ws = []
        for _ in range(draw.randrange(4)):
            ws += draw.choice(shared)
            ws += [draw.choice("xyz") for _ in range(draw.randrange(30))]
        docs.append((i, draw.choice([" ", "\n", " \t "]).join(ws) + draw.choice(["", " "])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert sorted(got(without_repeats(frame))) == sorted(brute(docs))


def test_equal_hashes_of_different_words_are_told_apart():
    words = [b"a%d" % k for k in range(6)] * 2
    data = b" ".join(words)
    array = np.frombuffer(data, np.uint8)
    starts, ends, _ = text.words(array, np.array([0, len(data)]))
    first = np.arange(len(starts) - 1)
    # Hash every word alike: only the bytes can tell.
    flags = later_windows(data, starts, ends, np.zeros(len(starts), np.uint64), first, np.arange(len(first)), 2)
    assert flags.tolist() == [False] * 6 + [True] * 5


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(40000))
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [
        (1, None), (2, ""), (3, "short one"), (4, passage), (4, passage), (5, passage + " end"), (None, "before " + passage),
        (None, long), (6, long), (7, "x " * 500), (8, "x " * 14), (9, passage.replace(" ", " ")), (10, passage.replace(" ", "\n \t")),
    ]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, begin int, row_key int")
    rows = without_repeats(frame)
    assert sorted(got(rows), key=str) == sorted(brute(docs), key=str)
    assert rows.select("row.begin", "row.row_key").distinct().collect() == [(1, 2)]
    assert without_repeats(frame.limit(0)).count() == 0


def test_windows_around_a_frequent_gram_are_many_buckets(spark, monkeypatch):
    """A line in all documents between words of their own: the windows over its edges differ and have few minimisers."""
    draw = random.Random(11)
    own = lambda n: [f"w{draw.getrandbits(30)}" for _ in range(n)]
    # Of many lines the one whose hash is the least, so that most windows over it have it as their minimiser.
    lines = [" ".join(own(3)) for _ in range(5000)]
    data, offsets = text.flat(pa.array(lines))
    hashes = text.word_hashes(data, *text.words(data, offsets)[:2])
    line = lines[int(np.argmin(text.runs(hashes, 3)[::3]))]
    rows = [(i, " ".join([*own(10), line, *own(10)])) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(0, 3000, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1 << 16)
    assert sorted(got(without_repeats(docs))) == sorted(brute(rows))

    def loads(table, size, buckets):
        """In place of the ranges: a bucket and the bytes that came to it."""
        blobs = [zstandard.ZstdDecompressor().decompress(b) for b in table.column("blob").to_pylist()]
        held = {"row_id": [table.column("bucket")[0].as_py()], "row_key": [sum(map(len, blobs))], "begin": [0], "end": [0]}
        return pa.table({name: pa.array(column, pa.int64()) for name, column in held.items()})

    monkeypatch.setattr(substring, "_settled", loads)
    sizes = sorted(r.row_key for r in substring.repeated_ranges(docs, substring._row(docs)).collect())
    assert sizes[-1] < 4 * sizes[len(sizes) // 2], sizes
