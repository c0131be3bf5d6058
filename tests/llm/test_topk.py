"""Exact top-k against all products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from gleaner.llm import topk
from gleaner.llm.queries import QUERIES
from gleaner.llm.topk import scan, top_products


def brute(rows, every: int = 20, top: int = 20) -> list[tuple]:
    """Every row is a vector of its own; whole numbers of any size."""
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, own) in enumerate(vectors):
        if q % every == 0:
            scores = sorted((-max(min(sum(a * b for a, b in zip(own, v, strict=False)), 2**63 - 1), 1 - 2**63), i) for k, (i, v) in enumerate(vectors) if k != place)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:top], 1)]
    return sorted(out)


def test_all_vectors(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op5_exact_top_k"](spark, folder).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("block", [3, 50])
def test_files_of_any_size_give_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "FILES", 2)
    draw = random.Random(block)
    # Few different values, so ties are everywhere.
    rows = [(k, [draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(draw.randrange(1, 6))]) for k in range(-40, 100)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    assert sorted(tuple(r) for r in top_products(frame, 5, 7).collect()) == brute(rows, 5, 7)


def test_few_exact_vectors_are_read():
    draw = np.random.default_rng(0)
    exact = np.floor(draw.normal(0, 8, (4000, 64))).astype(np.int32)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                read.append(len(key))
            return super().__getitem__(key)

    import pyarrow as pa

    table = pa.table({"block": pa.array([0] * 4000), "vec_id": pa.array(range(4000)), "row": pa.array(range(4000)), "v": pa.array(exact.tolist(), pa.list_(pa.int32()))})
    file = topk._read(topk._file(table).to_pylist()[0])
    queries = {"ids": np.array([-1]), "rows": np.array([-1]), "exact": exact[:1]}
    (ids, scores), = scan(queries, iter([file]), 10)
    every = exact.astype(np.int64) @ exact[0].astype(np.int64)
    assert ids.tolist() == np.lexsort((np.arange(4000), -every))[:10].tolist() and scores.tolist() == sorted(every.tolist(), reverse=True)[:10]


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [0.5]), (40, []), (60, None), (80, [nan]), (100, [inf, 1.0]), (None, [1.0]), (1, [1.0, None]), (2, [1e7, -1e7]), (20, [1e7, 1e7]),
        (3, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 1.0]), (0, [1.0, 2.0]), (5, [1e7, 3e16]),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, block int, score int")
    assert sorted(tuple(r) for r in top_products(frame).collect()) == brute(rows)
    assert top_products(frame.limit(0)).count() == 0


def test_rows_of_one_id_and_large_components_count_in_full(spark):
    rows = [(0, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [2.0, 3.0]), (0, [4.0, 4.0]), (7, [1e7, 0.0]), (20, [1e7, 0.0]), (9, [1e16, -3.0]), (40, [3e12, 7.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_products(frame).collect())
    assert got == brute(rows)
    assert (20, 2, 7, 640000000 * 640000000) in got or any(r[0] == 20 and r[2] == 7 and r[3] == 640000000 * 640000000 for r in got)
