"""Near-duplicate vectors against all cosines."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from gleaner.llm.queries import QUERIES
from gleaner.llm.vectors import Tile, links, near_vectors


def brute(rows, least: float = 0.93) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        width = max(len(a), len(b))
        a, b = np.pad(a, (0, width - len(a))), np.pad(b, (0, width - len(b)))
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)))

    def takes_part(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    near = [[] for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            _, w, other = rows[j]
            if takes_part(v, label) and takes_part(w, other) and label == other and cosine(v, w) >= least:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = [k for k in near[todo.pop()] if k not in seen]
            seen.update(fresh)
            todo += fresh
        smallest = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((own, len(near[i]), smallest, own == smallest))
    return sorted(out, key=str)


def got(frame) -> list[tuple]:
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect()), key=str)


def test_all_vectors(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = QUERIES["op11_embedding_near_duplicates"](spark, folder)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got(found) == brute(rows)


@pytest.mark.parametrize("tile", [2, 7, 1000])
def test_tiles_of_any_size_give_the_same(spark, tile):
    draw = np.random.default_rng(tile)
    centres = draw.normal(size=(6, 5))
    # Around the threshold on purpose: many pairs the 8-bit product cannot settle.
    rows = [(int(k) - 40, (centres[k % 6] + draw.normal(0, 0.25, 5)).tolist(), int(k % 2)) for k in range(120)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    assert got(near_vectors(frame, tile=tile)) == brute(rows)


def test_bounds_settle_most_pairs_and_lose_none():
    draw = np.random.default_rng(0)
    exact = draw.normal(size=(600, 64))
    exact[300:] = exact[:300] + draw.normal(0, 0.4, (300, 64))
    tile = Tile(np.arange(600), np.ones(600, np.int64), exact)
    counted: list[int] = []
    found = links(tile, tile, 0.93, counted)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    assert (found == (unit @ unit.T >= 0.93)).all() and found.sum() > 700
    assert 0 < sum(counted) < 2000
    error = tile.error[:, None] + tile.length * tile.error
    assert (np.abs(unit @ unit.T - (tile.q.astype(float) @ tile.q.T.astype(float)) * np.outer(tile.scale, tile.scale)) <= error.T + 1e-12).all()


def test_a_large_group_of_copies_is_one_vector(spark):
    near = [(k, [1.0, 0.0, 0.001 * (k % 7)], 1) for k in range(3000)]
    rows = near + [(k, [0.0, 1.0, 0.0], 1) for k in range(5000, 5003)] + [(7000, [1.0, 0.0, 0.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame, tile=2).collect()}
    assert len(found) == len(rows)
    assert all(found[k] == (2999, 0, k == 0) for k in range(3000))
    assert found[5001] == (2, 5000, False) and found[7000] == (0, 7000, True)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0], None), (4, [1.0, 2.0], 2), (5, None, 1), (6, [], 1), (7, [0.0, -0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (None, [1.0, 2.0], 1), (None, [-1.0, 0.0], 3), (None, [-1.0, 0.0], 3), (11, [3e38, 3e38], 4),
        (12, [1e-44, 1e-44], 4), (13, [1.0], 5), (14, [1.0, 0.0], 5), (15, [1.0, -0.0], 5), (None, None, None),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, rep string, n_links int")
    assert got(near_vectors(frame)) == brute(rows)
    assert near_vectors(frame.limit(0)).count() == 0


def test_chains_over_tiles_are_one_component(spark):
    angles = [0.3 * k for k in range(20)]
    rows = [(k, [math.cos(a), math.sin(a)], 0) for k, a in enumerate(angles)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert got(near_vectors(frame, tile=3)) == brute(rows)
