"""Exact top-k search by inner product over vector-approximation files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.session import stored

TOP = 20
CELLS = 16  # cells of a dimension: four bits each
BLOCK = 2048  # vectors of a file; queries of a block
FILES = 8  # files that one task scans for one block of queries
FIRST = 64  # exact vectors read before the first look at the bounds
_MOST = (1 << 63) - 1  # a score beyond 64 bits is held at this


def whole_components(column: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as 64-bit whole numbers."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale))


def usable(column: Column) -> Column:
    """Neither null nor with a component that is null, infinite or no number."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    lists = table.column("v").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(int(lengths.max(initial=0)), 1)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _file(table: pa.Table) -> pa.Table:
    """One file: ids, row numbers, exact vectors (of 32 bits where these do), their cells and the cells' edges."""
    exact = _matrix(table)
    low, high = exact.min(axis=0), exact.max(axis=0)
    # Cell c of a dimension goes from edge c to before edge c + 1.
    span = high // CELLS - low // CELLS + 1
    edges = low + np.arange(CELLS + 1)[:, None] * np.minimum(span, (_MOST - np.maximum(low, 0)) // CELLS)
    edges[-1] = np.maximum(edges[-1], np.minimum(high, _MOST - 1) + 1)
    narrow = bool(len(exact)) and -(1 << 31) <= low.min() and high.max() < 1 << 31
    cells = np.empty(exact.shape, np.uint8)
    for d in range(exact.shape[1]):
        cells[:, d] = np.searchsorted(edges[1:-1, d], exact[:, d], "right")
    parts = {"ids": table.column("vec_id").to_numpy(), "rows": table.column("row").to_numpy(), "exact": exact.astype(np.int32) if narrow else exact, "cells": cells, "edges": edges}
    return pa.table({"block": table.column("block").slice(0, 1), "width": pa.array([exact.shape[1]], pa.int32()), "bits": pa.array([32 if narrow else 64], pa.int32()), **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in parts.items()}})


_FILE = "block bigint, width int, bits int, ids binary, rows binary, exact binary, cells binary, edges binary"


def _read(row: dict) -> dict:
    width = row["width"]
    return {
        "ids": np.frombuffer(row["ids"], np.int64),
        "rows": np.frombuffer(row["rows"], np.int64),
        "exact": np.frombuffer(row["exact"], np.int32 if row["bits"] == 32 else np.int64).reshape(-1, width),
        "cells": np.frombuffer(row["cells"], np.uint8).reshape(-1, width),
        "edges": np.frombuffer(row["edges"], np.int64).reshape(-1, width),
    }


def _wide(values: np.ndarray, width: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, width - values.shape[1]))) if values.shape[1] < width else values


def _products(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; ``largest`` bounds them. Where sums may leave 64 bits, Python's whole numbers are used."""
    if largest < 2.0**62:
        return x @ q
    sums = (sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist())
    return np.array([max(-_MOST, min(_MOST, total)) for total in sums], np.int64)


def scan(queries: dict, files: Iterator[dict], top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of each query's best, over all files.

    A file's cells give an upper bound of every score. Exact vectors are read in
    the order of their bounds until the next bound is below the last score held; a
    bound that equals it may still win by its smaller id, so it is read.
    """
    count = len(queries["ids"])
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * count
    for file in files:
        width = max(queries["exact"].shape[1], file["exact"].shape[1])
        q, x = _wide(queries["exact"], width).astype(np.int64), _wide(file["exact"], width).astype(np.int64)
        edges, cells = _wide(file["edges"], width), _wide(file["cells"], width)
        low = np.take_along_axis(edges, cells.astype(np.int64), axis=0).astype(float)
        high = np.take_along_axis(edges, cells.astype(np.int64) + 1, axis=0).astype(float) - 1
        if file["exact"].shape[1] < width:
            high[:, file["exact"].shape[1] :] = 0
        largest = float(np.abs(q.astype(float)).max(initial=0)) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * width
        if largest < 2.0**52:
            bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        else:  # sums that a float cannot hold exactly bound nothing
            bounds = np.full((count, len(x)), np.inf)
        for k in range(count):
            ids, scores = best[k]
            bound = bounds[k]
            own = file["rows"] != queries["rows"][k]
            floor = scores[top - 1] if len(scores) >= top else -np.inf
            order = np.flatnonzero((bound >= floor) & own)
            order = order[np.argsort(-bound[order], kind="stable")]
            at, step = 0, FIRST
            while at < len(order) and (len(scores) < top or bound[order[at]] >= scores[top - 1]):
                part = order[at : at + step]
                ids = np.concatenate((ids, file["ids"][part]))
                scores = np.concatenate((scores, _products(x[part], q[k], largest)))
                kept = np.lexsort((ids, -scores))[:top]
                ids, scores = ids[kept], scores[kept]
                at, step = at + step, step * 2
            best[k] = ids, scores
    return best


def top_products(vectors: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``top`` largest integer inner products.

    ``vectors`` has ``vec_id`` and ``embedding``. Components become floor(64 * x). Queries are the
    rows whose id is divisible by ``every``; candidates all rows but the query's own;
    ties go to the smaller id; a query with fewer candidates gets all. Vectors that are null or
    hold a null or non-finite component take no part, nor do null ids. A shorter vector
    ends in zeros. Rows of one id are vectors of their own: each is a candidate of all others, and each that asks gets its
    own ranks. Sums are exact whatever their size; a score that leaves 64 bits is held at their end. An empty table gives an empty result; other columns are not read.

    Vectors are dealt by a hash of their row's number into files of about ``BLOCK``. Each block of
    queries scans every file, ``FILES`` of them in one task that carries its best
    scores along; at most ``top`` rows per query and task go on to the final ranking.
    """
    valid = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # Written once, so that a row keeps its number.
    rows = stored(valid.select(F.col("vec_id").cast("bigint"), whole_components(F.col("embedding")).alias("v"), F.monotonically_increasing_id().alias("row")))
    asked = rows.where(F.col("vec_id") % every == 0)
    files, blocks = max(1, math.ceil(rows.count() / BLOCK)), max(1, math.ceil(asked.count() / BLOCK))
    groups = math.ceil(files / FILES)

    def dealt(frame: DataFrame, parts: int) -> DataFrame:
        return stored(frame.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(parts))).groupBy("block").applyInArrow(_file, _FILE))

    def answer(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        for row in queries.to_pylist():
            block = _read(row)
            # Block by block, so bounds of one file are held at a time.
            best = scan(block, (_read(c) for c in candidates.to_pylist()), top)
            for query, number, (ids, scores) in zip(block["ids"], block["rows"], best, strict=True):
                found["query_id"].append(np.full(len(ids), query))
                found["query_row"].append(np.full(len(ids), number))
                found["vec_id"].append(ids)
                found["score"].append(scores)
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()})

    # Every block of queries meets every group of files once.
    left = dealt(asked, blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = dealt(rows, files).withColumn("part", (F.col("block") % groups).cast("int")).withColumn("asked", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    pairs = left.groupBy("block", "part").cogroup(right.groupBy("asked", "part")).applyInArrow(answer, "query_id bigint, query_row bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
