"""Extendible hashing against splitting bucket by bucket."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from gleaner.llm import sharding
from gleaner.llm.sharding import sharded


def digits(key) -> int:
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def brute(rows: list[tuple], limit: int) -> dict:
    """Shard of every key, splitting oversized buckets one bit at a time."""
    done = {}

    def split(bits: str, members: list[tuple]) -> None:
        if sum(n for _, n in members) <= limit or len({digits(k) for k, _ in members}) == 1:
            done.update({k: bits for k, _ in members})
            return
        for bit in "01":
            split(bits + bit, [m for m in members if format(digits(m[0]), "060b")[len(bits)] == bit])

    if rows:
        split("", rows)
    return done


@pytest.mark.parametrize("limit", [40, 300, 10**6])
def test_splits_only_what_is_too_large(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding, "_AHEAD", 1)  # several rounds
    draw = random.Random(limit)
    rows = [(k, "x" * draw.choice([0, 3, 20, 35, 90])) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sharded(frame, limit).collect()
    expect = brute([(k, len(t)) for k, t in rows], limit)
    assert {r.doc_id: r.shard for r in got} == expect and len(got) == len(rows)
    sums, counts = defaultdict(int), defaultdict(int)
    for r in got:
        sums[r.shard] += r.n_bytes
        counts[r.shard] += 1
    assert all(r.page == 0 and r.shard_bytes == sums[r.shard] and r.shard_docs == counts[r.shard] for r in got)
    assert all(total <= limit or counts[s] == 1 for s, total in sums.items())


def test_a_hot_key_is_paged(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_SLICE_DOCS", 20)
    draw = random.Random(1)
    rows = [(7, "y" * draw.randrange(1, 60)) for _ in range(200)] + [(k, "z" * 10) for k in range(100, 150)]
    got = sharded(spark.createDataFrame(rows, "doc_id bigint, text string"), 100).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in got) == sorted((k, len(t)) for k, t in rows)
    pages = defaultdict(list)
    for r in got:
        pages[r.shard, r.page].append(r)
    assert all(sum(r.n_bytes for r in page) <= 100 and {(r.shard_bytes, r.shard_docs) for r in page} == {(sum(r.n_bytes for r in page), len(page))} for page in pages.values())
    assert len({r.page for r in got if r.doc_id == 7}) > 40


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (3, "é" * 50), (4, "w" * 100000)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, hash int, page int")
    got = {(r.doc_id, r.n_bytes): r for r in sharded(frame, 120).collect()}
    assert set(got) == {(1, 0), (2, 0), (None, 5), (3, 100), (4, 100000)}
    assert got[4, 100000].shard_docs == 1 and got[3, 100].shard_bytes <= 120
    assert sharded(frame).count() == len(rows) and sharded(frame.limit(0)).count() == 0
