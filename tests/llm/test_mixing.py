"""Targets against a plain computation; the cube method's balance, expectation and repeatability."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from gleaner.llm import mixing
from gleaner.llm.mixing import Flight, mixed, mixture
from gleaner.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(rows, sizes_of: dict, slack: int) -> None:
    sizes, taken = defaultdict(int), defaultdict(int)
    target = {}
    for source, r in rows:
        sizes[source] += r.size
        taken[source] += r.size * r.copies
        target[source] = r.target
        assert 0 <= r.copies <= 2
    expect = brute_targets(sizes)
    assert all(r.source_size == sizes[s] for s, r in rows)
    for s in sizes:
        assert target[s] == pytest.approx(expect[s])
        assert abs(taken[s] - expect[s]) <= slack


def test_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()}
    rows = mixed(docs).collect()
    assert len(rows) == len(texts) and all(r.size == texts[r.doc_id][1] for r in rows)
    # What is left of a source's balance is at most about one document.
    check([(texts[r.doc_id][0], r) for r in rows], {}, max(n for _, n in texts.values()))
    query = {r.doc_id: r.taken for r in QUERIES["op10_mixing"](spark, folder).collect()}
    assert query == {r.doc_id: r.size * r.copies for r in rows}


@pytest.mark.parametrize("units", [7, 2000])
def test_sources_of_many_blocks_stay_balanced(spark, monkeypatch, units):
    monkeypatch.setattr(mixing, "BLOCK_UNITS", units)
    monkeypatch.setattr(mixing, "MEET", 3)
    draw = random.Random(units)
    rows = [(k, "w " * draw.randrange(0, 60), draw.choice(["a", "a", "a", "b", None, "ä", ""])) for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = mixed(frame).collect()
    check([(rows[r.doc_id][2], r) for r in got], {}, 60)
    again = {r.doc_id: r.copies for r in mixed(frame.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_flight_keeps_sums_and_expectations():
    draw = random.Random(9)
    units = [(k, draw.random(), draw.randrange(1, 50)) for k in range(30)]
    hits = [0.0] * 30
    for seed in range(3000):
        flight = Flight(seed)
        settled = [u for unit in units for u in flight.add(*unit)]
        out = settled + flight.rest(False)
        assert len(flight.held) <= 2 and all(u[1] in (0.0, 1.0) for u in settled)
        assert sum(u[1] for u in out) == pytest.approx(sum(u[1] for u in units))
        assert sum(u[1] * u[2] for u in out) == pytest.approx(sum(u[1] * u[2] for u in units))
        for key, chance, _ in out:
            hits[key] += chance
    assert all(abs(h / 3000 - p) < 0.05 for h, (_, p, _) in zip(hits, units, strict=True))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", None), (None, "x y", "b"), (3, "w " * 30000, "b"), (4, "p q", "c"), (4, "p q", "c")]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id bigint, text string, source string, size int, copies int")
    got = mixed(frame).collect()
    assert len(got) == len(rows) and sum(r.size == 0 for r in got) == 2
    mix = mixture(frame)
    assert mix.columns == frame.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mix.collect()) == sum(r.size * r.copies for r in got)
    assert mixed(frame.limit(0)).count() == 0 and mixture(frame.limit(0)).count() == 0
    # One source of empty texts: nothing to take.
    empty = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixed(empty).collect()] == [(0, 0.0, 0)]


def test_small_sources_come_within_a_short_document_of_their_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    by_source = defaultdict(list)
    for r in mixed(docs).collect():
        by_source[source[r.doc_id]].append(r)
    for name, rows in by_source.items():
        middle = sorted(r.size for r in rows)[len(rows) // 2]
        assert abs(sum(r.size * r.copies for r in rows) - rows[0].target) <= middle, name


def test_columns_of_any_name_and_type_pass(spark):
    docs = spark.createDataFrame([(k // 2, "one two three", "s", {"k": "v"}, 1.0) for k in range(20)], "doc_id bigint, text string, source string, m map<string,string>, `a.b` double")
    mix = mixture(docs)
    assert mix.columns == docs.columns
    assert abs(mix.count() - 30) <= 1 and {r["a.b"] for r in mix.collect()} == {1.0}
