"""Divergence of sources against plain counting with Python's whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import divergence as module
from gleaner.llm.divergence import divergence, shares
from gleaner.llm.queries import QUERIES
from gleaner.llm.transducer import Vocabulary, transducer

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least: int = 30, top: int = 50) -> list[tuple]:
    """``rows``: (text, lang, source)."""
    docs = [(TERM.findall((text or "").translate(LOWER)), lang or "", source or "") for text, lang, source in rows]
    held: dict = defaultdict(Counter)
    count: dict = defaultdict(Counter)
    for terms, lang, source in docs:
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {lang for _, lang, _ in docs}:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=str.encode)
        sources = sorted({s for _, own, s in docs if own == lang}, key=str.encode)
        table = {s: [count[lang, s][t] for t in kept] for s in sources}
        whole = [sum(c) for c in zip(*table.values(), strict=True)]

        def share(counts, size=len(kept)):
            return [1 + 10**9 * (c + 5) // (sum(counts) + 5 * size) for c in counts]

        p, q = {s: share(c) for s, c in table.items()}, share(whole)
        for s in sources:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -f, k) for k, (f, _, o) in enumerate(pairs, 1)]
            terms = sorted((b - a, t.encode(), t) for a, b, c, t in zip(p[s], q, table[s], kept, strict=True) if c and a > b)
            out += [(lang, s, "term", t, -f, k) for k, (f, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def got(frame) -> list[tuple]:
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in frame.collect())


def test_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expect = brute(rows)
    assert any(r[2] == "term" for r in expect)
    assert got(QUERIES["op13_source_divergence"](spark, folder)) == expect


@pytest.mark.parametrize(("volume", "passes", "cells"), [(1 << 16, 1 << 20, 1 << 21), (3, 1 << 20, 8), (4, 5, 40)])
def test_ranges_and_passes_of_any_size_give_the_same(spark, monkeypatch, volume, passes, cells):
    monkeypatch.setattr(module, "VOLUME", volume)
    monkeypatch.setattr(module, "PASS_TERMS", passes)
    monkeypatch.setattr(module, "CELLS", cells)
    draw = random.Random(volume)
    # Long common beginnings, so that volumes begin with the same eight bytes; ties everywhere.
    known = ["gleichgleich" + a + b for a in ("", "a", "ß", "日") for b in ("", "x", "xy", "日本")] + ["A", "b", "É", "é"]
    rows = [(", ".join(draw.choices(known, k=draw.randrange(12))), draw.choice(["de", "fr", None]), draw.choice(["s", "t", "", None, "日"])) for _ in range(150)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert got(divergence(frame, 4, 3)) == brute(rows, 4, 3)


def test_edge_rows(spark):
    long = "Wort " * 200_000 + "x" * 100_000
    rows = [(None, None, None), ("", "", ""), ("1 2 3", "en", "only"), ("a a b", "de", "s"), ("a a b", "de", "s"), ("A", "de", "t"), (long, "de", "t"), ("x" * 100_000, "de", "u"), ("b", None, "s")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, index int, term string")
    assert got(divergence(frame, 2)) == brute(rows, 2)
    assert got(divergence(frame, 100)) == brute(rows, 100)
    assert divergence(frame.limit(0)).count() == 0


def test_a_third_of_all_rows_in_one_source(spark):
    rows = [(f"w{chr(97 + k % 20)} common", "en", "hot" if k % 3 else f"s{k % 9}") for k in range(1200)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert got(divergence(frame)) == brute(rows)


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([[5, 10**15 + 5], [7, 3 * 10**16]])
    totals = np.array([[10**16 + 11], [10**17 + 3]])
    assert shares(counts, totals).tolist() == [[1 + 10**9 * int(c) // int(t) for c in row] for row, (t,) in zip(counts, totals, strict=True)]


def minimal_states(terms: list[bytes]) -> int:
    """Different sets of what may follow a beginning: as many states as any minimal automaton has."""
    ways = {t[:k] for t in terms for k in range(len(t) + 1)}
    return len({frozenset(t[len(w) :] for t in terms if t.startswith(w)) for w in ways})


@pytest.mark.parametrize("seed", range(5))
def test_transducers_are_minimal_and_ordinals_exact(seed):
    draw = random.Random(seed)
    terms = sorted({"".join(draw.choices("abé", k=draw.randrange(1, 7))).encode() for _ in range(60)})
    made = transducer(terms)
    assert len(made.final) == minimal_states(terms)
    parts = [terms[:20], terms[20:21], terms[21:]]
    opening = [0, 20, 21]
    volumes = Vocabulary([("g", first, int.from_bytes(part[0][:8].ljust(8, b"\0"), "big"), transducer(part)) for first, part in zip(opening, parts, strict=True)])
    asked = terms + [t + b"a" for t in terms] + [t[:-1] for t in terms if len(t) > 1] + [b"zz", b"A"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(t) for t in asked])
    place = {t: k for k, t in enumerate(terms)}
    assert volumes.ordinals("g", data, ends - [len(t) for t in asked], ends).tolist() == [place.get(t, -1) for t in asked]
    assert set(volumes.ordinals("other", data, ends - [len(t) for t in asked], ends).tolist()) == {-1}
