"""Revisits against a walk through the records in order of time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import revisits
from gleaner.llm.revisits import NOT_MERGED, canonical_url, resolved

SCHEMA = "record_id bigint, url string, ts bigint, revisit boolean, headers map<string,string>, body_digest string, body_length bigint, near int, end int"


def brute(rows: list[tuple], key) -> list[tuple]:
    out = []
    for i, url, ts, revisit, headers, *_ in rows:
        if not revisit:
            continue
        headers = headers or {}
        earlier = [r for r in rows if not r[3] and ts is not None and r[2] is not None and r[2] < ts and key(url) is not None and key(r[1]) == key(url)]
        hit = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if hit is None:
            out.append((i, "no response", None, None, None))
            continue
        stored = hit[4] or {}
        state = "unverified"
        for name, clean in (("etag", lambda t: t.removeprefix("W/")), ("last-modified", str)):
            a, b = headers.get(name), stored.get(name)
            if a is not None and b is not None:
                state = "resolved" if clean(a) == clean(b) else "mismatch"
                break
        merged = {**stored, **{k: v for k, v in headers.items() if k not in NOT_MERGED}}
        out.append((i, state, hit[0], tuple(sorted(merged.items())) if state == "resolved" else None, hit[5] if state == "resolved" else None))
    return sorted(out, key=str)


def got(frame) -> list[tuple]:
    rows = resolved(frame).collect()
    return sorted(((r.record_id, r.state, r.refers_to, tuple(sorted(r.headers.items())) if r.headers is not None else None, r.body_digest) for r in rows), key=str)


@pytest.mark.parametrize("width", [5, 4096])
def test_slices_of_any_width_give_the_same(spark, monkeypatch, width):
    monkeypatch.setattr(revisits, "SLICE", width)
    draw = random.Random(width)
    rows = []
    for k in range(400):
        revisit = draw.random() < 0.6
        headers = {"date": str(k), "content-length": str(k)}
        if draw.random() < 0.7:
            headers["etag"] = draw.choice(["", "W/"]) + draw.choice(['"a"', '"b"'])
        if draw.random() < 0.5:
            headers["last-modified"] = draw.choice("xy")
        # Most records belong to one address.
        rows.append((k, draw.choice(["h/a", "h/a", "h/a", "h/b", None]), draw.choice([None, *range(60)]), revisit, headers, f"d{k}", k, 0, 0))
    rows += [(500, "h/a", 70, True, None, None, None, 0, 0), (501, "h/c", 1, None, None, "d", 1, 0, 0), (502, "h/c", 2, True, {}, None, None, 0, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(frame) == brute(rows, lambda url: url)
    assert {r[1] for r in got(frame)} == {"no response", "resolved", "mismatch", "unverified"}


def test_canonical_urls(spark):
    same = {
        "http://www.A.example.com:80/X/": "a.example.com/X",
        "HTTPS://a.example.com/X#top": "a.example.com/X",
        "https://a.example.com/X?utm_source=f&ref=x": "a.example.com/X",
        "https://a.example.com/X?utm_source=f&page=2&ref=x": "a.example.com/X?page=2",
        "https://a.example.com/X?page=2&utm_a=b&q=ref=1": "a.example.com/X?page=2&q=ref=1",
        "a.example.com": "a.example.com",
        "https://m.a.example.com:8080?x=1": "m.a.example.com:8080?x=1",
        "": "",
    }
    frame = spark.createDataFrame([(u,) for u in [*same, None]], "url string").select("url", canonical_url(F.col("url")).alias("key"))
    assert {r.url: r.key for r in frame.collect()} == {**same, None: None}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "h/a", 1, False, {"etag": "1"}, "d", 1, 0, 0)] * 2 + [(2, "h/a", 1, True, {"etag": "1"}, None, None, 0, 0), (3, "h/a", 2, True, {"etag": "1"}, None, None, 0, 0)] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [(r[0], r[1]) for r in got(frame)] == [(2, "no response")] * 2 + [(3, "resolved")] * 2
    assert resolved(frame.limit(0)).count() == 0
