"""Fingerprints and components against a plain reading of the definition."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from gleaner.llm import simhash
from gleaner.llm.queries import QUERIES
from gleaner.llm.simhash import first_of_each_group, linked, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text: str | None, size: int = 3) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict) -> dict:
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_all_documents_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {k: brute_print(t) for k, t in texts.items()}
    roots = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_duplicates"](spark, folder).collect()}
    assert got == {k: (f"{prints[k]:016x}", roots[k]) for k in texts}


@pytest.mark.parametrize("crowd", [1, 4, 10**6])
def test_links_join_the_same_groups_whatever_counts_as_a_crowd(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(5)]
    prints = {0, (1 << 64) - 1, 1 << 63}
    for centre in centres:
        for _ in range(30):
            value = centre
            for bit in draw.sample(range(64), draw.randrange(5)):
                value ^= 1 << bit
            prints.add(value)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = linked(spark.createDataFrame([(p,) for p in signed], "print bigint")).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in got)
    expect = brute_components({p: p & ((1 << 64) - 1) for p in signed})
    root = {p: p for p in signed}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for r in got:
        x, y = find(r.a), find(r.b)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in signed} == expect


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [
        (1, None, 9), (2, "", 9), (3, " \n ", 9), (4, "one two", 9), (5, "ONE  two", 9), (5, "ONE  two", 8),
        (None, "one two", 9), (None, "alone here too", 9), (None, "quite another text", 9), (7, long, 9), (8, long + " x", 9), (9, "one two", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, print int")
    got = sorted(((str(r.doc_id), r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    assert [c for d, c in got if d in "123"] == [1, 1, 1]
    assert [c for d, c in got if d in "45"] == [4, 4, 4]
    assert sorted(str(c) for d, c in got if d == "None") == ["4", "None", "None"]
    assert [c for d, c in got if d in "78"] == [7, 7]
    kept = first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept.collect()) == sorted(
        [("1", ""), ("4", "one t"), ("7", "w0 w1"), ("9", "one t"), ("None", "alone"), ("None", "quite")]
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(docs).count() == 0 and first_of_each_group(docs).count() == 0
