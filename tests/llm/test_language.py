"""Languages: held-out accuracy, windows over whole texts, rows that nothing can be said of."""

from __future__ import annotations

import zlib

import numpy as np

from gleaner.llm.language import LENGTH, Network, fit, identified, known_windows, learn, windows
from gleaner.llm.queries import QUERIES


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(langs) and len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id][0] for r in held]) > 0.97


def test_windows_hold_every_byte_once():
    texts = [b"a" * 600, b"", b"b" * LENGTH, b"c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    taken, doc, length = windows(data, offsets, slice(None))
    joined = [b"".join(t[:n].tobytes() for t, d, n in zip(taken, doc, length, strict=True) if d == k) for k in range(4)]
    assert joined == texts and (taken[np.arange(LENGTH) >= length[:, None]] == 0).all()


def test_pooling_in_pairs_equals_the_plain_convolution():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 256, (30, LENGTH)).astype(np.uint8)
    net: Network = fit(x, draw.integers(0, 2, 30), ["a", "b"], rounds=1)
    plain = []
    for table in net.tables:
        span = LENGTH - len(table) + 1
        plain.append(sum(table[j][x[:, j : j + span]] for j in range(len(table))).max(axis=1))
    assert np.allclose(net.pooled(x), np.concatenate(plain, axis=1), atol=1e-4)
    odds = net.chances(net.pooled(x))
    assert np.allclose(odds.sum(axis=1), 1)


def test_edge_rows(spark):
    rows = [(k, "the cat and the dog " * 5, "en") for k in range(40)] + [(k, "le chat et le chien " * 5, "fr") for k in range(40, 80)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 !? 34", "en"), (None, "the dog", None), (103, "le chien " * 20000, None), (103, "日本", None)]
    frame = spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id bigint, text string, lang string, score double, bytes string")
    network = learn(frame)
    assert network.languages == ["en", "fr"]
    got = identified(frame, network).collect()
    by_id = {(r.doc_id, r.lang_pred): r.score for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i, "und"] == 0 for i in (100, 101, 102))
    assert (None, "en") in by_id and (103, "fr") in by_id
    assert sum(r.lang_pred == "und" for r in got) == 3
    assert learn(frame.limit(0)) is None
    assert {r.lang_pred for r in identified(frame, None).collect()} == {"und"}
    assert identified(frame.limit(0), network).count() == 0


def test_an_id_with_many_rows_counts_once(spark):
    """A third of all rows on one id: one row of it is learned from, and reaches the driver."""
    rows = [(k, f"the cat {k} and the dog " * (1 + k % 40), "en" if k % 2 else "fr") for k in range(600)]
    frame = spark.createDataFrame([*rows, (700, "", "fr"), (701, None, "en")], "doc_id bigint, text string, lang string")
    hot = frame.unionByName(frame.where("doc_id IN (4, 5)").crossJoin(spark.range(150)).select(*frame.columns)).repartition(8)
    plain, many = (sorted(map(tuple, known_windows(d).collect())) for d in (frame, hot))
    assert plain == many
    assert [r[0] for r in many] == sorted(k for k in range(600) if zlib.crc32(str(k).encode()) % 4 != 2)
    assert all(len(r[2]) % LENGTH == 0 and len(r[2]) <= 6 * LENGTH for r in many)
