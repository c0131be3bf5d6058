"""The classifier: contexts against a plain count, held-out accuracy, calibration, rows without words."""

from __future__ import annotations

import re
import zlib

import numpy as np

from gleaner.llm.quality_classifier import BUCKETS, REACH, SIZE, contexts, fit, index_vectors, known_rows, pooled, scored, terms, word_vectors
from gleaner.llm.queries import QUERIES


def flat(texts: list[bytes]):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def test_terms_are_runs_of_one_kind():
    texts = ["Foo... bar&&&baz\n42 é!", "", "Foo", " ,"]
    data, offsets = flat([t.encode() for t in texts])
    term, doc = terms(data, offsets)
    plain = [re.findall(r"\w+|[^\w\s]+", t) for t in texts]
    assert np.bincount(doc, minlength=4).tolist() == [len(p) for p in plain]
    assert term[0] == term[[len(plain[0])]][0] and len(set(term.tolist())) == len({w for p in plain for w in p})


def test_contexts_sum_the_neighbours():
    draw = np.random.default_rng(0)
    doc = np.sort(draw.integers(0, 5, 60))
    term = draw.integers(0, 9, 60)
    marks = index_vectors()
    expect = np.zeros((BUCKETS, SIZE))
    for i in range(60):
        for j in range(max(0, i - REACH), min(60, i + REACH + 1)):
            if i != j and doc[i] == doc[j]:
                expect[term[i], marks[term[j], 0]] += 1
                expect[term[i], marks[term[j], 1]] -= 1
    assert (contexts(term, doc, marks).reshape(BUCKETS, SIZE) == expect).all()


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert (word_vectors(docs) == word_vectors(docs.repartition(5))).all()


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op1_quality_classifier"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    score, label = np.array(held).T
    assert np.mean((score >= 0.3) == label) > 0.95
    # Calibrated: the mean score is near the share of good documents.
    assert abs(score.mean() - label.mean()) < 0.03


def test_temperature_cools_an_overconfident_network():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 6))
    y = (draw.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = fit(x, y, rounds=80)
    fresh = draw.normal(size=(4000, 6))
    truth = (draw.random(4000) < 1 / (1 + np.exp(-fresh[:, 0]))).astype(float)

    def loss(heat: float) -> float:
        net.temperature = heat
        p = np.clip(net.score(fresh), 1e-9, 1 - 1e-9)
        return -np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p))

    chosen = net.temperature
    assert chosen > 1 and loss(chosen) < loss(1.0)


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (None, "no id"), (3, long), (3, long), (4, "&&&"), (5, "a")]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id bigint, text string, label int, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (4, 9), (5, None), (2, 1)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        got = scored(frame, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got} == {0.5}
    assert scored(frame.limit(0), labels).count() == 0
    data, offsets = flat([b"", b"x", b" "])
    assert (pooled(data, offsets, np.ones((BUCKETS, SIZE), np.float32))[[0, 2]] == 0).all()


def test_an_id_with_many_rows_counts_once(spark):
    """A third of all rows on one id: one row of it is learned from, and reaches the driver."""
    once = [(k, f"word{k % 7} and, {k} more &&") for k in range(600)]
    frame = spark.createDataFrame(once, "doc_id bigint, text string")
    hot = frame.unionByName(frame.where("doc_id = 5").crossJoin(spark.range(300)).select("doc_id", "text")).repartition(8)
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id bigint, quality int")
    vectors = spark.sparkContext.broadcast(word_vectors(frame))
    plain, many = ({tuple(r) for r in known_rows(d, labels, vectors).collect()} for d in (frame, hot))
    assert plain == many and len(many) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(600))
    assert known_rows(hot, labels, vectors).count() == len(many)
