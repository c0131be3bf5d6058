"""Every stage of the pipeline on the smallest documents, against plain versions of what it should do."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm.mixing import mixed
from gleaner.llm.quality_rules import judged, learn

from .test_mixing import brute_targets
from .test_quality_rules import brute as brute_counts
from .test_simhash import brute_components, brute_print
from .test_substring import brute as brute_repeats

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents, and what each stage makes of its predecessor's rows, written and read again."""
    rows = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, rows[-1], FOLDER).write.parquet(path)
        rows.append(spark.read.parquet(path))
    return rows


def test_stages_keep_the_columns_of_documents(steps):
    for rows in steps[1:-1]:
        assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in steps[0].schema]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "mixing", "packing"]


def test_quality_rules(spark, steps):
    kept = {tuple(r) for r in steps[1].collect()}
    score = {r.row.doc_id: r.score for r in judged(steps[0], learn(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect()}
    expect = {tuple(r) for r in steps[0].collect() if not brute_counts(r.text)[-1] and score[r.doc_id] >= 0.5}
    assert kept == expect and len(kept) < steps[0].count()


def test_near_duplicates(steps):
    prints = {r.doc_id: brute_print(r.text) for r in steps[1].collect()}
    roots = brute_components(prints)
    assert {tuple(r) for r in steps[2].collect()} == {tuple(r) for r in steps[1].collect() if roots[r.doc_id] == r.doc_id}


def test_substring_dedup(steps):
    before = {r.doc_id: r for r in steps[2].collect()}
    expect = {}
    for doc, words, gone, kept in brute_repeats([(r.doc_id, r.text) for r in before.values()]):
        if not gone:
            expect[doc] = before[doc].text
        elif kept:
            expect[doc] = kept
    after = steps[3].collect()
    assert {r.doc_id: r.text for r in after} == expect and len(after) == len(expect)
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source) for r in after)


def test_mixing(steps):
    docs = {r.doc_id: tuple(r) for r in steps[3].collect()}
    copies = {r.doc_id: r.copies for r in mixed(steps[3]).collect()}
    mix = Counter(tuple(r) for r in steps[4].collect())
    assert mix == Counter({docs[d]: n for d, n in copies.items() if n})
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row in docs.values():
        source, size = row[steps[3].columns.index("source")], len(WORD.findall(row[steps[3].columns.index("text")]))
        sizes[source] += size
        longest[source] = max(longest[source], size)
        taken[source] += size * copies[row[0]]
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)


def test_packing(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expect = Counter()
    for r in steps[4].collect():
        expect[r.doc_id, np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    pieces = steps[5].collect()
    own = defaultdict(Counter)
    for p in pieces:
        own[p.doc_id][p.start, bytes(p.ids)] += 1
    # Copies of a document may be cut at different places; their ids at each place are the same.
    for (doc, ids), count in expect.items():
        covered = Counter()
        for (start, part), times in own[doc].items():
            assert ids[4 * start : 4 * start + len(part)] == part
            covered.update({k: times for k in range(start, start + len(part) // 4)})
        assert set(covered.values()) == {count} and len(covered) == len(ids) // 4
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total == 1024 or total < 1024 and total & (total - 1) == 0


def test_run_gives_the_last_stage(spark, steps):
    columns = [c for c in steps[5].columns if c not in ("sequence_id", "offset")]
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == steps[5].columns
    assert rows.agg({"length": "sum"}).first() == steps[5].agg({"length": "sum"}).first() and set(columns) < set(rows.columns)
