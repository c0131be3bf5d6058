"""Packing: an exact round trip, the limits, and the tokenizer's own ids."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.packing import SEGMENTS, Packer, Tokens, packed, packed_examples
from gleaner.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(text: str | None) -> np.ndarray:
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 0], "<u4")


def check(pieces, docs: dict, size: int) -> int:
    """Every id in exactly one piece, gapless sequences within the limits; gives the padding."""
    for doc, ids in docs.items():
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) == len(ids) and {p.doc_tokens for p in own} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        total = sum(p.length for p in own)
        assert total <= size and len(own) <= SEGMENTS and all(p.length > 0 for p in own)
        padding += 0 if total & (total - 1) == 0 else size - total
    return padding


def test_round_trip_of_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(PATH)
    docs = {
        r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
    }
    pieces = QUERIES["op2_packing"](spark, folder).collect()
    assert {p.doc_id for p in pieces} == set(docs)
    assert check(pieces, docs, 1024) == 0


def test_pieces_of_words_have_the_tokenizers_ids():
    draw = random.Random(1)
    parts = ["the", "it's", " ", "  ", "   ", "\n", " \n", "\t", "naïve", "日本", "12", "a1!", "...", "<|endoftext|>", "'s", " ", " ", "\x1c", "\u0085", "é", "🙂", "x\ny", "\u00a0", "\u2003", "\u3000", "\u1680", "—", "’s", "été", "×", "end.", "(a)", "a,", "é!", "×.", "a\u0301.", "x²,", "_"]
    texts = ["", " ", "  ", " a", "a ", "a  b", "\n a", "a\n\n b"] + ["".join(draw.choice(parts + [" "] * 9) for _ in range(draw.randrange(40))) for _ in range(1500)]
    tokens, plain = Tokens(PATH), Tokenizer.from_file(PATH)
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        ids, offsets = tokens.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "w " * 20000), (4, "same text"), (4, "same text")] + [(k, "x") for k in range(10, 400)]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id bigint, text string, start int, ids int").coalesce(1)
    pieces = packed(frame).withColumn("ids_crc32", F.crc32("ids")).collect()
    single = {d: expected(t) for d, t in rows if d != 4}
    for doc, ids in single.items():
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes()
    assert sum(p.length for p in pieces if p.doc_id == 4) == 2 * len(expected("same text"))
    assert check(pieces, {}, 1024) == 0
    assert packed(frame.limit(0)).count() == 0


def test_limits_hold_together():
    draw = random.Random(2)
    demands = [(draw.randrange(1, 100), draw.randrange(1, 4), draw.randrange(0, 60)) for _ in range(500)]
    packer = Packer((100, 5, 60), lambda item, count: None)
    packer.add(list(range(500)), demands)
    seen = []
    while packer.items:
        chosen = packer.fill()
        assert chosen and all(sum(demands[k][d] for k in chosen) <= limit for d, limit in enumerate((100, 5, 60)))
        seen += chosen
    assert sorted(seen) == list(range(500))


def test_conversations_stay_whole_within_all_limits(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    words = F.size(F.split("text", " "))
    examples = turns.groupBy(F.col("conv_id").alias("example_id")).agg(
        F.sum(words).alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("role") == "assistant", words).otherwise(0)).alias("loss_tokens")
    )
    limits = (4096, 40, 3000)
    demands = {r.example_id: (r.tokens, r.segments, r.loss_tokens) for r in examples.collect()}
    sequences: dict = {}
    for r in packed_examples(examples.coalesce(1), limits).collect():
        sequences.setdefault(r.sequence_id, []).append(r.example_id)
    assert sorted(i for ids in sequences.values() for i in ids) == sorted(demands)
    for ids in sequences.values():
        total = [sum(demands[i][d] for i in ids) for d in range(3)]
        assert len(ids) == 1 or all(t <= limit for t, limit in zip(total, limits, strict=True))
    # Not many more sequences than the scarcest demand needs.
    least = max(-(-sum(d[k] for d in demands.values()) // limit) for k, limit in enumerate(limits))
    assert len(sequences) <= 1.25 * least + 1
    rows = spark.createDataFrame([(1, None, None, None), (None, 5, 1, 1), (2, 10**6, 1, 1)], "example_id bigint, tokens int, segments int, loss_tokens int")
    assert packed_examples(rows).count() == 3 and packed_examples(rows.limit(0)).count() == 0


def test_parts_whose_hashes_meet_keep_their_own_ids(monkeypatch):
    from gleaner.llm import packing

    monkeypatch.setattr(packing, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    known = Tokens(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    for texts in (["one two ten six", "five nine", None, ""], ["six ten two one", "nine five seven", "one"]):
        ids, edges = known.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[edges[k] : edges[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_examples_of_one_kind_reach_the_loss_limit_first(spark):
    # A third of all examples bears loss on every token and fills that limit long before the others.
    rows = [(k, 40, 2, 40 if k % 3 == 0 else 1) for k in range(6000)]
    frame = spark.createDataFrame(rows, "example_id bigint, tokens int, segments int, loss_tokens int").repartition(4)
    limits = (1024, 64, 200)
    need = {r[0]: r[1:] for r in rows}
    sums: dict = {}
    for r in packed_examples(frame, limits).collect():
        sums.setdefault(r.sequence_id, []).append(need[r.example_id])
    totals = [tuple(map(sum, zip(*own, strict=True))) for own in sums.values()]
    assert sum(len(own) for own in sums.values()) == len(rows)
    assert all(t <= limits[0] and s <= limits[1] and loss <= limits[2] for t, s, loss in totals)
    # Five of the costly ones fill a sequence's loss; the best mix of fives and fours with the others takes 438.
    assert any(loss > 160 and t < 1024 - 40 for t, _, loss in totals) and len(sums) <= 1.3 * 438
