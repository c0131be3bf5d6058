"""Where sources of a language differ: smoothed shares of kept terms, compared exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.text import distinct, flat, lowered, text_blocks, words
from gleaner.llm.transducer import Transducer, Vocabulary, transducer
from gleaner.operators.keys import number_rows
from gleaner.session import stored

LEAST_DOCS = 30
TOP = 50
SHARES = 1_000_000_000  # parts that a share is counted in
ADDED = 5  # added to each count
BLOCK = 8 << 20  # bytes of text whose terms are counted together
VOLUME = 1 << 16  # terms of one transducer
PASS_TERMS = 1 << 20  # terms, and
PASS_BYTES = 16 << 20  # bytes of terms, whose transducers a task holds at once
CELLS = 1 << 21  # counts that a task compares at once

_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def _terms(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of terms, and the index of each one's document."""
    data, offsets = flat(table.column("text"))
    data = lowered(data)
    return data, *words(data, offsets, _BETWEEN)


def _coded(table: pa.Table, name: str) -> tuple[np.ndarray, list]:
    column = table.column(name).combine_chunks().dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary.to_pylist()


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers and how often each occurs."""
    if not len(keys):
        return keys, keys
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def _filled(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in columns])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``docs``: in how many documents of a language each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, size=BLOCK):
            data, starts, ends, doc = _terms(table)
            codes, known = distinct(data, starts, ends)
            lang, langs = _coded(table, "lang")
            many = max(len(known), 1)
            pairs, _ = _counted(doc * many + codes)
            keys, counts = _counted(lang[pairs // many] * many + pairs % many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(keys // many)), known.take(pa.array(keys % many)).cast(pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                ["lang", "term", "docs"],
            )

    rows = _filled(docs, "lang", "text").mapInArrow(run, "lang string, term string, docs bigint")
    return rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang``, ``term``, ``ordinal``, ``place`` of the terms in at least ``least`` documents of a language.

    ``ordinal`` counts from 0 within the language in the order of the terms' bytes, ``place``
    over all languages.
    """
    kept = document_frequencies(docs).where(F.col("docs") >= least).select("lang", "term")
    placed = number_rows(kept, [F.col("lang"), F.col("term")], "place", -1)
    opening = placed.groupBy("lang").agg(F.min("place").alias("_opening"))
    return stored(placed.join(opening, "lang").select("lang", "term", (F.col("place") - F.col("_opening")).alias("ordinal"), "place"))


_VOLUME = "first bigint, low binary, keys binary, target binary, output binary, final binary, lang string, place bigint"


def transducers(terms: DataFrame) -> DataFrame:
    """One row per ``VOLUME`` consecutive terms of a language with their transducer."""

    def build(table: pa.Table) -> pa.Table:
        ordinals = table.column("ordinal").to_numpy()
        order = np.argsort(ordinals)
        sorted_terms = table.column("term").cast(pa.binary()).take(pa.array(order)).to_pylist()
        made = transducer(sorted_terms)
        arrays = (made.keys, made.target, made.output, made.final)
        return pa.table(
            {
                "first": pa.array([int(ordinals.min())], pa.int64()),
                "low": pa.array([sorted_terms[0][:8].ljust(8, b"\0")], pa.binary()),
                **{name: pa.array([a.tobytes()], pa.binary()) for name, a in zip(("keys", "target", "output", "final"), arrays, strict=True)},
                "lang": table.column("lang").slice(0, 1),
                "place": pa.array([int(table.column("place").to_numpy().min())], pa.int64()),
            }
        )

    volumes = terms.withColumn("volume", F.floor(F.col("ordinal") / VOLUME))
    return stored(volumes.groupBy("lang", "volume").applyInArrow(build, _VOLUME))


def _unpacked(row: dict) -> tuple[str, int, int, Transducer]:
    parts = [np.frombuffer(row[name], np.int64) for name in ("keys", "target", "output")]
    return row["lang"], row["first"], int.from_bytes(row["low"], "big"), Transducer(*parts, np.frombuffer(row["final"], bool))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``ordinal``, ``n``: occurrences of kept terms in the texts of a language and source.

    All texts are read through the transducers, which tell a term's ordinal as they accept it. A task holds those of about
    ``PASS_TERMS`` terms; a larger vocabulary takes as many passes over the texts as it has such parts.
    """
    spark = docs.sparkSession
    total, weight = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    passes = max(1, math.ceil(total / PASS_TERMS), math.ceil(weight / PASS_BYTES))
    volumes = transducers(terms)
    texts = _filled(docs, "lang", "source", "text")
    found = None
    for number in range(passes):
        part = volumes.where(F.floor(F.col("place") * passes / max(total, 1)) == number)
        shared = spark.sparkContext.broadcast([_unpacked(row.asDict()) for row in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Vocabulary(shared.value)
            for table in text_blocks(batches, size=BLOCK):
                data, starts, ends, doc = _terms(table)
                lang, langs = _coded(table, "lang")
                source, sources = _coded(table, "source")
                for code, name in enumerate(langs):
                    own = np.flatnonzero((lang == code)[doc])
                    ordinals = known.ordinals(name, data, starts[own], ends[own])
                    hit = ordinals >= 0
                    keys, counts = _counted(ordinals[hit] * len(sources) + source[doc[own[hit]]])
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(keys), pa.string()), pa.array(sources, pa.string()).take(pa.array(keys % len(sources))), pa.array(keys // len(sources)), pa.array(counts, pa.int64())],
                            ["lang", "source", "ordinal", "n"],
                        )

        rows = texts.mapInArrow(run, "lang string, source string, ordinal bigint, n bigint")
        found = rows if found is None else found.union(rows)
    return stored(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SHARES * counts / totals) in whole numbers, for counts not above totals; digit by digit, so nothing overflows."""
    left, out = counts.astype(np.int64), np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(round(math.log10(SHARES))):
        left = left * 10
        out = out * 10 + left // totals
        left = left % totals
    return out + 1


def _compared(counts: pa.Table, groups: pa.Table, width: int, top: int) -> pa.Table:
    """Sums of differences of each pair of sources over one range of terms, and each source's highest terms of it."""
    index, total, size = (groups.column(name).to_numpy() for name in ("index", "total", "terms"))
    order = np.argsort(index)
    index, total, size = index[order], total[order], int(size[0])
    first = groups.column("chunk")[0].as_py() * width
    span = min(width, max(size - first, 0))
    n = np.zeros((len(index), span), np.int64)
    n[np.searchsorted(index, counts.column("own").to_numpy()), counts.column("ordinal").to_numpy() - first] = counts.column("n").to_numpy()
    own = shares(n + ADDED, (total + ADDED * size)[:, None]) if span else n
    whole = shares(n.sum(axis=0) + ADDED, total.sum() + np.array(ADDED * size)) if span else n[0]
    kind, left, right, value = [], [], [], []
    for k in range(len(index)):
        others = np.abs(own[k + 1 :] - own[k]).sum(axis=1)
        over = np.where((n[k] > 0) & (own[k] > whole), own[k] - whole, 0)
        best = np.lexsort((np.arange(span), -over))[:top]
        best = best[over[best] > 0]
        kind += [np.zeros(len(others), np.int64), np.ones(len(best), np.int64)]
        left.append(np.full(len(others) + len(best), index[k]))
        right += [index[k + 1 :], first + best]
        value += [others, over[best]]
    columns = [np.concatenate(part).astype(np.int64) for part in (kind, left, right, value)]
    lang = pa.array([groups.column("lang")[0].as_py()] * len(columns[0]), pa.string())
    return pa.table([lang, *columns], ["lang", "kind", "index", "other", "value"])


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how sources of a language differ, and by which terms.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case; a language keeps those in at least
    ``least`` of its documents (V of them). In each language and source, and in each language, a kept term of ``c``
    occurrences has the share p = 1 + floor(10^9 (c + 5) / (N + 5 V)), N being all occurrences of kept terms. Part
    ``pair``: for each other source of the language the summed differences of shares over all kept terms. Part ``term``: the ``top`` kept
    terms that the source has and whose share there most exceeds the language's. Ranks go by value, then by item.
    Null text, language and source are read as ''. Every occurring language and source counts, also without terms; V = 0 gives
    differences of 0. Repeated rows and null ids are documents like others. An empty table gives an empty result; other columns are not read.

    The terms of a language are dealt into ranges of ordinals, and the sources' counts of a range are compared as one
    matrix of at most about ``CELLS`` numbers. Ties of terms go by ordinal, which is the order of their bytes.
    """
    terms = vocabulary(docs, least)
    counts = term_counts(docs, terms)
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = _filled(docs, "lang", "source").distinct().withColumn("index", F.row_number().over(by_name).cast("bigint"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    groups = stored(groups.select("lang", "source", "index", "total", "terms"))
    most = groups.agg(F.max("index")).first()[0] or 1
    width = max(1, min(1 << 13, CELLS // most))
    ranges = groups.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("terms") / width) - 1).cast("bigint"))).alias("chunk"))
    placed = counts.join(groups.select("lang", "source", F.col("index").alias("own")), ["lang", "source"]).select("lang", F.floor(F.col("ordinal") / width).alias("chunk"), "own", "ordinal", "n")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compared(left, right, width, top)

    ranges = ranges.select("lang", "chunk", "index", "total", "terms")
    found = stored(placed.groupBy("lang", "chunk").cogroup(ranges.groupBy("lang", "chunk")).applyInArrow(compare, "lang string, kind bigint, index bigint, other bigint, value bigint"))
    named = groups.select("lang", "index", "source")
    other = named.select("lang", F.col("index").alias("other"), F.col("source").alias("item"))
    sums = found.where("kind = 0").groupBy("lang", "index", "other").agg(F.sum("value").alias("value"))
    sums = sums.union(sums.select("lang", "other", "index", "value"))
    pairs = sums.join(named, ["lang", "index"]).join(other, ["lang", "other"])
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_item).alias("rank"))
    by_ordinal = Window.partitionBy("lang", "index").orderBy(F.desc("value"), "other")
    best = found.where("kind = 1").withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top)
    best = best.join(terms.select("lang", F.col("ordinal").alias("other"), F.col("term").alias("item")), ["lang", "other"]).join(named, ["lang", "index"])
    return pairs.union(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
