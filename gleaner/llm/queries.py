"""The subpackage's registered queries and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.captures import CHECK as _OP9, captures, printed
from gleaner.llm.divergence import divergence
from gleaner.llm.labelled import fold
from gleaner.llm.language import identified, learn as learn_languages
from gleaner.llm.mixing import mixed
from gleaner.llm.packing import packed
from gleaner.llm.phrases import collocations
from gleaner.llm.quality_classifier import scored
from gleaner.llm.quality_rules import COUNTS, judged, learn
from gleaner.llm.revisits import resolved
from gleaner.llm.sharding import SHARD_BYTES, sharded
from gleaner.llm.simhash import near_duplicates
from gleaner.llm.substring import without_repeats
from gleaner.llm.topk import top_products
from gleaner.llm.vectors import near_vectors
from gleaner.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``function(read)``, where ``read(table)`` gives a given table."""

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return function(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return function

    return register


@query("op4_simhash_near_duplicates")
def _op4(read) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = near_duplicates(read("documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


_OP3 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
held AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(13)) AS p
  FROM (SELECT doc_id, i FROM win JOIN held USING (k) WHERE doc_id > least)),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
  FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)"""


@query("op3_substring_dedup", _OP3)
def _op3(read) -> DataFrame:
    """Words of every document, how many of them repeat earlier documents, and a digest of the rest."""
    rows = without_repeats(read("documents"))
    return rows.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_quality_rules")
def _op7(read) -> DataFrame:
    """Counts and verdict of every document."""
    docs = read("documents")
    return judged(docs, learn(docs, read("labels"))).select("row.doc_id", *COUNTS, "base_failed", "kept", "score")


@query("op2_packing")
def _op2(read) -> DataFrame:
    """Where every piece of every document stands."""
    return packed(read("documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_mixing")
def _op10(read) -> DataFrame:
    """What the mix takes of every document."""
    rows = mixed(read("documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op1_quality_classifier")
def _op1(read) -> DataFrame:
    """Score and prediction of every document."""
    return scored(read("documents"), read("labels"))


_OP5 = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""


@query("op5_exact_top_k", _OP5)
def _op5(read) -> DataFrame:
    """The 20 largest inner products of every query."""
    return top_products(read("embeddings"))


_OP6 = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
e AS (SELECT *, h >> (60 - depth) AS prefix FROM (SELECT *, unnest(range(61)) AS depth FROM d)),
p AS (
  SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM e GROUP BY depth, prefix
  HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h))
SELECT doc_id, n_bytes, lpad(bin(prefix), CAST(depth AS INTEGER), '0') AS shard, CAST(0 AS BIGINT) AS page,
  CAST(b AS BIGINT) AS shard_bytes, n AS shard_docs
FROM e JOIN p USING (depth, prefix) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""


@query("op6_extendible_sharding", _OP6)
def _op6(read) -> DataFrame:
    """The shard of every document."""
    return sharded(read("documents"))


@query("op8_language_id")
def _op8(read) -> DataFrame:
    """Language of every document."""
    docs = read("documents")
    rows = identified(docs, learn_languages(docs))
    return rows.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_warc_revisits", _OP9)
def _op9(read) -> DataFrame:
    """What every revisit of the pages' records refers to."""
    return resolved(captures(read("pages"))).withColumn("headers", printed("headers"))


_OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93),
r AS (
  SELECT vec_id, vec_id AS reached FROM embeddings
  UNION
  SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, min(reached) AS component_id, vec_id = min(reached) AS kept
FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id, n"""


@query("op11_embedding_near_duplicates", _OP11)
def _op11(read) -> DataFrame:
    """Links, component and whether it stays, of every vector."""
    return near_vectors(read("embeddings")).select("vec_id", "n_links", "component_id", "kept")


_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (total + 5 * v) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) USING (lang)
  GROUP BY lang, term, total, v),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50"""


@query("op13_source_divergence", _OP13)
def _op13(read) -> DataFrame:
    """How far every two sources of a language lie apart, and the terms that mark each source."""
    return divergence(read("documents"))


_OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY lang, size, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30),
k AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (
  SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = p JOIN f y ON y.lang = k.lang AND y.phrase = q
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1),
i AS (
  SELECT DISTINCT lang, array_to_string(ws[b:b + m - 1], ' ') AS phrase, a AS f
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS m FROM c))),
u AS (SELECT lang, phrase, max(f) AS most FROM i GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s JOIN n USING (lang) LEFT JOIN u USING (lang, phrase)
WHERE most IS NULL OR 100 * most < 80 * a QUALIFY rank <= 2000"""


@query("op12_collocations", _OP12)
def _op12(read) -> DataFrame:
    """The phrases of each language that hold together most."""
    return collocations(read("documents"))
