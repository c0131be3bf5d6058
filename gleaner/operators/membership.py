"""Which keys a table has already, told by bit filters that are kept with its snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.operators.keys import ANY_CASE, EXACT, without_known
from gleaner.sources.store import Commit, Kept

WORDS = 8  # 64-bit words of a block; a key sets one bit in each
_BITS = T.StructType([T.StructField("slot", T.LongType()), *[T.StructField(f"w{k}", T.LongType()) for k in range(WORDS)]])


@dataclass(frozen=True)
class Membership:
    """An index of a text key, in two tables of a store: ``<name>_bits`` and ``<name>_keys``.

    Keys are dealt into ``buckets`` by a hash. The keys of a bucket lie in files of their own, and set
    bits in the bucket's ``blocks`` blocks of 512 bits. A key whose bits are not all set is surely new. For others
    the bucket's keys are read and compared. A filter too full to tell anything only costs reading: the answer stays exact.

    Under ``ANY_CASE`` keys are hashed folded, so that equal ones set the same bits; those that a perhaps leaves over are
    compared under that collation. Other collations have no such fold here.
    """

    name: str
    buckets: int = 64
    blocks: int = 1 << 14
    equality: str = EXACT

    def __post_init__(self):
        if self.equality not in (EXACT, ANY_CASE):
            raise ValueError(f"no index of keys under {self.equality}")

    def tables(self) -> dict[str, Kept]:
        """The two tables as a store keeps them."""
        keys = T.StructType([T.StructField("key", T.StringType())])
        return {
            f"{self.name}_bits": Kept(_BITS, "slot", lambda: F.floor(F.col("slot") / self.blocks)),
            f"{self.name}_keys": Kept(keys, "key", lambda: self._bucket()),
        }

    def _hashed(self) -> Column:
        # Lower case alone keeps two forms of one letter apart where it depends on the place, as for the Greek s.
        return F.col("key") if self.equality == EXACT else F.upper(F.lower("key"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self._hashed()), F.lit(self.buckets))

    def _probed(self, keys: DataFrame) -> DataFrame:
        """Keys with their slot and the bit they set in each word."""
        block = F.pmod(F.shiftrightunsigned(F.xxhash64(self._hashed()), 24), F.lit(self.blocks))
        placed = keys.withColumn("slot", self._bucket() * self.blocks + block).withColumn("_bits", F.xxhash64(self._hashed(), F.lit(1)))
        masks = [F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(_bits, {6 * k}) & 63 AS INT))").alias(f"m{k}") for k in range(WORDS)]
        return placed.select(*[F.col(f"`{c}`") for c in keys.columns], "slot", *masks)

    def unseen(self, commit: Commit, keys: DataFrame) -> DataFrame:
        """Those rows of ``keys`` (``key`` and narrow columns, a key once) that the commit's tables do not have."""
        bits = commit.read(f"{self.name}_bits")
        found = F.lit(True)
        for k in range(WORDS):
            found = found & (F.col(f"w{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"))
        probed = self._probed(keys).join(bits, "slot", "left").withColumn("_maybe", F.coalesce(found, F.lit(False)))
        probed = commit.staged(probed.select(*[F.col(f"`{c}`") for c in keys.columns], "_maybe", self._bucket().alias("_part")))
        maybe = probed.where("_maybe")
        parts = [r._part for r in maybe.select("_part").distinct().collect()]
        fresh = probed.where("NOT _maybe")
        if parts:
            known = commit.read(f"{self.name}_keys", parts)
            fresh = fresh.unionByName(without_known(maybe, known, ["key"], self.equality).select(*fresh.columns))
        return fresh.select(*keys.columns)

    def add(self, commit: Commit, keys: DataFrame) -> None:
        """Keys that are stored from now on: appended to their buckets, and their bits set."""
        rows = self._probed(keys.select("key"))
        commit.append(f"{self.name}_keys", rows.select("key"))
        new = rows.groupBy("slot").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])
        touched = [r[0] for r in new.select(F.floor(F.col("slot") / self.blocks).cast("bigint")).distinct().collect()]
        old = commit.read(f"{self.name}_bits", touched)
        both = old.unionByName(new).groupBy("slot").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])
        commit.replace(f"{self.name}_bits", touched, both)


URLS = Membership("urls")
TITLES = Membership("titles")


def title_key(sid: Column, title: Column) -> Column:
    """Site and title as one key; the site comes first and holds no colon."""
    return F.concat(sid.cast("string"), F.lit(":"), title)


def indexed(commit: Commit, articles: DataFrame, urls: Membership, titles: Membership) -> None:
    """Index articles (``sid, url, title``) that a commit adds, by address and by title within a site."""
    urls.add(commit, articles.select(F.col("url").alias("key")).distinct())
    titles.add(commit, articles.select(title_key(F.col("sid"), F.col("title")).alias("key")).distinct())


def store_tables(urls: Membership = URLS, titles: Membership = TITLES) -> dict[str, Kept]:
    """The tables both indexes need."""
    return {**urls.tables(), **titles.tables()}
