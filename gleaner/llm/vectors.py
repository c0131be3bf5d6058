"""Near-duplicate vectors within a label: products of 8-bit tiles with error bounds, exact cosines where the bounds leave a doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.components import components
from gleaner.session import stored

COSINE = 0.93
TILE = 2048  # distinct vectors of a tile, on average
STRIP = 512  # rows of a product that are looked at together
CHUNK = 1 << 14  # pairs whose exact cosines are worked out together
_EXACT32 = 1 << 24  # whole numbers up to here are exact in single precision
_SLACK = 1e-9  # far above what rounding in double precision can add to a bound


def usable(column: Column) -> Column:
    """Neither null nor zero nor with a component that is null, infinite or no number."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros, which changes no product."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(int(lengths.max(initial=0)), 1)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def scaled(exact: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; no cosine changes."""
    _, exponent = np.frexp(np.abs(exact).max(axis=1))
    return np.ldexp(exact, -exponent[:, None])


def quantised(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows ``q``, their ``scale`` and the ``error``: how far ``scale * q`` lies from the row's unit vector."""
    unit = exact / np.sqrt((exact * exact).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(np.square(unit - scale[:, None] * q).sum(axis=1))
    return q, scale, error


class Tile:
    """Distinct vectors of one label: ids, how often each occurs, exact and 8-bit components."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, exact: np.ndarray):
        self.ids, self.times, self.exact = ids, times, scaled(exact)
        self.norms = np.sqrt((self.exact * self.exact).sum(axis=1))
        self.q, self.scale, self.error = quantised(self.exact)
        # |a.b - sa qa . sb qb| <= |sa qa| eb + ea |b|, where b is a unit vector.
        self.length = self.scale * np.sqrt(np.square(self.q.astype(float)).sum(axis=1))


def _wide(values: np.ndarray, width: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, width - values.shape[1])))


def links(a: Tile, b: Tile, least: float, counted: list[int] | None = None) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``least``, as a matrix of truth values.

    The 8-bit product gives every cosine up to a bound. Pairs surely above or below
    are settled by it; the cosines of the others are worked out in double precision
    (``counted`` collects how many those are).
    """
    width = max(a.q.shape[1], b.q.shape[1])
    kind = np.float32 if 127 * 127 * width < _EXACT32 else np.float64
    right, exact_a, exact_b = _wide(b.q, width).astype(kind), _wide(a.exact, width), _wide(b.exact, width)
    out = np.zeros((len(a.ids), len(b.ids)), bool)
    for first in range(0, len(a.ids), STRIP):
        part = slice(first, first + STRIP)
        near = (_wide(a.q[part], width).astype(kind) @ right.T) * a.scale[part, None] * b.scale
        bound = a.length[part, None] * b.error + a.error[part, None] + _SLACK
        sure = near - bound >= least
        rows, columns = np.nonzero((near + bound >= least) & ~sure)
        if counted is not None:
            counted.append(len(rows))
        for at in range(0, len(rows), CHUNK):
            r, c = rows[at : at + CHUNK], columns[at : at + CHUNK]
            product = (exact_a[first + r] * exact_b[c]).sum(axis=1)
            sure[r, c] = product / (a.norms[first + r] * b.norms[c]) >= least
        out[part] = sure
    return out


def forest(matrix: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a link matrix the smallest id each reaches through it (its own, if it has no link)."""
    top_left, top_right = left.copy(), right.copy()
    none = np.iinfo(np.int64).max
    while True:
        # Smallest label among the neighbours, one side after the other, until nothing moves.
        new_left = np.minimum(top_left, np.where(matrix, top_right, none).min(axis=1, initial=none))
        new_right = np.minimum(top_right, np.where(matrix, new_left[:, None], none).min(axis=0, initial=none))
        if (new_left == top_left).all() and (new_right == top_right).all():
            return top_left, top_right
        top_left, top_right = new_left, new_right


def _linked(a: Tile, b: Tile, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids that have links in this pair of tiles, with how many vectors they link to and the smallest id reached."""
    matrix = links(a, b, least)
    if same:
        np.fill_diagonal(matrix, False)
    if not matrix.any():
        return
    tops = forest(matrix, a.ids, b.ids)
    for tile, found, top in ((a, matrix @ b.times, tops[0]), (b, matrix.T @ a.times, tops[1]))[: 1 if same else 2]:
        some = found > 0
        yield tile.ids[some], found[some].astype(np.int64), top[some]


def _sum_links(table: pa.Table) -> Tile:
    """A tile from its rows, in the order of their ids."""
    order = np.argsort(table.column("rep").to_numpy(), kind="stable")
    exact = _matrix(table.column("embedding").combine_chunks())[order]
    return Tile(table.column("rep").to_numpy()[order], table.column("times").to_numpy()[order], exact)


def near_vectors(vectors: DataFrame, least: float = COSINE, tile: int = TILE) -> DataFrame:
    """``vec_id``, ``label``, ``n_links``, ``component_id``, ``kept`` of every row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding``, ``label``. Two rows link if their labels are equal
    and not null and their cosine in double precision is at least ``least``. Vectors that
    are null, empty, zero or hold a null or non-finite component link with nothing: no links, a
    component of their own. ``n_links`` counts the rows linked directly, ``component_id`` is the smallest
    ``vec_id`` reachable over links, ``kept`` says that it is the row's own. A shorter vector ends in zeros.
    Repeated rows are rows of their own, linked with each other. Null ids take part and are
    never the smallest; where a component has no other, ``component_id`` is null and ``kept`` true.
    An empty table gives an empty result; other columns are not read.

    Equal vectors of a label become one with a count first, with partial sums in each task, so copies
    cost nothing. The distinct ones of a label are dealt into tiles, and each pair of tiles is one
    group: a product of 8-bit matrices, with exact cosines only where its error
    bound leaves a doubt. A pair of tiles gives per vector the count of its links and the smallest id
    reached within the pair, so a dense group costs rows in proportion to its vectors, not to
    its links; components are contracted over these.
    """
    own = vectors.select(F.col("vec_id").cast("bigint"), "label", "embedding")
    rows = own.withColumn("_use", usable(F.col("embedding")) & F.col("label").isNotNull())
    # Written once, so that numbers stay what they are whoever reads them.
    reps = rows.where("_use").groupBy("label", "embedding").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()))
    sizes = reps.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("int").alias("tiles"))
    dealt = reps.select("label", "rep", "times", "embedding").join(sizes, "label")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # A tile meets those of its label that are not before it: as the earlier one, and as the later one.
    pairs = F.concat(
        F.transform(F.sequence(F.col("tile"), F.col("tiles") - 1), lambda other: F.struct(F.col("tile").alias("i"), other.alias("j"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("tile")), lambda other: other < F.col("tile")), lambda other: F.struct(other.alias("i"), F.col("tile").alias("j"))),
    )
    met = dealt.select("label", "tile", "rep", "times", "embedding", F.explode(pairs).alias("pair")).select("label", "pair.*", "tile", "rep", "times", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        which = table.column("tile").to_numpy()
        first = _sum_links(table.filter(pa.array(which == i)))
        second = first if i == j else _sum_links(table.filter(pa.array(which == j)))
        found = list(_linked(first, second, i == j, least)) if len(first.ids) and len(second.ids) else []
        parts = [np.concatenate(part) for part in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("rep", "links", "top"), parts, strict=True)))

    found = stored(met.groupBy("label", "i", "j").applyInArrow(compare, "rep bigint, links bigint, top bigint"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "top"), "rep", "top").withColumnRenamed("node", "rep")
    placed = reps.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, "root").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"
    )
    linked = rows.where("_use").join(placed, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).select("vec_id", "label", "n_links", "component_id")
    alone = rows.where("NOT _use").select("vec_id", "label", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
