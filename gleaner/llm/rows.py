"""Rows told apart by their id and a hash of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def column(name: str) -> Column:
    """A column by its plain name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def names(columns: list[str]) -> list[Column]:
    """Columns by their plain names."""
    return [column(name) for name in columns]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds_map(field.dataType) for field in kind.fields)


def row_key(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """Id and 64-bit hash of the given columns (all, if none are given) as one struct.

    Equal rows have equal keys; rows of different ids never have, so a meeting of
    hashes can only join rows of one repeated id. Which columns are null is
    hashed too, and a map, which has no hash, by its text.
    """
    parts: list[Column] = []
    for field in docs.schema.fields if columns is None else [docs.schema[name] for name in columns]:
        own = column(field.name)
        parts += [own.isNull(), F.to_json(F.struct(own)) if _holds_map(field.dataType) else own]
    return F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(*parts).alias("hash"))


def whole(docs: DataFrame, name: str = "_row") -> Column:
    """All columns as one struct, so that they meet no other column of their name."""
    return F.struct(*names(docs.columns)).alias(name)


def unpacked(rows: DataFrame, docs: DataFrame, name: str = "_row") -> DataFrame:
    """The columns of ``docs`` back from their struct."""
    return rows.select(*[F.col(name).getField(c).alias(c) for c in docs.columns])
