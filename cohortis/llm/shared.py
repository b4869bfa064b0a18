"""Helpers of several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_ROWS = 2_000_000
SMALL_BYTES = 48 << 20  # values of the largest table that is broadcast


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions refer to as they are.

    An expression used inside a lambda would otherwise be copied into it and run once per element.
    """
    for name, c in columns.items():
        df = df.withColumn(name, F.explode(F.array(c)))
    return df


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Size of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = F.size(c) * 8 if not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType)) else F.octet_length(F.to_json(c))
        return F.coalesce(each, F.lit(0)) + 16
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 16
    return F.lit(16)


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows and the bytes of its values are few, else as it is for a shuffled join.

    Both are counted over the whole table, in one job.
    """
    width = F.lit(0)
    for f in df.schema:
        width = width + _bytes(F.col(f"`{f.name}`"), f.dataType)
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and found["b"] <= size else df


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
