"""Keyed operators for tables in which one key may hold much of the rows.

A window by key sends all rows of a key to one task. A join need not: adaptive
execution reads a partition that one key fills in several tasks, as long as both
sides of the join come straight from their own shuffle. A grouped table does not
when it is joined on its grouping keys, since its partitioning is used again. So
the joins here carry the hash of the keys as one more key: a grouped side is
shuffled once more, one row per key, and the rows can be split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = True, small: bool = False
) -> DataFrame:
    """Join on equal keys, the columns of ``left`` followed by the other columns of ``right``.

    The right keys are renamed first, so tables derived from one another join cleanly.
    ``small`` broadcasts the right side; the caller knows its bound.
    """
    other = {k: f"__{k}" for k in keys}
    right = right.withColumnsRenamed(other)
    pairs = [F.col(k).eqNullSafe(F.col(o)) if null_safe else F.col(k) == F.col(o) for k, o in other.items()]
    match: Column = reduce(lambda a, b: a & b, pairs)
    joined = left.join(F.broadcast(right) if small else right, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*other.values())


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join to a table with at most one row per key, whose partitions adaptive execution can split on the left.

    Equal keys have equal hashes only within a type: keys whose types differ stay out of the hash.
    """
    alike = [k for k in keys if left.schema[k].dataType == right.schema[k].dataType]
    if not alike:
        return key_join(left, right, keys, how, null_safe)
    hashed = F.xxhash64(*alike)
    joined = key_join(left.withColumn("_hash", hashed), right.withColumn("_hash", hashed), [*keys, "_hash"], how, null_safe)
    return joined.drop("_hash")


def group_sizes(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_group_values(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Add aggregates of a row's group to the row (output name -> aggregate). Missing keys count as a key."""
    figures = df.groupBy(*keys).agg(*[v.alias(name) for name, v in values.items()])
    return split_join(df, figures, keys, "inner", null_safe=True)


def filter_by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str, null_safe: bool = True) -> DataFrame:
    """Semi or anti join (``how``).

    Adaptive execution cannot split the right side of these joins, so its keys are made distinct first, combined
    before the shuffle.
    """
    return split_join(left, right.select(*keys).distinct(), keys, how, null_safe)
