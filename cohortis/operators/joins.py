"""Left, semi and anti joins, lookups, climate joins and row binds.

Joins are left to Spark: both inputs are shuffled, so adaptive execution can split
a partition that one key fills. ``unique=True`` says the right side has at most
one row per key, perhaps because it was grouped by them. ``small=True`` broadcasts
the right side after counting it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut
from .skew import filter_by_keys, key_join, split_join


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def _suffix_clashes(
    left: DataFrame, right: DataFrame, keys: list[str], suffix: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    return (
        left.withColumnsRenamed({c: c + suffix[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffix[1] for c in clash}),
    )


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    suffix: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = False,
    small: bool = False,
    unique: bool = False,
) -> DataFrame:
    """Left join on equal keys; other columns of the same name get the suffixes.

    ``null_safe`` lets a missing key match a missing key.
    """
    left, right = _suffix_clashes(left, right, on, suffix)
    if unique and not small:
        return split_join(left, right, on, "left", null_safe)
    fits = small and right.count() <= BROADCAST_ROWS
    return key_join(left, right, on, "left", null_safe, small=fits)


def left_join_natural(left: DataFrame, right: DataFrame, null_safe: bool = False, **how: bool) -> DataFrame:
    """Left join on every shared column."""
    on = shared_columns(left, right)
    if not on:
        raise ValueError("the tables share no column")
    return left_join(left, right, on, null_safe=null_safe, **how)


def fan_out_join(
    left: DataFrame, right: DataFrame, on: list[str], suffix: tuple[str, str] = ("_x", "_y"), null_safe: bool = False
) -> DataFrame:
    """Left join of a table with unique keys to many rows per key, safe against keys heavy on the right.

    The right side of a left join cannot be split. So the many rows look up their one left row; left rows nobody
    asked for are added. ``null_safe`` lets a missing key match a missing key.
    """
    left, right = _suffix_clashes(left, right, on, suffix)
    met = split_join(right, left, on, "inner", null_safe)
    lone = filter_by_keys(left, right, on, "left_anti", null_safe)
    return lone.unionByName(met, allowMissingColumns=True)


def semi_join(left: DataFrame, right: DataFrame, on: list[str], null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return filter_by_keys(left, right, on, "left_semi", null_safe)


def anti_join(left: DataFrame, right: DataFrame, on: list[str], null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return filter_by_keys(left, right, on, "left_anti", null_safe)


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, small: bool = False) -> DataFrame:
    """Bring one column of a table with unique keys to the rows."""
    return left_join(df, dim.select(key, value), [key], small=small, unique=True)


def join_climate(df: DataFrame, climate: DataFrame, on: str = "WINTER") -> DataFrame:
    """Add one row of season values per record; the season table is computed once, counted, then broadcast."""
    return left_join(df, cut(climate), [on], small=True)


def pair_on(left: DataFrame, right: DataFrame, key: str, suffix: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Pair two summary tables by key (inner), where scripts would trust row order."""
    left, right = _suffix_clashes(left, right, [key], suffix)
    return key_join(left, right, [key], null_safe=False)


def union_fill(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.select(*key).distinct()


def order_by_value(df: DataFrame, col: str, desc: bool = False) -> DataFrame:
    """Rows sorted for presentation, missing values last."""
    c: Column = F.col(col)
    return df.orderBy(c.desc_nulls_last() if desc else c.asc_nulls_last())
