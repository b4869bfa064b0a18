"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..order_panel import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUPS = ("panel", "scalars", "aggregates", "joins", "models")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables`; ``sql`` is its equivalent, where there is one."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Floating columns to six places; sums come in any order."""
    return df.select(
        *[F.round(F.col(c), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def as_long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def load() -> None:
    for g in GROUPS:
        import_module(f"{__name__}.{g}")
