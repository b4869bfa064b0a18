"""Row filters; a missing condition drops the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.season import to_date


def in_sites(df: DataFrame, col: str, sites: list[str] | tuple[str, ...]) -> DataFrame:
    return df.filter(F.col(col).isin(*sites))


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows complete in ``cols``; NaN counts as missing."""
    return df.dropna(subset=cols)


def since(df: DataFrame, date_col: str, first: str, site: tuple[str, str] | None = None) -> DataFrame:
    """Rows dated ``first`` or later, optionally of one site (column, value).

    Real date and timestamp columns are compared as they are, so the bound reaches the file scan.
    """
    typed = dict(df.dtypes)[date_col] in ("date", "timestamp", "timestamp_ntz")
    d = F.col(date_col) if typed else to_date(date_col)
    out = df.filter(d >= F.lit(first).cast("date"))
    return out.filter(F.col(site[0]) == site[1]) if site else out


def in_months(df: DataFrame, col: str, months: tuple[int, ...]) -> DataFrame:
    return df.filter(F.month(to_date(col)).isin(*months))


def drop_interval(df: DataFrame, label: str, col: str = "interval") -> DataFrame:
    return df.filter(F.col(col) != label)
