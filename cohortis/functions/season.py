"""Interval labels, dates and season years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import as_col

# The winter months, December counting towards the next year.
WINTER_MONTHS = (12, 1, 2)


def interval_label(year: int | Column) -> Column:
    """Label of the interval that ends in ``year``: ``2019-2020``."""
    if isinstance(year, int):
        return F.lit(f"{year - 1}-{year}")
    return F.concat((year - 1).cast("string"), F.lit("-"), year.cast("string"))


def split_interval(df: DataFrame, col: str = "interval") -> DataFrame:
    """Add ``start_int`` and ``end_int`` as years, keeping the label."""
    ends = F.split(F.col(col), "-")
    return df.withColumns({
        "start_int": F.get(ends, F.lit(0)).try_cast("int"),
        "end_int": F.get(ends, F.lit(1)).try_cast("int"),
    })


def with_end_year(df: DataFrame, name: str = "WINTER") -> DataFrame:
    """The end year under the name the climate tables use."""
    return df.withColumn(name, F.col("end_int").cast("int"))


def to_date(col: str | Column) -> Column:
    """A date from a date, a timestamp or text; malformed text gives NULL."""
    return as_col(col).try_cast("date")


def date_parts(df: DataFrame, col: str) -> DataFrame:
    """Add two-digit ``month`` text and integer ``year``."""
    d = to_date(col)
    return df.withColumns({"month": F.date_format(d, "MM"), "year": F.year(d)})


def season_year(col: str | Column) -> Column:
    """Year a season is named after: December belongs to the following year."""
    d = to_date(col)
    return F.when(F.month(d) == 12, F.year(d) + 1).otherwise(F.year(d))
