"""Duplicates, ages and year-to-year states of individuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import transition
from .skew import group_sizes, with_group_values


def key_audit(df: DataFrame, key: list[str], approx: bool = False) -> DataFrame:
    """One row: rows, distinct keys, keys held by several rows, rows beyond the first of a key.

    ``approx`` estimates the distinct keys without a shuffle by key and leaves out the rest.
    """
    if approx:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct(F.struct(*key), 0.01).alias("n_keys"))
    return group_sizes(df, key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_duplicated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus_rows"),
    )


def tag_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Every row with the number of rows of its key (``count``) and whether it is shared (``dups``)."""
    tagged = with_group_values(df, key, {"count": F.count(F.lit(1))})
    return tagged.withColumn("dups", F.col("count") > 1)


def drop_dead_duplicates(df: DataFrame, key: list[str], last_status: str, dead: str = "0") -> DataFrame:
    """Delete rows whose key is shared and whose raw last status is ``dead``.

    Raw means before codes are recoded: ``PD`` and missing rows stay.
    """
    is_dead = F.col(last_status).eqNullSafe(F.lit(dead))
    counted = with_group_values(df, key, {"_n": F.count(F.lit(1))})
    return counted.filter(~is_dead | (F.col("_n") == 1)).drop("_n")


def span(df: DataFrame, key: list[str], year: str) -> DataFrame:
    """First and last year per individual."""
    return df.groupBy(*key).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def age_from_start(birth: Column, start: Column, first_start: Column) -> Column:
    """Age at ``start``; without a birth year the first record counts as age 1."""
    return start - F.coalesce(birth, first_start) + 1


def with_age(
    df: DataFrame,
    key: list[str],
    birth: str = "birth",
    start: str = "start_int",
    gap_mode: str = "true",
    name: str = "yearsAlive",
) -> DataFrame:
    """Age at the start of each interval record.

    ``gap_mode="mirrored"`` reproduces ages handed out newest first against a list
    of years running oldest first: the record with the r-th largest start gets the
    largest age minus the distance of the r-th smallest start from the first. Both
    modes agree for individuals without gaps. The years kept per individual are
    distinct, so a heavily copied individual costs no more than any other.
    """
    if gap_mode not in ("true", "mirrored"):
        raise ValueError(f"gap_mode must be 'true' or 'mirrored', not {gap_mode!r}")
    if gap_mode == "true":
        rows = with_group_values(df, key, {"_first": F.min(start)})
        age = age_from_start(F.col(birth), F.col(start), F.col("_first"))
        return rows.withColumn(name, age.cast("double")).drop("_first")
    rows = with_group_values(df, key, {"_years": F.collect_set(start)})
    ys = F.array_sort("_years")
    first, last = F.get(ys, F.lit(0)), F.get(ys, F.size(ys) - 1)
    from_top = F.size(ys) - F.array_position(ys, F.col(start)).cast("int")
    age = age_from_start(F.col(birth), last, first) - (F.get(ys, from_top) - first)
    return rows.withColumn(name, age.cast("double")).drop("_years")


def transitions_long(df: DataFrame, key: list[str], year: str, status: str) -> DataFrame:
    """Interval records from long (individual, year, status) rows, one per pair of consecutive years.

    Each row is a possible end of its year's interval and start of the next one;
    a grouped maximum meets the two, so no individual is gathered in one place.
    Several rows for an individual and year count as alive if any is.
    """
    ends = F.array(
        F.struct(F.col(year).alias("end_int"), F.col(status).alias("_cur"), F.lit(None).cast("double").alias("_prev")),
        F.struct(
            (F.col(year) + 1).alias("end_int"), F.lit(None).cast("double").alias("_cur"), F.col(status).alias("_prev")
        ),
    )
    met = (
        df.select(*key, F.col(year).cast("int").alias(year), F.col(status).cast("double").alias(status))
        .select(*key, F.inline(ends))
        .groupBy(*key, "end_int")
        .agg(F.max("_cur").alias("_cur"), F.max("_prev").alias("_prev"))
    )
    return (
        met.withColumn("survival", transition("_prev", "_cur"))
        .filter(F.col("survival").isNotNull())
        .select(*key, (F.col("end_int") - 1).alias("start_int"), "end_int", "survival")
    )
