"""Rates, abundances, compositions, climate summaries, profiles.

All sums, means and counts combine before the shuffle, so a group that holds
much of the table costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import as_col
from ..session import cut
from .quantiles import GROUP_ROWS, HINGES, fits_broadcast, has_large_group, hinges, number, percentiles, quantiles
from .skew import key_join, split_join


def total(col: str | Column, na_rm: bool = True) -> Column:
    """Sum; of nothing it is 0. With ``na_rm=False`` any missing value makes it missing."""
    c = as_col(col)
    if na_rm:
        return F.coalesce(F.sum(c), F.lit(0).cast("double"))
    return F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(c), F.lit(0).cast("double")))


def mean(col: str | Column, na_rm: bool = True) -> Column:
    c = as_col(col)
    return F.avg(c) if na_rm else F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def sd(col: str | Column, na_rm: bool = True) -> Column:
    """Sample standard deviation; missing for a single value."""
    c = as_col(col)
    return F.stddev_samp(c) if na_rm else F.when(F.count(c) == F.count(F.lit(1)), F.stddev_samp(c))


def n_where(cond: Column, na_rm: bool = True) -> Column:
    """Number of rows where the condition holds; poisoned by missing ones when ``na_rm=False``."""
    n = F.count_if(cond)
    return n if na_rm else F.when(F.count(cond) == F.count(F.lit(1)), n)


# -- survival ---------------------------------------------------------------


def survival_rate(
    df: DataFrame,
    start: str,
    end: str,
    by: list[str] = (),
    means: dict[str, str] | None = None,
    names: tuple[str, str, str] = ("rate", "abund_start", "abund_end"),
) -> DataFrame:
    """Share of those alive at ``start`` that are alive at ``end``, with both counts.

    ``means`` adds covariate means (output name -> column) over the same rows.
    An empty selection gives a NULL rate.
    """
    alive = df.filter(F.col(start) == 1)
    n_start, n_end = F.count(F.lit(1)), F.count_if(F.col(end) == 1)
    return alive.groupBy(*by).agg(
        F.try_divide(n_end.cast("double"), n_start).alias(names[0]),
        n_start.alias(names[1]),
        n_end.alias(names[2]),
        *[F.avg(c).alias(name) for name, c in (means or {}).items()],
    )


def survival_rates(df: DataFrame, pairs: dict[str, tuple[str, str]], name: str = "pair") -> DataFrame:
    """:func:`survival_rate` over all rows for several pairs of columns (label -> start, end), in one pass."""

    def figures(label: str, start: str, end: str) -> Column:
        alive = F.col(start) == 1
        n_start, n_end = F.count_if(alive), F.count_if(alive & (F.col(end) == 1))
        rate = F.try_divide(n_end.cast("double"), n_start)
        return F.struct(F.lit(label).alias(name), rate.alias("rate"), n_start.alias("abund_start"), n_end.alias("abund_end"))

    return df.agg(F.array(*[figures(k, *pair) for k, pair in pairs.items()]).alias("_pairs")).select(F.inline("_pairs"))


def interval_survival(df: DataFrame, by: list[str] = ("interval",), survival: str = "survival") -> DataFrame:
    """Proportion survived and number of records per interval."""
    return df.groupBy(*by).agg(
        F.try_divide(F.count_if(F.col(survival) == 1).cast("double"), F.count(F.lit(1))).alias("propSurv"),
        F.count(F.lit(1)).alias("abund"),
    )


def abundance(df: DataFrame, by: list[str], cols: dict[str, str]) -> DataFrame:
    """Sums of 0/1 columns per group (output name -> column)."""
    return df.groupBy(*by).agg(*[total(c).alias(name) for name, c in cols.items()])


# -- counts -----------------------------------------------------------------


def freq(df: DataFrame, by: list[str], na: str = "keep") -> DataFrame:
    """Rows per combination of values; ``na="drop"`` leaves out combinations with a missing value."""
    if na == "drop":
        df = df.dropna(subset=list(by))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def freq_missing(df: DataFrame, col: str) -> DataFrame:
    """Rows with and without a value."""
    return df.groupBy(F.col(col).isNull().alias("is_missing")).agg(F.count(F.lit(1)).alias("n"))


# -- composition ------------------------------------------------------------


def sum_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the sum of each column."""
    return df.agg(*[total(c).alias(c) for c in cols])


def composition(
    df: DataFrame, by: list[str], parts: list[str], total_col: str | None = None, na_rm_total: bool = True
) -> DataFrame:
    """Per group: total, and each part's sum (``<part>sum``) and share (``<part>per``).

    Without ``total_col`` the total is the sum of the parts.
    """
    sums = [total(p).alias(f"{p}sum") for p in parts]
    whole = [total(total_col, na_rm_total).alias("Plottotal")] if total_col else []
    out = df.groupBy(*by).agg(*whole, *sums)
    if not total_col:
        out = out.withColumn("Plottotal", reduce(lambda a, b: a + b, [F.col(f"{p}sum") for p in parts]))
    return out.withColumns({f"{p}per": F.try_divide(F.col(f"{p}sum"), F.col("Plottotal")) for p in parts})


def mean_by(df: DataFrame, by: list[str], cols: dict[str, str], na_rm: bool = True) -> DataFrame:
    """Means per group (output name -> column)."""
    return df.groupBy(*by).agg(*[mean(c, na_rm).alias(name) for name, c in cols.items()])


# -- climate ----------------------------------------------------------------


def climate_summary(
    df: DataFrame,
    by: list[str],
    medians: dict[str, str] | None = None,
    means: dict[str, str] | None = None,
    sds: dict[str, str] | None = None,
    at_least: dict[str, tuple[str, float]] | None = None,
    count: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Season summary: medians, means, standard deviations and days at or above a threshold.

    Missing values are left out everywhere. ``count`` names a row count column.
    """
    aggs = [F.avg(c).alias(n) for n, c in (means or {}).items()]
    aggs += [F.stddev_samp(c).alias(n) for n, c in (sds or {}).items()]
    aggs += [F.count_if(F.col(c) >= t).alias(n) for n, (c, t) in (at_least or {}).items()]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    if not medians or not has_large_group(df, by, group_rows):
        return df.groupBy(*by).agg(*[F.median(number(c)).alias(n) for n, c in (medians or {}).items()], *aggs)
    parts = [df.groupBy(*by).agg(*aggs)] if aggs else []
    parts += [quantiles(df, by, c, {n: 0.5}, group_rows) for n, c in (medians or {}).items()]
    return reduce(lambda a, b: key_join(a, b, by), parts)


def summary_of_summaries(df: DataFrame, medians: dict[str, str], means: dict[str, str] | None = None) -> DataFrame:
    """Medians and means over the rows of a summary table (one row per season)."""
    return df.agg(
        *[F.median(c).alias(n) for n, c in medians.items()],
        *[F.avg(c).alias(n) for n, c in (means or {}).items()],
    )


def temperature_summary(
    df: DataFrame, by: list[str], cold: tuple[str, float], spec: dict[str, str], na_rm: bool = False
) -> DataFrame:
    """Cold-day count plus mean and sd of each measure (output suffix -> column).

    With ``na_rm=False`` a missing value makes its group's figures missing.
    """
    aggs = [n_where(F.col(cold[0]) <= cold[1], na_rm).alias("below")]
    for name, c in spec.items():
        aggs += [mean(c, na_rm).alias(f"mean{name}"), sd(c, na_rm).alias(f"sd{name}")]
    return df.groupBy(*by).agg(*aggs)


def standardize(df: DataFrame, col: str, name: str) -> DataFrame:
    """``(x - mean) / sd`` over all rows; the two figures enter as one scalar subquery."""
    figures = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).alias("f")).scalar()
    return df.withColumn(name, F.try_divide(F.col(col) - figures["m"], figures["s"]))


# -- classes, profiles, boxes -------------------------------------------------


def class_stats(df: DataFrame, cls: str | Column, y: str, name: str = "class") -> DataFrame:
    """Rows, mean and sd of an outcome per class."""
    return df.groupBy(as_col(cls).alias(name)).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd")
    )


def pooled_class_stats(df: DataFrame, cls: str, y: str, pools: dict[str, list], name: str = "pool") -> DataFrame:
    """Class statistics after pooling classes; classes outside every pool are left out."""
    label = F.lit(None).cast("string")
    for pool, members in pools.items():
        label = F.when(F.col(cls).isin(*members), F.lit(pool)).otherwise(label)
    pooled = df.withColumn(name, label).filter(F.col(name).isNotNull())
    return class_stats(pooled, name, y, name)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def profile(df: DataFrame, cols: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per column: values, missing, min, quartiles, mean, max, sd."""
    pair = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.select(F.inline(F.array(*pair)))
    figures = [
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("sd"),
    ]
    if df.count() <= group_rows:
        return percentiles(long, ["column"], number("value"), QUARTILES, *figures)
    basic = long.groupBy("column").agg(*figures)
    return key_join(basic, quantiles(long, ["column"], "value", QUARTILES, group_rows), ["column"])


def box_stats(df: DataFrame, by: list[str], x: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per group: hinges, whisker ends within 1.5 times their distance from them, outliers beyond those."""
    q = cut(hinges(df, by, x, group_rows))
    values = df.select(*by, number(x).alias("_x")).filter(F.col("_x").isNotNull())
    if fits_broadcast(q):
        boxed = key_join(values, q, by, small=True)
    else:
        boxed = split_join(values, q, by, null_safe=True)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    within = F.col("_x").between(F.col("q1") - reach, F.col("q3") + reach)
    return boxed.groupBy(*by).agg(
        F.count("_x").alias("n"),
        *[F.first(n).alias(n) for n in HINGES],
        F.min(F.when(within, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(within, F.col("_x"))).alias("whisker_high"),
        F.count_if(~within).alias("n_outliers"),
    )
