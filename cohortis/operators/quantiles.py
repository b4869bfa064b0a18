"""Exact interpolated quantiles and hinges per group, for groups of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one task.
That is right while groups are small; a counting pass finds the groups that are
not. For those the order statistics are narrowed down by rounds of bucket counts:
each round counts the rows of the current value window in buckets, picks the
bucket holding the wanted rank and shrinks the window to the smallest and largest
value seen in it, until one value is left. Buckets are of equal width in the
logarithm of the value until a window spans less than a factor of two, then in
the value itself; so the rounds are few for any values. A round shuffles at most
``BUCKETS`` counts per window.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut
from .skew import key_join

GROUP_ROWS = 1_000_000
BUCKETS = 1024
LARGEST = sys.float_info.max

# From the number of values to a place among the sorted ones, counted from 0; a fraction lies between two values.
Place = Callable[[Column], Column]

# The median, and the medians of the two halves, each with the middle value of an odd number.
HINGES: dict[str, Place] = {
    "q1": lambda n: F.floor((n + 3) / 2) / 2 - 1,
    "median": lambda n: (n - 1) / 2,
    "q3": lambda n: n - F.floor((n + 3) / 2) / 2,
}


def number(x: str) -> Column:
    """The column as a double with NaN as missing."""
    v = F.col(x).cast("double")
    return F.when(~F.isnan(v), v)


def fits_broadcast(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def has_large_group(df: DataFrame, by: list[str], group_rows: int = GROUP_ROWS) -> bool:
    """Whether some group has more rows than one task should hold; reads the key columns only."""
    return not df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_rows).isEmpty()


def percentiles(df: DataFrame, by: list[str], v: str | Column, probs: dict[str, float], *aggs: Column) -> DataFrame:
    """Built-in exact percentiles; all probabilities share one value table per group."""
    several = F.percentile(v, F.array(*[F.lit(p) for p in probs.values()])).alias("_p")
    out = df.groupBy(*by).agg(several, *aggs)
    return out.select("*", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(probs)]).drop("_p")


def ranked(df: DataFrame, by: list[str], places: dict[str, Place]) -> DataFrame:
    """Values of ``_v`` at places among the sorted values, out of counts per distinct value; groups without values are left out."""
    group = Window.partitionBy(*by)
    counts = df.filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count("_v").alias("_c"))
    sums = counts.withColumns({"_upto": F.sum("_c").over(group.orderBy("_v")), "_n": F.sum("_c").over(group)})

    def first_beyond(k: Column) -> Column:
        return F.min(F.when(F.col("_upto") > k, F.col("_v")))

    return sums.groupBy(*by).agg(
        *[
            between(first_beyond(F.floor(at)), first_beyond(F.ceil(at)), F.max(at - F.floor(at))).alias(name)
            for name, at in ((name, place(F.col("_n"))) for name, place in places.items())
        ]
    )


def magnitude(x: Column) -> Column:
    """The logarithm of a number's size with its sign: grows with the number, from the smallest double to the largest."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + F.lit(1076.0)))


def between(low: Column, high: Column, part: Column) -> Column:
    return F.when((part == 0) | (low == high), low).otherwise(low + part * (high - low))


def quantiles(
    df: DataFrame, by: list[str], x: str, probs: dict[str, float], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per group with a column per name in ``probs`` (name -> probability).

    Missing values are left out; a group without values gets NULLs. With no
    ``by`` the result is one row.
    """
    places = {name: (lambda n, p=p: F.lit(p) * (n - 1)) for name, p in probs.items()}
    return _at_places(df, by, x, places, lambda rows: percentiles(rows, by, "_v", probs), group_rows)


def hinges(df: DataFrame, by: list[str], x: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per group that has values: its median and hinges, ``q1`` and ``q3``."""
    return _at_places(df, by, x, HINGES, lambda rows: ranked(rows, by, HINGES), group_rows)


def _at_places(
    df: DataFrame, by: list[str], x: str, places: dict[str, Place], plain: Callable[[DataFrame], DataFrame], group_rows: int
) -> DataFrame:
    """``plain`` for groups that fit a task, rounds of counts for the others."""
    every = df.select(*by, number(x).alias("_v"))
    if not has_large_group(df, by, group_rows):
        return plain(every)
    rows = every.filter(F.col("_v").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = cut(sizes.filter(F.col("_n") > group_rows))
    if large.isEmpty():
        return plain(every)
    found = _refine(rows, large, by, places)
    if not by:
        return found
    small = key_join(every, large.select(*by), by, "left_anti", small=fits_broadcast(large))
    return plain(small).unionByName(found)


def _refine(rows: DataFrame, large: DataFrame, by: list[str], places: dict[str, Place]) -> DataFrame:
    """Values at places of the groups in ``large`` (keys, ``_n``, ``_lo``, ``_hi``)."""
    ranks = F.array(
        *[
            F.struct(F.lit(name).alias("_q"), F.lit(side).alias("_side"), edge(place(F.col("_n"))).cast("long").alias("_k"))
            for name, place in places.items()
            for side, edge in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    # One target per group and wanted rank: its value window and the rows below that window.
    targets = cut(
        large.select(*by, "_n", F.inline(ranks), "_lo", "_hi").withColumn("_below", F.lit(0).cast("long"))
    )
    while True:
        open_windows = targets.filter(F.col("_lo") < F.col("_hi"))
        if open_windows.isEmpty():
            break
        # Windows of a group are equal or disjoint, so a row falls into at most one.
        windows = cut(open_windows.select(*by, "_lo", "_hi").distinct())
        keyed = rows.withColumn("_one", F.lit(1))
        hit = key_join(keyed, windows.withColumn("_one", F.lit(1)), [*by, "_one"], small=fits_broadcast(windows))
        # Clipped, so that infinite values do not overflow. The largest value always takes the last bucket, hence
        # every round splits its window.
        here, low, high = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) for c in ("_v", "_lo", "_hi"))
        narrow = (F.signum(low) * F.signum(high) > 0) & (F.greatest(F.abs(low), F.abs(high)) / 2 <= F.least(F.abs(low), F.abs(high)))
        place_in = F.when(narrow, F.try_divide(here - low, high - low)).otherwise(
            F.try_divide(magnitude(here) - magnitude(low), magnitude(high) - magnitude(low)))
        at = F.floor(F.coalesce(place_in, F.lit(0.0)) * F.lit(float(BUCKETS)))
        bucket = F.when(F.col("_v") == F.col("_hi"), F.lit(BUCKETS - 1).cast("long")).otherwise(F.least(at, F.lit(BUCKETS - 1)))
        counts = (
            hit.filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .select(*by, F.col("_lo").alias("_wlo"), "_v", bucket.alias("_b"))
            .groupBy(*by, "_wlo", "_b")
            .agg(F.count("_v").alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
        )
        upto = Window.partitionBy(*by, "_wlo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        wanted = open_windows.withColumn("_wlo", F.col("_lo"))
        rank_in = F.col("_k") - F.col("_below")
        narrowed = (
            key_join(wanted, counts, [*by, "_wlo"])
            .filter((rank_in >= F.col("_before")) & (rank_in < F.col("_before") + F.col("_c")))
            .select(
                *by, "_n", "_q", "_side", "_k",
                F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"),
            )
        )
        targets = cut(targets.filter(F.col("_lo") >= F.col("_hi")).select(*narrowed.columns).unionByName(narrowed))
    aggs = []
    for name, place in places.items():
        pos = place(F.col("_n"))
        low = F.max(F.when((F.col("_q") == name) & (F.col("_side") == "lo"), F.col("_lo")))
        high = F.max(F.when((F.col("_q") == name) & (F.col("_side") == "hi"), F.col("_lo")))
        part = F.max(pos - F.floor(pos))
        aggs.append(between(low, high, part).alias(name))
    return targets.groupBy(*by).agg(*aggs)
