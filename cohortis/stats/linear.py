"""Correlation tests, simple regression, one-way analysis of variance.

Any number of variable pairs is reduced in one pass; what returns to the driver
is a few figures per pair or class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import class_stats
from ..operators.quantiles import number
from ..session import cut
from . import dist
from .tails import tail_column

PAIR_BLOCK = 500  # classes that meet as many others in one key of the join of pairs


def _pearson(u: Column, v: Column) -> Column:
    """Correlation over the rows that have both; NULL without spread, where the built-in one fails in ANSI mode."""
    return F.try_divide(F.regr_sxy(u, v), F.sqrt(F.regr_sxx(u, v)) * F.sqrt(F.regr_syy(u, v)))


def corr(df: DataFrame, x: str, y: str, use: str = "pairwise", name: str = "r") -> DataFrame:
    """Pearson correlation; ``use="everything"`` gives NULL when any value is missing. NaN is missing."""
    u, v = number(x), number(y)
    r = _pearson(u, v)
    if use == "everything":
        r = F.when(F.count(F.when(u.isNotNull() & v.isNotNull(), 1)) == F.count(F.lit(1)), r)
    elif use != "pairwise":
        raise ValueError(f"use must be 'pairwise' or 'everything', not {use!r}")
    return df.agg(r.alias(name))


def corr_tests(df: DataFrame, pairs: list[tuple[str, str]], level: float = 0.95) -> DataFrame:
    """Per pair: complete rows, r, t, degrees of freedom, two-sided p, confidence limits.

    NaN is missing; where r is undefined (constant or infinite values) only the counts are given.
    """
    aggs = []
    for i, (x, y) in enumerate(pairs):
        u, v = number(x), number(y)
        aggs += [_pearson(u, v).alias(f"r{i}"), F.count_if(u.isNotNull() & v.isNotNull()).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    reach = dist.normal_quantile(0.5 + level / 2)
    out = []
    for i, (x, y) in enumerate(pairs):
        r, n = row[f"r{i}"], row[f"n{i}"]
        t = p = lo = hi = None
        r = None if r is None or math.isnan(r) else r
        if r is not None and n > 2:
            t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.copysign(math.inf, r)
            p = dist.t_p(t, n - 2) if math.isfinite(t) else 0.0
            if n > 3 and abs(r) < 1:
                z, half = math.atanh(r), reach / math.sqrt(n - 3)
                lo, hi = math.tanh(z - half), math.tanh(z + half)
        out.append((x, y, n, r, t, n - 2, p, lo, hi))
    return df.sparkSession.createDataFrame(
        out, "x string, y string, n bigint, r double, t double, df bigint, p_value double, conf_low double, conf_high double"
    )


def corr_test(df: DataFrame, x: str, y: str, level: float = 0.95) -> DataFrame:
    return corr_tests(df, [(x, y)], level)


class LinearFit:
    """``y = intercept + slope * x`` by least squares, from six sums."""

    def __init__(self, spark, y: str, x: str, n: int, slope: float, intercept: float, sxx: float, syy: float, sxy: float, mean_x: float):
        self._spark, self.y, self.x, self.n = spark, y, x, n
        self.slope, self.intercept = slope, intercept
        self.df_residual = n - 2
        self.mean_x, self.sxx = mean_x, sxx
        rss = max(syy - slope * sxy, 0.0)
        self.r_squared = 1 - rss / syy if syy else None
        self.sigma = math.sqrt(rss / self.df_residual) if self.df_residual > 0 else None
        if self.sigma is None:
            self.se = (None, None)
        else:
            self.se = (self.sigma * math.sqrt(1 / n + mean_x**2 / sxx), self.sigma / math.sqrt(sxx))

    def tidy(self) -> DataFrame:
        rows = []
        for term, est, se in (("(Intercept)", self.intercept, self.se[0]), (self.x, self.slope, self.se[1])):
            t = est / se if se else None
            rows.append((self.y, term, est, se, t, dist.t_p(t, self.df_residual) if t is not None else None))
        return self._spark.createDataFrame(
            rows, "response string, term string, estimate double, std_error double, statistic double, p_value double"
        )

    def glance(self) -> DataFrame:
        f = p = adjusted = None
        if self.se[1]:
            f = (self.slope / self.se[1]) ** 2
            p = dist.f_p(f, 1, self.df_residual)
            adjusted = 1 - (1 - self.r_squared) * (self.n - 1) / self.df_residual
        row = (self.y, self.x, self.r_squared, adjusted, self.sigma, f, p, self.df_residual, self.n)
        return self._spark.createDataFrame(
            [row],
            "response string, term string, r_squared double, adj_r_squared double, sigma double, statistic double, "
            "p_value double, df_residual bigint, n bigint",
        )

    def fitted(self) -> Column:
        return F.lit(self.intercept) + F.lit(self.slope) * F.col(self.x)

    def fitted_se(self) -> Column:
        """Standard error of the line at a row's x; NULL without residual degrees of freedom."""
        if self.sigma is None:
            return F.lit(None).cast("double")
        off = F.col(self.x) - F.lit(self.mean_x)
        return F.lit(self.sigma) * F.sqrt(F.lit(1 / self.n) + off * off / F.lit(self.sxx))


def lms(df: DataFrame, pairs: list[tuple[str, str]]) -> list[LinearFit | None]:
    """Simple regressions of (y, x) pairs on their complete rows, all in one pass.

    None where the slope is undefined (fewer than two distinct x). NaN is missing.
    """
    aggs = []
    for i, (y, x) in enumerate(pairs):
        u, v = number(y), number(x)
        aggs += [
            F.regr_count(u, v).alias(f"n{i}"),
            F.regr_slope(u, v).alias(f"b{i}"),
            F.regr_intercept(u, v).alias(f"a{i}"),
            F.regr_sxx(u, v).alias(f"xx{i}"),
            F.regr_syy(u, v).alias(f"yy{i}"),
            F.regr_sxy(u, v).alias(f"xy{i}"),
            F.regr_avgx(u, v).alias(f"mx{i}"),
        ]
    r = df.agg(*aggs).first()
    return [
        None
        if r[f"b{i}"] is None
        else LinearFit(
            df.sparkSession, y, x, r[f"n{i}"], r[f"b{i}"], r[f"a{i}"], r[f"xx{i}"], r[f"yy{i}"], r[f"xy{i}"], r[f"mx{i}"]
        )
        for i, (y, x) in enumerate(pairs)
    ]


def lm(df: DataFrame, y: str, x: str) -> LinearFit | None:
    return lms(df, [(y, x)])[0]


def lm_fitted(df: DataFrame, fit: LinearFit, name: str = "fitted", level: float = 0.95) -> DataFrame:
    """The trend line at every row's x, its standard error and its confidence limits (``std_error``, ``conf_low``, ``conf_high``)."""
    reach = dist.t_quantile(0.5 + level / 2, fit.df_residual) if fit.df_residual > 0 else 0.0
    line, se = fit.fitted(), fit.fitted_se()
    return df.withColumns({name: line, "std_error": se, "conf_low": line - F.lit(reach) * se, "conf_high": line + F.lit(reach) * se})


def _classes(df: DataFrame, y: str, group: str) -> DataFrame:
    """Class size, mean and sd."""
    return class_stats(df.dropna(subset=[y, group]), group, y)


def _decompose(stats: DataFrame) -> tuple[float, int, float, int]:
    """Sums of squares and degrees of freedom between and within classes, summed where the classes are."""
    whole = stats.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre")).first()
    if not whole["n"]:
        return 0.0, 0, 0.0, 0
    off = F.col("mean") - F.lit(whole["centre"])
    r = stats.agg(
        F.sum(F.col("n") * off * off).alias("between"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("sd") * F.col("sd"))), F.lit(0.0)).alias("within"),
    ).first()
    return r["between"], whole["k"] - 1, r["within"], whole["n"] - whole["k"]


def anova_oneway(df: DataFrame, y: str, group: str) -> DataFrame:
    """Two rows, the group and the residuals: degrees of freedom, sums of squares, F, p; NULL where undefined."""
    ssb, df1, ssw, df2 = _decompose(_classes(df, y, group))
    msb, msw = (ssb / df1 if df1 else None), (ssw / df2 if df2 else None)
    f = msb / msw if msb is not None and msw else None
    p = dist.f_p(f, df1, df2) if f is not None else None
    return df.sparkSession.createDataFrame(
        [(group, df1, ssb, msb, f, p), ("Residuals", df2, ssw, msw, None, None)],
        "term string, df bigint, sumsq double, meansq double, statistic double, p_value double",
    )


def tukey_hsd(df: DataFrame, y: str, group: str, level: float = 0.95) -> DataFrame:
    """Differences of class means with simultaneous limits and adjusted p-values, unequal sizes allowed.

    The result has a row per pair of classes. Without spread inside the classes only the differences are given.

    The class table stays in Spark: classes are dealt to blocks by hash, a class goes to every pair of blocks that holds
    its own, and pairs are made by an equal join on the blocks. Only the number of classes, the degrees of freedom and
    the mean square reach the driver, which fits the tail of the studentised range once for all pairs.
    """
    stats = cut(_classes(df, y, group).select("class", "n", "mean", "sd"))
    _, df1, ssw, df2 = _decompose(stats)
    mse, k = (ssw / df2 if df2 else 0.0), df1 + 1
    blocks = -(-k // PAIR_BLOCK)
    own = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")
    dealt = stats.select("class", "n", "mean", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    a, b = (dealt.select(*[F.col(c).alias(f"{c}_{side}") for c in dealt.columns]) for side in "ab")
    pairs = a.join(b, (F.col("own_a") == F.col("other_b")) & (F.col("other_a") == F.col("own_b")) & (F.col("class_a") < F.col("class_b")))
    diff = F.col("mean_b") - F.col("mean_a")
    named = pairs.select(F.concat(F.col("class_b").cast("string"), F.lit("-"), F.col("class_a").cast("string")).alias("comparison"), diff.alias("diff"), "n_a", "n_b")
    if not mse or k < 2:
        return named.select("comparison", "diff", *[F.lit(None).cast("double").alias(c) for c in ("statistic", "conf_low", "conf_high", "p_adj")])
    crit = dist.tukey_quantile(level, k, df2)
    scale = F.sqrt(F.lit(mse / 2) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    rows = named.withColumn("scale", scale).withColumn("statistic", F.abs("diff") / F.col("scale"))
    tail = tail_column(lambda q: 1 - dist.tukey_cdf(q, k, df2), F.col("statistic"), logarithm=False, least=1e-12, pieces=24)
    reach = F.lit(crit) * F.col("scale")
    return rows.select("comparison", "diff", "statistic", (F.col("diff") - reach).alias("conf_low"), (F.col("diff") + reach).alias("conf_high"), tail.alias("p_adj"))
