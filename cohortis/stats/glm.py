"""Logistic models on compressed cells.

Rows with the same outcome and covariates are one cell with a weight. A weighted
fit on cells equals the fit on rows, and so do its deviance and residual sums
when they are weighted too; a table of few distinct covariate values shrinks to
a few rows before the iterations start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dist
from .absorbed import AbsorbedFit, fit_absorbed
from .irls import Fit, fit_all, inv_logit

# Columns a factor may have in a design; a factor of more levels is absorbed (see ``absorbed.py``).
EXPANDED = 200

TIDY = "term string, estimate double, std_error double, statistic double, p_value double"


def in_order(levels: list) -> list:
    """Levels in factor order: by number if all of them are numbers, also as text, else by text."""
    try:
        return sorted(levels, key=lambda v: (float(v), str(v)))
    except ValueError:
        return sorted(levels)


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=list(dict.fromkeys(cols)))


def to_cells(df: DataFrame, y: str, terms: list[str], group: str | None = None) -> DataFrame:
    """Distinct (outcome, covariates[, group]) with their number of rows ``w``; incomplete rows are left out."""
    keys = list(dict.fromkeys([*terms, *([group] if group else [])]))
    used = complete(df.select(F.col(y).cast("double").alias("y"), *keys), ["y", *keys])
    return used.groupBy("y", *keys).agg(F.count(F.lit(1)).cast("double").alias("w"))


@dataclass
class Design:
    """Named numeric columns of a model; a factor gives one 0/1 column per level but the first.

    Products of two columns of a factor are 0, so sums over them are never asked of Spark.
    """

    names: list[str] = field(default_factory=list)
    exprs: list[Column] = field(default_factory=list)
    factor_of: list[str | None] = field(default_factory=list)
    term_of: list[str] = field(default_factory=list)

    def exclusive(self, i: int, j: int) -> bool:
        """Whether columns ``i`` and ``j`` are different levels of one factor."""
        return i != j and self.factor_of[i] is not None and self.factor_of[i] == self.factor_of[j]

    @classmethod
    def of(cls, cells: DataFrame, terms: list[str], factors: list[str] = ()) -> Design:
        out = cls()
        for t in terms:
            if t not in factors:
                out.names.append(t)
                out.exprs.append(F.col(t).cast("double"))
                out.factor_of.append(None)
                out.term_of.append(t)
                continue
            levels = in_order([r[0] for r in cells.where(F.col(t).isNotNull()).select(t).distinct().limit(EXPANDED + 2).collect()])
            if len(levels) > EXPANDED + 1:
                raise ValueError(f"{t} has more than {EXPANDED + 1} levels: only one such factor can be in a model")
            for level in levels[1:]:
                out.names.append(f"{t}[{level}]")
                out.exprs.append((F.col(t) == F.lit(level)).cast("double"))
                out.factor_of.append(t)
                out.term_of.append(t)
        return out

    def apply(self, cells: DataFrame, keep: list[str]) -> DataFrame:
        return cells.select(*keep, *[e.alias(f"x{j}") for j, e in enumerate(self.exprs)])

    def columns_of(self, terms: list[str]) -> list[int]:
        """Columns of the given terms, in the order of the terms."""
        return [j for t in terms for j, own in enumerate(self.term_of) if own == t]

    def only(self, columns: list[int]) -> Design:
        return Design(*([values[j] for j in columns] for values in (self.names, self.exprs, self.factor_of, self.term_of)))


def linear_predictor(coefs: list[float], exprs: list[Column]) -> Column:
    eta = F.lit(float(coefs[0]))
    for b, x in zip(coefs[1:], exprs):
        eta = eta + F.lit(float(b)) * x
    return eta


class GlmFit:
    """A fitted logistic model; tables are DataFrames, figures plain floats.

    Columns that repeat earlier ones are listed with missing estimates.
    """

    def __init__(self, spark, family: str, y: str, design: Design, fit: Fit):
        self.aliased = [design.names[j] for j in fit.aliased]
        self.design = design.only(fit.columns)
        self._spark, self.family, self.y, self.converged = spark, family, y, fit.converged
        self.terms = ["(Intercept)", *self.design.names]
        self.coefs = fit.coefs
        sums, p = fit.sums, len(fit.coefs)
        self.n = int(round(sums["n"]))
        self.df_residual, self.df_null = self.n - p, self.n - 1
        self.deviance, self.loglik = sums["deviance"], sums["loglik"]
        mean = sums["ysum"] / sums["n"]
        at_mean = sum(q * math.log(q) for q in (mean, 1 - mean) if q > 0)
        self.null_deviance = 2 * (sums["saturated"] - sums["n"] * at_mean)
        self._rss = {k: sums[k] for k in ("deviance", "working", "pearson", "response")}
        self.dispersion = sums["pearson"] / self.df_residual if family == "quasibinomial" else 1.0
        self.aic = None if family == "quasibinomial" else -2 * self.loglik + 2 * p
        self.vcov = self.dispersion * fit.covariance
        self.std_errors = np.sqrt(np.diag(self.vcov))

    def tidy(self) -> DataFrame:
        rows = []
        for term, est, se in zip(self.terms, self.coefs.tolist(), self.std_errors.tolist()):
            stat = est / se if se else None
            p = None
            if stat is not None:
                p = dist.t_p(stat, self.df_residual) if self.family == "quasibinomial" else dist.normal_p(stat)
            rows.append((term, est, se, stat, p))
        rows += [(term, None, None, None, None) for term in self.aliased]
        return self._spark.createDataFrame(rows, TIDY)

    def glance(self) -> DataFrame:
        row = (
            self.family, self.null_deviance, self.df_null, self.deviance, self.df_residual, self.dispersion, self.aic,
            self.loglik if self.aic is not None else None, self.n, self.converged,
        )
        return self._spark.createDataFrame(
            [row],
            "family string, null_deviance double, df_null bigint, deviance double, df_residual bigint, "
            "dispersion double, aic double, loglik double, n bigint, converged boolean",
        )

    def rmse(self, kind: str = "working") -> float:
        """Root mean square of the ``deviance``, ``working``, ``pearson`` or ``response`` residuals."""
        return math.sqrt(self._rss[kind] / self.n)

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return df.withColumn(name, inv_logit(linear_predictor(self.coefs.tolist(), self.design.exprs)))


def fit_many(
    cells: DataFrame, y: str, models: list[tuple[list[str], str]], factors: list[str] = (), max_iter: int = 50, missing: bool = False
) -> list[GlmFit]:
    """Fit several (terms, family) on one cell table (``y``, all terms, ``w``), all in the same passes over it.

    With ``missing`` the terms of the cells may be null, and a model uses the cells that have all of its own.
    """
    design = Design.of(cells, list(dict.fromkeys(t for terms, _ in models for t in terms)), factors)
    x = design.apply(cells, ["y", "w"])
    wanted = [design.columns_of(terms) for terms, _ in models]
    fits = fit_all(x, len(design.names), design.exclusive, wanted, max_iter, missing)
    return [GlmFit(cells.sparkSession, family, y, design, fit) for fit, (_, family) in zip(fits, models)]


def fit_cells(
    cells: DataFrame, y: str, terms: list[str], factors: list[str] = (), family: str = "binomial", max_iter: int = 50
) -> GlmFit:
    """Fit on a cell table (``y``, terms, ``w``); persist it when fitting several models."""
    return fit_many(cells, y, [(terms, family)], factors, max_iter)[0]


def glm_logit(
    df: DataFrame, y: str, terms: list[str], factors: list[str] = (), family: str = "binomial", absorb: str | None = None
) -> GlmFit | AbsorbedFit:
    """Binomial logit model of a 0/1 outcome; no terms gives the intercept-only model.

    A factor of more than ``EXPANDED`` levels (counted), or the one named by ``absorb``, is absorbed: its effects are a
    table, in which they are also fitted; see :mod:`.absorbed`.
    """
    cells = to_cells(df, y, terms).persist()
    try:
        wide = [absorb] if absorb else _wide_factors(cells, [t for t in terms if t in factors])
        if wide:
            narrow = [t for t in terms if t != wide[0]]
            return fit_absorbed(cells, y, narrow, Design.of(cells, narrow, factors), wide[0], family)
        return fit_cells(cells, y, terms, factors, family)
    finally:
        cells.unpersist()


def _wide_factors(cells: DataFrame, factors: list[str]) -> list[str]:
    """Factors of more levels than a design has room for."""
    if not factors:
        return []
    counts = cells.agg(*[F.count_distinct(t).alias(t) for t in factors]).first()
    return [t for t in factors if counts[t] > EXPANDED + 1]


def glm_quasi(df: DataFrame, y: str, terms: list[str], factors: list[str] = ()) -> GlmFit:
    """Same coefficients for outcomes in [0, 1]; standard errors scaled by the Pearson dispersion, t tests, no AIC."""
    return glm_logit(df, y, terms, factors, "quasibinomial")


def glm_by_class(df: DataFrame, y: str, factor: str) -> DataFrame:
    """The one-factor model in closed form, as a table: logit of each class rate against the first class.

    A class that is all 0 or all 1 has no finite estimate and gets NULLs.
    """
    rates = complete(df, [y, factor]).groupBy(factor).agg(F.sum(y).alias("k"), F.count(y).alias("n"))
    baseline = rates.agg(F.min_by(F.struct("k", "n"), factor).alias("b")).select("b.*")
    k0, n0 = baseline.select("k").scalar(), baseline.select("n").scalar()
    first = rates.agg(F.min(factor)).scalar()

    def logit(k: Column, n: Column) -> Column:
        return F.when((k > 0) & (k < n), F.log(k / (n - k)))

    def variance(k: Column, n: Column) -> Column:
        return F.when((k > 0) & (k < n), 1 / k + 1 / (n - k))

    base = rates.select(factor, "k", "n", k0.alias("k0"), n0.alias("n0"), first.alias("first"))
    k, n, k0, n0 = (F.col(c) for c in ("k", "n", "k0", "n0"))
    is_base = F.col(factor) == F.col("first")
    return base.select(
        F.when(is_base, "(Intercept)").otherwise(F.concat(F.lit(f"{factor}["), F.col(factor).cast("string"), F.lit("]"))).alias("term"),
        F.when(is_base, logit(k, n)).otherwise(logit(k, n) - logit(k0, n0)).alias("estimate"),
        F.sqrt(F.when(is_base, variance(k, n)).otherwise(variance(k, n) + variance(k0, n0))).alias("std_error"),
    )


def step_aic(df: DataFrame, y: str, terms: list[str], factors: list[str] = ()) -> tuple[GlmFit, DataFrame]:
    """Drop terms one at a time while that lowers the AIC; returns the last model and the trace.

    Every model is fitted to the rows complete in all starting terms, so the AICs compare. All models of a step are
    fitted together: the number of jobs grows with the steps, not with the terms that each could drop.
    """
    cells = to_cells(df, y, terms).persist()
    trace = []
    try:
        fit, kept, step = fit_cells(cells, y, terms, factors), list(terms), 0
        trace.append((step, "<none>", len(fit.coefs), fit.deviance, fit.aic, True))
        while kept:
            step += 1
            smaller = fit_many(cells, y, [([k for k in kept if k != t], "binomial") for t in kept], factors)
            tried = dict(zip(kept, smaller))
            best = min(tried, key=lambda t: tried[t].aic)
            better = tried[best].aic < fit.aic
            trace += [
                (step, f"- {t}", len(f.coefs), f.deviance, f.aic, better and t == best) for t, f in tried.items()
            ]
            if not better:
                break
            fit, kept = tried[best], [k for k in kept if k != best]
    finally:
        cells.unpersist()
    schema = "step bigint, term string, n_coef bigint, deviance double, aic double, chosen boolean"
    return fit, df.sparkSession.createDataFrame(trace, schema)
