"""Logistic models with one factor of any number of levels.

The effects of the factor's levels are a table of their own. A Newton step sums cells by level; there the level's own
effect is eliminated, and only the Schur complement of the other terms, of their size squared, reaches the driver. Its
solution goes back to the levels as constants. Neither the levels nor anything as wide as them is ever collected.
"""

from __future__ import annotations

import json
import math
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join
from ..session import cut
from . import dist
from .irls import ALIASED, NOISE, TOL, centres, figures, inv_logit
from .tails import tail_column

if TYPE_CHECKING:
    from .glm import Design

TIDY = "term string, estimate double, std_error double, statistic double, p_value double"


def _sum(columns: list[Column]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out


def _constants(values: list[float]) -> Column:
    """An array that the generated code refers to, so that every step runs the same code."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


class AbsorbedFit:
    """A fitted model; ``levels(level, effect)`` holds the intercept of each level of the factor."""

    def __init__(self, y, design: Design, factor: str, family: str, beta, schur, mid, levels: DataFrame, sums, converged: bool, aliased: list[str]):
        self.y, self.design, self.factor, self.family, self.converged, self.aliased = y, design, factor, family, converged, aliased
        self.terms, self.beta, self._mid, self._sums_by_level = list(design.names), np.asarray(beta), np.asarray(mid), levels
        self.n, self.n_levels = int(round(sums["n"])), sums["levels"]
        p = len(self.beta)
        self.n_coef = p + self.n_levels
        self.df_residual, self.df_null = self.n - self.n_coef, self.n - 1
        self.deviance, self.loglik = sums["deviance"], sums["loglik"]
        mean = sums["ysum"] / sums["n"]
        self.null_deviance = 2 * (sums["saturated"] - sums["n"] * sum(q * math.log(q) for q in (mean, 1 - mean) if q > 0))
        self._rss = {k: sums[k] for k in ("deviance", "working", "pearson", "response")}
        quasi = family == "quasibinomial"
        self.dispersion = sums["pearson"] / self.df_residual if quasi else 1.0
        self.aic = None if quasi else -2 * self.loglik + 2 * self.n_coef
        self.vcov = self.dispersion * (np.linalg.pinv(schur) if p else np.zeros((0, 0)))
        self.levels = levels.select("level", (F.col("alpha") - F.lit(float(self._mid @ self.beta))).alias("effect"))

    def rmse(self, kind: str = "working") -> float:
        return math.sqrt(self._rss[kind] / self.n)

    def _spread(self, shares: list[Column]) -> Column:
        """Variance that the other terms' estimates give to a sum with these weights."""
        return _sum([shares[i] * shares[j] * F.lit(float(self.vcov[i, j])) for i in range(len(shares)) for j in range(len(shares))])

    def tidy(self) -> DataFrame:
        """A row per term and level; the first level, by number if all are numbers, is the intercept.

        Standard errors and p-values of the levels are computed in their table.
        """
        spark, p = self._sums_by_level.sparkSession, len(self.beta)
        rows = self._sums_by_level.withColumns({f"s{j}": F.try_divide(F.col(f"b{j}"), F.col("a")) for j in range(p)})
        number = F.col("level").cast("string").try_cast("double")
        numbers = rows.agg(F.count_if(number.isNull())).first()[0] == 0
        order = F.struct(number if numbers else F.lit(0.0), F.col("level").cast("string"))
        base = rows.agg(F.min_by(F.struct("level", "alpha", "a", *[f"s{j}" for j in range(p)]), order).alias("x")).first()["x"]
        own = [F.col(f"s{j}") for j in range(p)]
        apart = [c - F.lit(base[f"s{j}"]) for j, c in enumerate(own)]
        noise = lambda c: F.try_divide(F.lit(self.dispersion), c)
        others = rows.where(~F.col("level").eqNullSafe(F.lit(base["level"]))).select(
            F.concat(F.lit(f"{self.factor}["), F.col("level").cast("string"), F.lit("]")).alias("term"),
            (F.col("alpha") - F.lit(base["alpha"])).alias("estimate"),
            F.sqrt(noise(F.col("a")) + F.lit(self.dispersion / base["a"]) + self._spread(apart)).alias("std_error"),
        )
        share = np.array([base[f"s{j}"] for j in range(p)]) + self._mid
        first = [("(Intercept)", base["alpha"] - float(self._mid @ self.beta), math.sqrt(self.dispersion / base["a"] + float(share @ self.vcov @ share)))]
        first += list(zip(self.terms, self.beta.tolist(), np.sqrt(np.diag(self.vcov)).tolist()))
        every = spark.createDataFrame(first, "term string, estimate double, std_error double").unionByName(others)
        every = every.withColumn("statistic", F.try_divide("estimate", "std_error"))
        tail = dist.normal_p if self.family == "binomial" else lambda t: dist.t_p(t, self.df_residual)
        every = every.withColumn("p_value", tail_column(tail, F.col("statistic")))
        return every.union(spark.createDataFrame([(t, None, None, None, None) for t in self.aliased], TIDY))

    def glance(self) -> DataFrame:
        row = (
            self.family, self.null_deviance, self.df_null, self.deviance, self.df_residual, self.dispersion, self.aic,
            self.loglik if self.aic is not None else None, self.n, self.converged,
        )
        return self._sums_by_level.sparkSession.createDataFrame(
            [row],
            "family string, null_deviance double, df_null bigint, deviance double, df_residual bigint, "
            "dispersion double, aic double, loglik double, n bigint, converged boolean",
        )

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """NULL for levels that the fit has not seen."""
        known = self.levels.select(F.col("level").alias(self.factor), F.col("effect").alias("_effect"))
        eta = F.col("_effect") + _sum([F.lit(float(b)) * x for b, x in zip(self.beta, self.design.exprs)])
        return split_join(df, known, [self.factor]).withColumn(name, inv_logit(eta)).drop("_effect")


def fit_absorbed(
    cells: DataFrame, y: str, terms: list[str], design: Design, factor: str, family: str = "binomial", max_iter: int = 50
) -> AbsorbedFit:
    """Fit logit(y) on ``design`` (of ``terms``) and the levels of ``factor``, on complete cells (``y``, terms, factor, ``w``)."""
    p = len(design.names)
    x = design.apply(cells, ["y", "w", F.col(factor).alias("level")])
    mid = centres(x, p)
    x = x.select("y", "w", "level", *[(F.col(f"x{j}") - F.lit(m)).alias(f"d{j}") for j, m in enumerate(mid)])
    used, aliased = list(range(p)), []
    rate = x.agg(F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w"))).first()[0]
    if rate is None:
        raise ValueError("the model has no complete rows")
    # A level starts at its own rate, drawn a little to that of all.
    share = (F.sum(F.col("w") * F.col("y")) + F.lit(rate)) / (F.sum("w") + F.lit(1.0))
    alphas = cut(x.groupBy("level").agg(F.log(share / (F.lit(1.0) - share)).alias("alpha"))) if 0 < rate < 1 else cut(
        x.groupBy("level").agg(F.lit(0.0).alias("alpha")))
    beta, before, deviance, converged = [0.0] * p, None, math.inf, False
    for k in range(max_iter):
        rows = split_join(x, alphas, ["level"], "inner")
        now = _constants(beta)
        rows = rows.withColumn("eta", F.col("alpha") + _sum([now[j] * F.col(f"d{j}") for j in used]))
        rows = rows.withColumns({"v": inv_logit(F.col("eta")) * inv_logit(-F.col("eta")), "r": F.col("y") - inv_logit(F.col("eta"))})
        wv, wr = F.col("w") * F.col("v"), F.col("w") * F.col("r")
        pairs = [(i, j) for i in used for j in used if i <= j]
        by_level = cut(rows.groupBy("level").agg(
            F.first("alpha").alias("alpha"), F.sum(wv).alias("a"), F.sum(wr).alias("g"),
            *[F.sum(wv * F.col(f"d{j}")).alias(f"b{j}") for j in used],
            *[F.sum(wr * F.col(f"d{j}")).alias(f"h{j}") for j in used],
            *[F.sum(wv * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}_{j}") for i, j in pairs],
            *figures(),
        ))
        part = lambda c: F.coalesce(F.try_divide(c, F.col("a")), F.lit(0.0))
        named = [c for c in ("n", "ysum", "saturated", "loglik", "deviance", "response", "pearson", "working")]
        sums = by_level.agg(
            F.count(F.lit(1)).alias("levels"), *[F.sum(c).alias(c) for c in named],
            *[F.sum(F.col(f"c{i}_{j}")).alias(f"t{i}_{j}") for i, j in pairs],
            *[F.sum(F.col(f"c{i}_{j}") - part(F.col(f"b{i}") * F.col(f"b{j}"))).alias(f"s{i}_{j}") for i, j in pairs],
            F.sum(part(F.col("g") * F.col("g"))).alias("own"),
            *[F.sum(F.col(f"h{j}") - part(F.col(f"b{j}") * F.col("g"))).alias(f"h{j}") for j in used],
        ).first().asDict()
        if k == 0:  # terms that are constant within the levels, or combinations of others there
            kept: list[int] = []
            for j in used:
                at = lambda i, j: sums[f"s{min(i, j)}_{max(i, j)}"]
                among = np.array([[at(a, b) for b in kept] for a in kept]).reshape(len(kept), len(kept))
                towards = np.array([at(a, j) for a in kept])
                left = at(j, j) - (float(towards @ np.linalg.lstsq(among, towards, rcond=None)[0]) if kept else 0.0)
                if sums[f"t{j}_{j}"] > 0 and left > ALIASED * sums[f"t{j}_{j}"]:
                    kept.append(j)
            aliased, used = [design.names[j] for j in used if j not in kept], kept
        if k and not sums["deviance"] <= deviance + 1e-9 * (abs(deviance) + 0.1):  # the step went too far
            beta = [(a + b) / 2 for a, b in zip(beta, before)]
            alphas = cut(split_join(alphas, old.withColumnRenamed("alpha", "old"), ["level"], "inner").select("level", ((F.col("alpha") + F.col("old")) / 2).alias("alpha")))
            continue
        schur = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in used] for i in used]).reshape(len(used), len(used))
        stuck = abs(deviance - sums["deviance"]) <= NOISE * (abs(sums["deviance"]) + 0.1)
        deviance = sums["deviance"]
        right = np.array([sums[f"h{j}"] for j in used])
        step = np.linalg.lstsq(schur, right, rcond=None)[0] if used else np.zeros(0)
        before, old = list(beta), by_level.select("level", "alpha")
        for j, s in zip(used, step):
            beta[j] += float(s)
        far = _constants(step)
        moved = F.try_divide(F.col("g") - _sum([F.col(f"b{j}") * far[n] for n, j in enumerate(used)]), F.col("a"))
        by_level = by_level.withColumn("alpha", F.col("alpha") + F.coalesce(moved, F.lit(0.0)))
        alphas = by_level.select("level", "alpha")
        converged = bool(stuck or sums["own"] + float(right @ step) <= TOL)
        if converged:
            break
    levels = by_level.select("level", "alpha", "a", *[F.col(f"b{j}").alias(f"b{n}") for n, j in enumerate(used)])
    return AbsorbedFit(y, design.only(used), factor, family, [beta[j] for j in used], schur, [mid[j] for j in used], levels, sums, converged, aliased)
