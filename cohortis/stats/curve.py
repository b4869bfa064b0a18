"""Two-parameter logistic curve by nonlinear least squares."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import logistic_curve, predict_logistic_curve
from . import dist
from .glm import TIDY, to_cells


class CurveFit:
    def __init__(self, spark, x: str, y: str, a: float, b: float, sums: dict, iterations: int, converged: bool):
        self._spark, self.x, self.y, self.a, self.b = spark, x, y, a, b
        self.iterations, self.converged = iterations, converged
        self.n, self.rss = int(sums["n"]), sums["rss"]
        self.df_residual = self.n - 2
        self.sigma = math.sqrt(self.rss / self.df_residual) if self.df_residual > 0 else None
        jtj = np.array([[sums["aa"], sums["ab"]], [sums["ab"], sums["bb"]]])
        self.vcov = (self.sigma or 0.0) ** 2 * np.linalg.pinv(jtj)

    def tidy(self) -> DataFrame:
        rows = []
        for term, est, var in (("a", self.a, self.vcov[0, 0]), ("b", self.b, self.vcov[1, 1])):
            se = math.sqrt(var)
            t = est / se if se else None
            rows.append((term, est, se, t, dist.t_p(t, self.df_residual) if t is not None else None))
        return self._spark.createDataFrame(rows, TIDY)

    def glance(self) -> DataFrame:
        return self._spark.createDataFrame(
            [(self.sigma, self.rss, self.df_residual, self.n, self.iterations, self.converged)],
            "sigma double, rss double, df_residual bigint, n bigint, iterations bigint, converged boolean",
        )

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return predict_logistic_curve(df, self.x, self.a, self.b, name)

    def goodness(self, df: DataFrame, name: str = "r") -> DataFrame:
        """Correlation of observed and fitted values."""
        return self.predict(df, "_fit").agg(F.corr(self.y, "_fit").alias(name))


def _sums(cells: DataFrame, a: float, b: float) -> dict:
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    f = logistic_curve(x, a, b)
    rows = cells.select(w.alias("w"), (y - f).alias("r"), f.alias("f"), (x - F.lit(a)).alias("dx"))
    slope = F.col("f") * (1 - F.col("f"))
    rows = rows.select("w", "r", (F.lit(b) * slope).alias("ja"), (-F.col("dx") * slope).alias("jb"))

    def total(u: str, v: str):
        return F.sum(F.col("w") * F.col(u) * F.col(v))

    return rows.agg(
        F.sum("w").alias("n"),
        total("r", "r").alias("rss"),
        total("ja", "ja").alias("aa"),
        total("ja", "jb").alias("ab"),
        total("jb", "jb").alias("bb"),
        total("ja", "r").alias("ar"),
        total("jb", "r").alias("br"),
    ).first().asDict()


def fit_logistic_curve(
    df: DataFrame, x: str, y: str, start: tuple[float, float] = (2.0, 1.0), max_iter: int = 500, tol: float = 1e-9
) -> CurveFit:
    """Gauss-Newton for ``y = 1 / (1 + exp(b (x - a)))``; each step reduces the cells to seven sums.

    A step that does not lower the residual sum is halved. Convergence is judged by
    the size of the projected residual against the rest, relative to ``tol``.
    """
    cells = to_cells(df.select(F.col(x).cast("double").alias("x"), F.col(y).alias("_y")), "_y", ["x"]).persist()
    try:
        a, b = map(float, start)
        now, converged, i = _sums(cells, a, b), False, 0
        if not now["n"]:
            raise ValueError("no complete rows to fit")
        while i < max_iter and not converged:
            i += 1
            jtj = np.array([[now["aa"], now["ab"]], [now["ab"], now["bb"]]])
            jtr = np.array([now["ar"], now["br"]])
            step = np.linalg.lstsq(jtj, jtr, rcond=None)[0]
            projected = float(jtr @ step)
            if projected <= tol**2 * max(now["rss"] - projected, 1e-300):
                converged = True
                break
            size = 1.0
            while size > 2**-20:
                there = _sums(cells, a + size * float(step[0]), b + size * float(step[1]))
                if there["rss"] is not None and there["rss"] <= now["rss"]:
                    break
                size /= 2
            else:
                # No shorter step helps any more: at the limit of the arithmetic.
                converged = projected <= 1e-12 * now["rss"]
                break
            a, b, now = a + size * float(step[0]), b + size * float(step[1]), there
        return CurveFit(df.sparkSession, x, y, a, b, now, i, converged)
    finally:
        cells.unpersist()
