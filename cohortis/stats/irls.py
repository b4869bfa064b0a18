"""Newton steps for many logistic models at once, over one scan of their common cells.

Each pass multiplies a cell by the models still being fitted and sums, per model, what the next step needs. Passes, not
models, decide how many jobs run. What returns to the driver is one row of sums per model.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOL = 1e-12  # fall of the deviance that a last step may still promise
NOISE = 1e-14  # change of the deviance, as a share of it, that sums cannot tell from none
ALIASED = 1e-10  # share of a column's spread that earlier columns must leave


@dataclass
class Fit:
    """Estimates of one model: the intercept first, then those of ``columns`` (indices into the common columns)."""

    columns: list[int]
    aliased: list[int]
    coefs: np.ndarray
    covariance: np.ndarray
    sums: dict[str, float]
    converged: bool


def inv_logit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def log1p_exp(eta: Column) -> Column:
    """``log(1 + exp(eta))`` without overflow."""
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))


def xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def figures() -> list[Column]:
    """Counts, deviance, likelihood and residual sums of rows with ``w``, ``y``, ``eta``, ``v`` and ``r``."""
    w, y, v, r, eta = (F.col(c) for c in ("w", "y", "v", "r", "eta"))
    saturated, loglik = xlogx(y) + xlogx(1 - y), y * eta - log1p_exp(eta)
    return [
        F.sum("w").alias("n"),
        F.sum(w * y).alias("ysum"),
        F.sum(w * saturated).alias("saturated"),
        F.sum(w * loglik).alias("loglik"),
        F.sum(2 * w * (saturated - loglik)).alias("deviance"),
        F.sum(w * r * r).alias("response"),
        F.sum(F.try_divide(w * r * r, v)).alias("pearson"),
        F.sum(F.try_divide(w * r * r, v * v)).alias("working"),
    ]


def centres(x: DataFrame, p: int) -> list[float]:
    """Weighted means of the columns, over the rows that have them."""
    if not p:
        return []
    means = [F.try_divide(F.sum(F.col("w") * F.col(f"x{j}")), F.sum(F.when(F.col(f"x{j}").isNotNull(), F.col("w")))).alias(f"m{j}") for j in range(p)]
    row = x.agg(*means).first()
    return [row[f"m{j}"] or 0.0 for j in range(p)]


def independent(info: np.ndarray, columns: list[int]) -> list[int]:
    """Columns that are not linear combinations of the intercept and earlier ones (``info``: intercept first)."""
    kept: list[int] = []
    for j in columns:
        own = info[j + 1, j + 1] - (info[0, j + 1] ** 2 / info[0, 0] if info[0, 0] else 0.0)
        among = [0, *[k + 1 for k in kept]]
        towards = info[among, j + 1]
        left = info[j + 1, j + 1] - towards @ np.linalg.lstsq(info[np.ix_(among, among)], towards, rcond=None)[0]
        if own > 0 and left > ALIASED * own:
            kept.append(j)
    return kept


def moved_back(coefs: np.ndarray, covariance: np.ndarray, mid: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates for columns from which ``mid`` was taken, as estimates for the columns themselves."""
    back = np.eye(len(coefs))
    back[0, 1:] = -np.asarray(mid)
    return back @ coefs, back @ covariance @ back.T


class _Run:
    """The steps of one model."""

    def __init__(self, columns: list[int]) -> None:
        self.columns, self.asked = list(columns), list(columns)
        self.coefs = self.before = None
        self.deviance = math.inf
        self.done = self.converged = False
        self.sums: dict[str, float] = {}
        self.info = self.first = np.zeros((0, 0))

    def step(self, sums: dict[str, float], info: np.ndarray, gradient: np.ndarray, first: bool) -> None:
        if first:
            self.columns = independent(info, self.columns)
        at = [0, *[j + 1 for j in self.columns]]
        deviance = sums["deviance"]
        if not first and not deviance <= self.deviance + 1e-9 * (abs(self.deviance) + 0.1):
            self.coefs = (self.coefs + self.before) / 2  # the step went too far
            return
        stuck = abs(self.deviance - deviance) <= NOISE * (abs(deviance) + 0.1)
        self.sums, self.info, self.deviance = sums, info[np.ix_(at, at)], deviance
        if first:
            self.first = self.info
            self.coefs = self.coefs[at]
        step = np.linalg.lstsq(self.info, gradient[at], rcond=None)[0]
        self.before, self.coefs = self.coefs, self.coefs + step
        if stuck or float(gradient[at] @ step) <= TOL:
            # Separated outcomes: the likelihood settles while estimates run off and say nothing (deviations of a column).
            spread = np.sqrt(np.maximum(np.diag(self.first), 0) / self.first[0, 0])
            self.done, self.converged = True, bool((np.sqrt(np.diag(np.linalg.pinv(self.info, rcond=1e-300))) * spread < 1e3).all())


def fit_all(x: DataFrame, p: int, exclusive, models: list[list[int]], max_iter: int = 50, missing: bool = False) -> list[Fit]:
    """Fit logit(``y``) on each of the column sets ``models`` to ``x(y, w, x0 .. x<p-1>)``, row weights ``w``.

    ``exclusive(i, j)`` tells of columns whose product is 0 everywhere. With ``missing`` the columns may be null: each
    model uses the rows that have all of its own.
    """
    mid = centres(x, p)
    plain = [F.col(f"x{j}") - F.lit(m) for j, m in enumerate(mid)]
    filled = [F.coalesce(c, F.lit(0.0)) if missing else c for c in plain]
    known = [F.col(f"x{j}").isNotNull().alias(f"k{j}") for j in range(p)] if missing else []
    rows = x.select("y", "w", *[c.alias(f"d{j}") for j, c in enumerate(filled)], *known)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1) if not (i and exclusive(i - 1, j - 1))]
    runs = [_Run(m) for m in models]
    whole = x.agg(F.sum(F.col("w") * F.col("y")).alias("k"), F.sum("w").alias("n")).first()
    rate = whole["k"] / whole["n"] if whole["n"] else 0.5
    start = math.log(rate / (1 - rate)) if 0 < rate < 1 else 0.0
    for r in runs:
        r.coefs = np.array([start, *[0.0] * p])
    for k in range(max_iter + 1):
        active = [i for i, r in enumerate(runs) if not r.done]
        if not active:
            break
        sent = []
        for i in active:
            b = [0.0] * (p + 1)
            for at, value in zip([0, *[j + 1 for j in (range(p) if k == 0 else runs[i].columns)]], runs[i].coefs.tolist()):
                b[at] = value
            sent.append({"m": i, "b": b, "u": [j in runs[i].columns for j in range(p)]})
        told = F.from_json(F.lit(json.dumps(sent)), "array<struct<m:int,b:array<double>,u:array<boolean>>>")
        each = rows.withColumn("model", F.explode(told)).withColumn("b", F.col("model.b"))
        if missing:
            for j in range(p):
                each = each.where(F.col(f"k{j}") | ~F.col("model.u")[j])
        eta = F.col("b")[0]
        for j in range(p):
            eta = eta + F.col("b")[j + 1] * F.col(f"d{j}")
        each = each.withColumn("eta", eta)
        each = each.withColumns({"v": inv_logit(F.col("eta")) * inv_logit(-F.col("eta")), "r": F.col("y") - inv_logit(F.col("eta"))})
        c = [F.lit(1.0), *[F.col(f"d{j}") for j in range(p)]]
        w, v, r = F.col("w"), F.col("v"), F.col("r")
        found = each.groupBy("model.m").agg(
            *figures(),
            *[F.sum(w * v * c[i] * c[j]).alias(f"i{i}_{j}") for i, j in pairs],
            *[F.sum(w * r * c[i]).alias(f"g{i}") for i in range(p + 1)],
        ).collect()
        for row in found:
            sums = row.asDict()
            info = np.zeros((p + 1, p + 1))
            for i, j in pairs:
                info[i, j] = info[j, i] = sums[f"i{i}_{j}"]
            # Products that are 0 for the columns are not once their means are taken off.
            for i in range(1, p + 1):
                for j in range(i + 1, p + 1):
                    if exclusive(i - 1, j - 1):
                        mi, mj = mid[i - 1], mid[j - 1]
                        info[i, j] = info[j, i] = -(mi * (info[0, j] + mj * info[0, 0]) + mj * (info[0, i] + mi * info[0, 0])) + mi * mj * info[0, 0]
            runs[row["m"]].step(sums, info, np.array([sums[f"g{i}"] for i in range(p + 1)]), k == 0)
        if k == 0 and len(found) < len(active):
            raise ValueError("a model has no complete rows")
    out = []
    for r in runs:
        coefs, covariance = moved_back(r.coefs if r.done else r.before, np.linalg.pinv(r.info), [mid[j] for j in r.columns])
        out.append(Fit(r.columns, [j for j in r.asked if j not in r.columns], coefs, covariance, r.sums, r.converged))
    return out
