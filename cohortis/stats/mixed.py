"""Logistic model with a random intercept per group, by the Laplace approximation.

For a group with scaled random effect b (the intercept shift is sigma * b):

    h(b) = sum w (y eta - log(1 + exp(eta))) - b^2 / 2,   eta = x beta + sigma b
    logL = sum over groups of  h(b^) - log(1 + sigma^2 W) / 2,   W = sum w mu (1 - mu)

Everything per group is a grouped aggregate over the weighted cells; the modes b^
stay in a table of their groups. Gradient and Hessian of logL are exact: the modes
are differentiated twice through the equation that they solve, from sums of each
group, so one pass over the cells with one parameter vector gives a whole Newton
step. One row of sums reaches the driver, which never sees groups or rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut
from ..operators.skew import key_join
from . import dist
from .glm import Design, complete, to_cells
from .linear import corr_tests, lms

MODE_ROUNDS = 40  # rounds of Newton steps towards the group effects before a fit is given up
SALTS = 32


class _Laplace:
    """The objective and its derivatives at a parameter vector (beta..., sigma)."""

    def __init__(self, cells: DataFrame, group: str, n_x: int):
        self.group, self.p = group, n_x + 1
        self.cells = cells
        self.groups = cells.select(group).distinct().persist()
        self.n_groups = self.groups.count()

    def close(self) -> None:
        self.groups.unpersist()

    def ready(self, thetas: np.ndarray, solved: DataFrame | None = None, at: np.ndarray | None = None) -> DataFrame:
        """Modes of every group for every candidate, with the candidate's parameters ``t0`` ... beside them.

        Modes solved for the parameters ``at`` are moved along their derivatives. The
        parameters travel as data, not as literals, so every round runs the same compiled code.
        """
        fields = ", ".join(f"t{j} double" for j in range(self.p + 1))
        table = [(i, *map(float, t)) for i, t in enumerate(thetas)]
        params = self.groups.sparkSession.createDataFrame(table, f"cand int, {fields}")
        ids = F.explode(F.sequence(F.lit(0), F.lit(len(thetas) - 1))).alias("cand")
        b = F.lit(0.0)
        if solved is not None:
            b = F.col("b")
            for j in range(self.p + 1):
                b = b + F.col(f"d{j}") * (F.col(f"t{j}") - F.lit(float(at[j])))
        named = [f"t{j}" for j in range(self.p + 1)]
        met = key_join((self.groups if solved is None else solved).select("*", ids), params, ["cand"], small=True)
        return met.select(self.group, "cand", b.alias("b"), *named)

    def rows(self, state: DataFrame) -> DataFrame:
        """Cells met with the candidates of their group: predictor, mean, variance and residual."""
        keys = [self.group]
        cells = self.cells
        small = self.n_groups * (2 * self.p + 3) <= BROADCAST_ROWS
        if not small:
            # Cells are distinct rows, so a hash of their content spreads a heavy group evenly.
            keys = [self.group, "_salt"]
            xs = [F.col(f"x{j}") for j in range(self.p - 1)]
            cells = cells.withColumn("_salt", F.pmod(F.xxhash64("y", *xs), F.lit(SALTS)))
            state = state.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = key_join(cells, state, keys, small=small)
        shift = "".join(f" + t{j} * x{j - 1}" for j in range(1, self.p))
        met = met.selectExpr("*", f"t0 + t{self.p} * b{shift} AS eta")
        met = met.selectExpr("*", "1 / (1 + exp(-eta)) AS mu", "1 / (1 + exp(eta)) AS nu")
        # Sums are taken of wr, wv, wv1, wv2: weighted residual, variance, first and second derivative of the variance.
        return met.selectExpr(
            "*", "w * (y - mu) AS wr", "w * mu * nu AS wv", "w * mu * nu * (nu - mu) AS wv1", "w * mu * nu * (1 - 6 * mu * nu) AS wv2"
        )

    def _per_group(self, state: DataFrame):
        return self.rows(state).groupBy(self.group, "cand", "b", *[f"t{j}" for j in range(self.p + 1)])

    def newton(self, state: DataFrame) -> DataFrame:
        """One Newton step towards the mode of every group and candidate."""
        s = f"t{self.p}"
        sums = self._per_group(state).agg(F.sum("wr").alias("R"), F.sum("wv").alias("W"))
        step = f"b + ({s} * R - b) / (1 + {s} * {s} * W) AS b"
        return sums.selectExpr(f"`{self.group}`", "cand", step, *[f"t{j}" for j in range(self.p + 1)])

    def sums(self, state: DataFrame) -> DataFrame:
        """Per group and candidate: likelihood, gradient ``g<j>`` and Hessian ``h<j>_<k>`` in (beta, sigma), given the modes.

        With the modes following the parameters, eta has the derivatives x_j + c_j (beta_j) and c_p (sigma), where c is
        constant within a group; so all second derivatives are made of sums of products of two covariates.
        """
        p, s = self.p, f"t{self.p}"
        at = lambda n, j, k: f"{n}{min(j, k)}_{max(j, k)}"
        times = ["", *[f" * x{j}" for j in range(p - 1)]]
        pairs = [(j, k) for j in range(p) for k in range(j, p)]
        aggs = [F.expr("sum(w * (y * eta - greatest(eta, 0D) - log1p(exp(-abs(eta))))) AS ll")]
        aggs += [F.expr(f"sum(wr{times[j]}) AS A{j}") for j in range(p)]
        for name, of in (("B", "wv"), ("C", "wv1"), ("E", "wv2")):
            aggs += [F.expr(f"sum({of}{times[j]}{times[k]}) AS {name}{j}_{k}") for j, k in pairs]
        g = self._per_group(state).agg(*aggs).selectExpr("*", f"1 + {s} * {s} * B0_0 AS D")
        # First derivatives of the mode (d), of eta (c), of the residual sum (R), of W and of D (Q).
        g = g.selectExpr("*", *[f"-{s} * B0_{j} / D AS d{j}" for j in range(p)], f"(A0 - {s} * b * B0_0) / D AS d{p}")
        g = g.selectExpr("*", *[f"{s} * d{j} AS c{j}" for j in range(p)], f"b + {s} * d{p} AS c{p}")
        first = [f"-(B0_{j} + c{j} * B0_0) AS R{j}" for j in range(p)] + [f"-c{p} * B0_0 AS R{p}"]
        first += [f"C0_{j} + c{j} * C0_0 AS W{j}" for j in range(p)] + [f"c{p} * C0_0 AS W{p}"]
        g = g.selectExpr("*", *first)
        g = g.selectExpr("*", *[f"{s} * {s} * W{j} AS Q{j}" for j in range(p)], f"2 * {s} * B0_0 + {s} * {s} * W{p} AS Q{p}")

        def product(n: str, j: int, k: int) -> str:
            """Sum of a weight over the derivatives of eta."""
            if k == p:
                return f"c{p} * c{p} * {n}0_0" if j == p else f"c{p} * ({n}0_{j} + c{j} * {n}0_0)"
            return f"{at(n, j, k)} + c{j} * {n}0_{k} + c{k} * {n}0_{j} + c{j} * c{k} * {n}0_0"

        every = [(j, k) for j in range(p + 1) for k in range(j, p + 1)]
        bend = []  # second derivatives of the mode
        for j, k in every:
            v = product("C", j, k)
            own = "0D" if k < p else f"R{j} - {s} * d{j} * B0_0" if j < p else f"2 * (R{p} - {s} * d{p} * B0_0)"
            bend.append(f"({own} - {s} * ({v})) / D AS d{j}_{k}")
        g = g.selectExpr("*", *bend)
        second = []
        for j, k in every:
            eta = f"{s} * d{j}_{k}" if k < p else f"d{j} + {s} * d{j}_{k}" if j < p else f"2 * d{p} + {s} * d{j}_{k}"
            w = f"({product('E', j, k)} + ({eta}) * C0_0)"
            if k < p:
                d2, own = f"{s} * {s} * {w}", f"-({at('B', j, k)} + c{k} * B0_{j})"
            else:
                d2 = f"2 * {s} * W{j} + {s} * {s} * {w}" if j < p else f"2 * B0_0 + 4 * {s} * W{p} + {s} * {s} * {w}"
                own = f"d{j} * A0 + b * R{j}"
            second.append(f"{own} - (({d2}) / D - Q{j} * Q{k} / (D * D)) / 2 AS h{j}_{k}")
        out = [f"`{self.group}`", "cand", "b", "B0_0 AS W", "ll - b * b / 2 - ln(D) / 2 AS obj", f"abs({s} * A0 - b) AS off"]
        out += [f"A{j} - Q{j} / (2 * D) AS g{j}" for j in range(p)] + [f"b * A0 - Q{p} / (2 * D) AS g{p}"]
        return g.selectExpr(*out, *second, *[f"d{j}" for j in range(p + 1)])

    def evaluate(self, theta: np.ndarray, steps: int, solved: DataFrame | None = None, at: np.ndarray | None = None):
        """Objective, gradient and Hessian at ``theta``, and the modes, solved to rounding error."""
        d = self.p + 1
        pairs = [(j, k) for j in range(d) for k in range(j, d)]
        modes = self.ready(theta[None, :], solved, at)
        for _ in range(MODE_ROUNDS):
            for _ in range(steps):
                modes = self.newton(modes)
            found = cut(self.sums(modes))
            r = found.agg(
                F.sum("obj").alias("obj"), F.max("off").alias("off"), *[F.sum(f"g{j}").alias(f"g{j}") for j in range(d)],
                *[F.sum(f"h{j}_{k}").alias(f"h{j}_{k}") for j, k in pairs],
            ).first()
            now = found.select(self.group, "b", "W", *[f"d{j}" for j in range(d)])
            if r["off"] < 1e-6:
                hess = np.zeros((d, d))
                for j, k in pairs:
                    hess[j, k] = hess[k, j] = r[f"h{j}_{k}"]
                return r["obj"], np.array([r[f"g{j}"] for j in range(d)]), hess, now
            if not math.isfinite(r["off"]):
                break
            modes, steps = self.ready(theta[None, :], now, theta), 2
        raise ArithmeticError("the group effects could not be solved")


def _start(lap: _Laplace) -> tuple[np.ndarray, DataFrame]:
    """Mean and spread of the groups' smoothed logits, the spread less its sampling part, and modes to match."""
    w = F.col("w")
    k, n = F.col("k") + 0.5, F.col("n") + 1.0
    logits = lap.cells.groupBy(lap.group).agg(F.sum(w * F.col("y")).alias("k"), F.sum("w").alias("n"))
    logits = cut(logits.select(lap.group, F.log(k / (n - k)).alias("l"), (1 / k + 1 / (n - k)).alias("v")))
    r = logits.agg(F.avg("l").alias("m"), F.var_samp("l").alias("s"), F.avg("v").alias("v")).first()
    spread = max((r["s"] or 0.25) - r["v"], 0.01)
    sigma = math.sqrt(spread)
    b = (F.col("l") - F.lit(r["m"])) * F.lit(sigma) / (F.lit(spread) + F.col("v"))
    modes = logits.select(lap.group, b.alias("b"), *[F.lit(0.0).alias(f"d{j}") for j in range(lap.p + 1)])
    return np.array([r["m"], *[0.0] * (lap.p - 1), math.log(sigma)]), modes


def _maximise(
    lap: _Laplace, point: np.ndarray, solved: DataFrame | None, max_iter: int, tol: float, fixed_zero: bool = False
):
    """Newton over (beta, log sigma), one evaluation per iteration.

    ``fixed_zero`` keeps sigma at 0 and moves beta only.
    """
    d = lap.p + (not fixed_zero)

    def natural(points: np.ndarray) -> np.ndarray:
        sigma = np.zeros(len(points)) if fixed_zero else np.exp(points[:, -1])
        return np.column_stack([points[:, : lap.p], sigma])

    theta = old = hess = step = None
    size, steps, converged = 1.0, 3, False
    for _ in range(max_iter):
        now = natural(point[None, :])[0]
        at = natural((point if theta is None else theta)[None, :])[0]
        obj, grad, bent, found = lap.evaluate(now, steps, solved, at)
        if old is not None and not obj >= old - 1e-10 * (abs(old) + 1):
            size /= 2
            if size < 1e-6:
                break
            point = theta + size * step
            continue
        theta, old, size, solved = point, obj, 1.0, found
        if not fixed_zero:  # from sigma to its logarithm
            bent[-1, -1] = bent[-1, -1] * now[-1] ** 2 + grad[-1] * now[-1]
            bent[:-1, -1] = bent[-1, :-1] = bent[:-1, -1] * now[-1]
            grad[-1] *= now[-1]
        hess, grad = bent[:d, :d], grad[:d]
        values, vectors = np.linalg.eigh(-hess)
        step = vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max())))
        if float(abs(grad @ step)) < tol or (not fixed_zero and theta[-1] < -6):
            converged = True
            break
        step = step / max(1.0, np.abs(step).max())
        point, steps = theta + step, 2 if np.abs(step).max() > 0.05 else 1
    here = natural(theta[None, :])[0]
    if converged and (fixed_zero or theta[-1] >= -6):
        # The last step is below the tolerance: take it to first order, with the modes.
        there = natural((theta + step)[None, :])[0]
        moved = F.col("b")
        for j, delta in enumerate(there - here):
            moved = moved + F.col(f"d{j}") * F.lit(float(delta))
        return there, old, hess, solved.withColumn("b", moved), True
    return here, old, hess, solved, converged


class GlmmFit:
    """Fixed effects, group spread and group effects of a random-intercept logistic model."""

    def __init__(self, spark, y, group, names, beta, vcov, sigma, loglik, n, modes, design, converged, singular):
        self._spark, self.y, self.group = spark, y, group
        self.terms, self.beta, self.vcov, self.sigma, self.loglik = ["(Intercept)", *names], beta, vcov, sigma, loglik
        self.n, self._modes, self.design = n, modes, design
        self.converged, self.singular = converged, singular
        n_par = len(beta) + 1
        self.aic, self.bic = -2 * loglik + 2 * n_par, -2 * loglik + math.log(n) * n_par
        self.df_residual = n - n_par
        self._rss: dict[str, float] = {}

    def tidy(self) -> DataFrame:
        rows = []
        for term, est, var in zip(self.terms, self.beta.tolist(), np.diag(self.vcov).tolist()):
            se = math.sqrt(var) if var > 0 else None
            z = est / se if se else None
            rows.append(("fixed", None, term, est, se, z, dist.normal_p(z) if z is not None else None))
        rows.append(("ran_pars", self.group, "sd__(Intercept)", self.sigma, None, None, None))
        return self._spark.createDataFrame(
            rows, "effect string, group string, term string, estimate double, std_error double, statistic double, p_value double"
        )

    def glance(self) -> DataFrame:
        row = (self.n, 1.0, self.loglik, self.aic, self.bic, self._rss["deviance"], self.df_residual, self.converged, self.singular)
        return self._spark.createDataFrame(
            [row],
            "n bigint, sigma double, loglik double, aic double, bic double, deviance double, df_residual bigint, "
            "converged boolean, singular boolean",
        )

    def ranef(self) -> DataFrame:
        """Per group: conditional mode ``condval`` and its standard deviation ``condsd``."""
        return self._modes.select(
            self.group,
            (F.lit(self.sigma) * F.col("b")).alias("condval"),
            (F.lit(self.sigma) / F.sqrt(1 + F.lit(self.sigma**2) * F.col("W"))).alias("condsd"),
        )

    def coef(self) -> DataFrame:
        """Per group: fixed coefficients with the intercept shifted by the group's effect."""
        return self.ranef().select(
            self.group,
            (F.lit(float(self.beta[0])) + F.col("condval")).alias("(Intercept)"),
            *[F.lit(float(b)).alias(t) for t, b in zip(self.terms[1:], self.beta[1:])],
        )

    def rmse(self, kind: str = "deviance") -> float:
        return math.sqrt(self._rss[kind] / self.n)


def glmm_logit(
    df: DataFrame, y: str, terms: list[str], group: str, factors: list[str] = (), max_iter: int = 50, tol: float = 1e-9
) -> GlmmFit:
    """Fit ``y ~ terms + (1 | group)`` to the complete rows.

    Covariates are standardised inside and reported on their own scale. Where the
    likelihood is highest without any spread between groups, the fit says
    ``singular`` and all group effects are 0.
    """
    raw = to_cells(complete(df, [y, group, *terms]), y, terms, group).persist()
    design = Design.of(raw, terms, factors)
    p = len(design.names) + 1
    named = design.apply(raw, ["y", "w", group])
    w = F.col("w")
    moments = [F.sum("w").alias("n")]
    for j in range(p - 1):
        x = F.col(f"x{j}")
        moments += [F.sum(w * x).alias(f"s{j}"), F.sum(w * x * x).alias(f"q{j}")]
    m = named.agg(*moments).first()
    n = m["n"]
    if not all(v is None or math.isfinite(v) for v in m):
        raise ValueError("covariates must be finite")
    centre = np.array([m[f"s{j}"] / n for j in range(p - 1)])
    scale = np.array([math.sqrt(max(m[f"q{j}"] / n - c * c, 0.0)) or 1.0 for j, c in enumerate(centre)])
    cells = named.select(
        "y", "w", group, *[((F.col(f"x{j}") - F.lit(float(centre[j]))) / F.lit(float(scale[j]))).alias(f"x{j}") for j in range(p - 1)]
    ).persist()
    lap = _Laplace(cells, group, p - 1)
    try:
        start, modes = _start(lap)
        theta, loglik, hess, modes, converged = _maximise(lap, start, modes, max_iter, tol)
        singular = False
        if theta[-1] < 0.05:
            # Near the edge: see whether no spread at all fits as well.
            flat = _maximise(lap, theta[:-1], None, max_iter, tol, fixed_zero=True)
            if flat[1] >= loglik - 1e-9:
                theta, loglik, hess, modes, converged = flat
                singular = True
        sigma, info = float(theta[-1]), -hess
        vcov = np.linalg.pinv(info)[:p, :p]
        # Back to the covariates' own scale.
        back = np.zeros((p, p))
        back[0, 0] = 1
        for j in range(p - 1):
            back[j + 1, j + 1], back[0, j + 1] = 1 / scale[j], -centre[j] / scale[j]
        beta = back @ theta[:-1]
        fit = GlmmFit(
            df.sparkSession, y, group, design.names, beta, back @ vcov @ back.T, sigma, float(loglik), int(round(n)), modes,
            design, converged, singular,
        )
        rows = lap.rows(lap.ready(theta[None, :], modes, theta))
        fit._rss = rows.selectExpr(
            "sum(2 * w * (greatest(eta, 0D) + log1p(exp(-abs(eta))) - y * eta)) AS deviance",
            "sum(wr * (y - mu)) AS response",
            "sum(try_divide(wr * (y - mu), mu * nu)) AS pearson",
            "sum(try_divide(wr * (y - mu), mu * nu * mu * nu)) AS working",
        ).first().asDict()
        return fit
    finally:
        lap.close()
        cells.unpersist()
        raw.unpersist()


def ranef_with_climate(fit: GlmmFit, climate: DataFrame, on: str = "WINTER") -> DataFrame:
    """Group effects of interval groups beside the climate of the year each interval ends in."""
    end = F.get(F.split(F.col(fit.group), "-"), F.lit(1)).try_cast("int").alias(on)
    effects = fit.ranef().select(end, fit.group, "condval", "condsd")
    return key_join(effects, climate, [on], "left", null_safe=False)


def ranef_vs_climate(fit: GlmmFit, climate: DataFrame, cols: list[str], on: str = "WINTER") -> DataFrame:
    """Correlation and regression of the group effects on each climate column."""
    both = ranef_with_climate(fit, climate, on).persist()
    try:
        tests = corr_tests(both, [(c, "condval") for c in cols])
        fits = lms(both, [("condval", c) for c in cols])
    finally:
        both.unpersist()
    lines = [
        (c, f.slope if f else None, f.intercept if f else None, f.r_squared if f else None) for c, f in zip(cols, fits)
    ]
    lines = fit._spark.createDataFrame(lines, "x string, slope double, intercept double, r_squared double")
    return key_join(tests.drop("y"), lines, ["x"])
