"""Several models side by side."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glm import GlmFit, complete, fit_many
from .mixed import glmm_logit


@dataclass
class ModelSpec:
    name: str
    terms: list[str]
    kind: Literal["glm", "quasi", "glmm"] = "glm"
    group: str | None = None
    factors: list[str] = field(default_factory=list)


def compare_models(df: DataFrame, y: str, specs: list[ModelSpec], common_frame: bool = True) -> DataFrame:
    """One row per model: rows used, coefficients, AIC, deviance, residual RMSE.

    ``common_frame`` fits every model to the rows complete in all of them, without
    which the AICs are not comparable. RMSE is of deviance residuals for mixed
    models and of working residuals otherwise. All models without random effects are
    fitted in the same passes over one table of their cells.
    """
    used = [y, *dict.fromkeys(c for s in specs for c in [*s.terms, *([s.group] if s.group else [])])]
    frame = complete(df.select(*used), used) if common_frame else df
    plain = [s for s in specs if s.kind != "glmm"]
    fits = dict(zip((s.name for s in plain), _plain_fits(frame, y, plain))) if plain else {}
    rows = []
    for s in specs:
        if s.kind == "glmm":
            fit = glmm_logit(frame, y, s.terms, s.group, s.factors)
            rows.append((s.name, s.kind, fit.n, len(fit.beta), fit.aic, fit._rss["deviance"], fit.rmse("deviance"), fit.converged))
        else:
            fit = fits[s.name]
            rows.append((s.name, s.kind, fit.n, len(fit.coefs), fit.aic, fit.deviance, fit.rmse("working"), fit.converged))
    schema = "model string, kind string, n bigint, n_coef bigint, aic double, deviance double, rmse double, converged boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def _plain_fits(frame: DataFrame, y: str, specs: list[ModelSpec]) -> list[GlmFit]:
    """Models without random effects, each on the rows complete in its own terms.

    A term is a factor in all of them or in none; cells keep what a model leaves missing.
    """
    terms = list(dict.fromkeys(t for s in specs for t in s.terms))
    factors = {t for s in specs for t in s.factors}
    both = [t for s in specs for t in s.terms if t in factors and t not in s.factors]
    if both:
        raise ValueError(f"{both[0]} is a factor in one model and a number in another")
    rows = frame.select(F.col(y).cast("double").alias("y"), *terms).where("y is not null")
    cells = rows.groupBy("y", *terms).agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    try:
        models = [(s.terms, "quasibinomial" if s.kind == "quasi" else "binomial") for s in specs]
        return fit_many(cells, y, models, sorted(factors), missing=True)
    finally:
        cells.unpersist()
