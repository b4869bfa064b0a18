"""Binning, side offsets, planar distance, curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import as_col

# 20 m distance bins along a 100 m transect.
TRANSECT_BREAKS = (0, 20, 40, 60, 80, 100)


def bin_by(col: str | Column, breaks: tuple[float, ...] | list[float] = TRANSECT_BREAKS) -> Column:
    """Number of breaks at or below the value: 0 below the first, ``len(breaks)`` from the last on."""
    x = as_col(col).try_cast("double")
    steps = {b - a for a, b in zip(breaks, breaks[1:])}
    if all(float(b).is_integer() for b in breaks) and len(steps) == 1:
        return F.width_bucket(x, F.lit(float(breaks[0])), F.lit(float(breaks[-1])), F.lit(len(breaks) - 1)).cast("int")
    return reduce(lambda a, b: a + b, [(x >= F.lit(float(b))).cast("int") for b in breaks])


def side_offset(col: str | Column, offsets: dict[str, float], default: float = 0.0) -> Column:
    """Offset looked up by side; unknown and missing sides get ``default``."""
    c = as_col(col)
    out = F.lit(None).cast("double")
    for side, offset in offsets.items():
        out = F.when(c == side, F.lit(float(offset))).otherwise(out)
    return F.coalesce(out, F.lit(float(default)))


def distance_to(x: str | Column, y: str | Column, origin: tuple[float, float]) -> Column:
    """Planar distance to a fixed point."""
    dx, dy = as_col(x) - F.lit(float(origin[0])), as_col(y) - F.lit(float(origin[1]))
    return F.sqrt(dx * dx + dy * dy)


def logistic_curve(x: str | Column, a: float, b: float) -> Column:
    """``1 / (1 + exp(b (x - a)))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(b)) * (as_col(x) - F.lit(float(a)))))


def predict_logistic_curve(df: DataFrame, x: str, a: float, b: float, name: str = "predicted") -> DataFrame:
    return df.withColumn(name, logistic_curve(x, a, b))
