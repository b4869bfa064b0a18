"""Tail probabilities as column expressions.

A function of one number that is smooth is cut into pieces, each a polynomial through Chebyshev points, fitted on the
driver; the expression looks up a row's piece. So a table of any length gets its p-values where it is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES, DEGREE = 64, 9


def tail_column(
    fn: Callable[[float], float], stat: Column, logarithm: bool = True, least: float = 1e-300, pieces: int = PIECES
) -> Column:
    """``fn`` of the size of ``stat``: falling, positive, 1 at 0.

    With ``logarithm`` small values keep their relative precision. Beyond the place where ``fn`` falls under ``least``,
    or 1e9, the value there is taken. NULL and NaN give NULL.
    """
    reach = 1.0
    while fn(reach) > least and reach < 1e9:
        reach *= 2
    low, high = reach / 2, reach
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if fn(mid) > least and reach < 1e9 else (low, mid)
    top = math.log1p(low)
    nodes = np.cos(np.pi * (np.arange(DEGREE + 1) + 0.5) / (DEGREE + 1))
    table = []
    for k in range(pieces):
        at = np.expm1(top * (k + (nodes + 1) / 2) / pieces)
        values = np.array([fn(float(q)) for q in at])
        if logarithm:
            values = np.log(np.maximum(values, least))
        table.append(np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(nodes, values, DEGREE)).tolist())
    known = F.from_json(F.lit(json.dumps(table)), "array<array<double>>")
    u = F.least(F.log1p(F.abs(stat)), F.lit(top)) * F.lit(pieces / top)
    piece = F.least(F.floor(u), F.lit(pieces - 1)).cast("int")
    t = (u - piece) * 2 - 1
    row = F.get(known, piece)
    value = row[DEGREE]
    for d in range(DEGREE - 1, -1, -1):
        value = value * t + row[d]
    value = F.exp(value) if logarithm else value
    return F.when(stat.isNotNull() & ~F.isnan(stat), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
