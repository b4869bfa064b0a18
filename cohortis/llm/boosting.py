"""Gradient-boosted trees over a table of counted feature cells; scoring is a column expression."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, log

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tree of depth two: (feature, border, two children), a child being (feature, border, left value, right value).
Split = tuple[int, int]


class Boosted:
    """Log-odds as a start value and trees over whole-number features; a value up to a border goes left."""

    def __init__(self, start: float, trees: list) -> None:
        self.start, self.trees = start, trees

    def score(self, cell: Sequence[int]) -> float:
        total = self.start
        for (f, at), sides in self.trees:
            (g, border), values = sides[cell[f] > at]
            total += values[cell[g] > border]
        return total

    def column(self, features: Sequence[str]) -> Column:
        """The log-odds as SQL over the feature columns."""
        total = F.lit(self.start)
        for (f, at), sides in self.trees:
            leaf = [F.when(F.col(features[g]) > b, v[1]).otherwise(v[0]) for (g, b), v in sides]
            total = total + F.when(F.col(features[f]) > at, leaf[1]).otherwise(leaf[0])
        return total


def _best(cells: list, grads: list, hesses: list, members: list[int], splits: list[Split]) -> tuple[float, Split, tuple[float, float]]:
    """The split of some cells with the largest gain, and its two leaf values."""
    found = (-1.0, splits[0], (0.0, 0.0))
    for f, at in splits:
        g, h = [0.0, 0.0], [1.0, 1.0]  # one count of smoothing on each side
        for i in members:
            side = cells[i][f] > at
            g[side] += grads[i]
            h[side] += hesses[i]
        gain = g[0] ** 2 / h[0] + g[1] ** 2 / h[1]
        if gain > found[0] + 1e-12:
            found = (gain, (f, at), (g[0] / h[0], g[1] / h[1]))
    return found


def boost(cells: list[tuple[int, ...]], counts: list[int], positives: list[int], rounds: int = 12, rate: float = 0.4) -> Boosted:
    """Fit logistic boosted trees to counted cells; equal rows are one cell, so the fit is that of all rows.

    Deterministic: ties go to the first split. No rows, or one class only, give a model without trees.
    """
    n, p = sum(counts), sum(positives)
    if not cells or p in (0, n):
        return Boosted(-10.0 if p == 0 else 10.0, [])
    start = log(p / (n - p))
    splits = [(f, at) for f in range(len(cells[0])) for at in sorted({c[f] for c in cells})[:-1]]
    model = Boosted(start, [])
    if not splits:
        return model
    total = [start] * len(cells)
    for _ in range(rounds):
        share = [1 / (1 + exp(-max(-30.0, min(30.0, t)))) for t in total]
        grads = [y - c * s for y, c, s in zip(positives, counts, share)]
        hesses = [c * s * (1 - s) for c, s in zip(counts, share)]
        everyone = list(range(len(cells)))
        _, root, _ = max((_depth_two(cells, grads, hesses, everyone, s, splits) for s in _shortlist(cells, grads, hesses, everyone, splits)), key=lambda x: x[0])
        sides = []
        for right in (False, True):
            _, split, values = _best(cells, grads, hesses, [i for i in everyone if (cells[i][root[0]] > root[1]) == right], splits)
            sides.append((split, tuple(round(rate * v, 9) for v in values)))
        model.trees.append((root, tuple(sides)))
        for i, c in enumerate(cells):
            (g, border), values = sides[c[root[0]] > root[1]]
            total[i] += values[c[g] > border]
    return model


def _shortlist(cells: list, grads: list, hesses: list, members: list[int], splits: list[Split]) -> list[Split]:
    """The four first splits that look best alone."""
    return [s for _, s in sorted(((-_best(cells, grads, hesses, members, [s])[0], s) for s in splits))[:4]]


def _depth_two(cells: list, grads: list, hesses: list, members: list[int], root: Split, splits: list[Split]) -> tuple[float, Split, None]:
    """The gain of a first split together with the best splits below it."""
    left = [i for i in members if cells[i][root[0]] <= root[1]]
    right = [i for i in members if cells[i][root[0]] > root[1]]
    return _best(cells, grads, hesses, left, splits)[0] + _best(cells, grads, hesses, right, splits)[0], root, None
