"""Wide to long. Every reshape is one pass over the wide rows: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import family
from ..functions.season import interval_label
from ..functions.status import to_num, transition


def unpivot_family(df: DataFrame, ids: list[str], measure: str, value: str, label: str = "year") -> DataFrame:
    """One row per (id, year) of a column family; missing values are kept.

    ``label="interval"`` names the interval ending in the year instead.
    """
    rows = [
        F.struct(
            (interval_label(y) if label == "interval" else F.lit(y)).alias(label),
            to_num(c).alias(value),
        )
        for c, y in family(df, measure)
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def unpivot_families(df: DataFrame, ids: list[str], measures: list[str], label: str = "year") -> DataFrame:
    """Several families at once, one value column each; a family without the year gives NULL."""
    columns = {m: dict((y, c) for c, y in family(df, m)) for m in measures}
    years = sorted({y for by_year in columns.values() for y in by_year})
    rows = [
        F.struct(
            F.lit(y).alias(label),
            *[(to_num(columns[m][y]) if y in columns[m] else F.lit(None).cast("double")).alias(m) for m in measures],
        )
        for y in years
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def gather(df: DataFrame, ids: list[str], cols: list[str], key: str, value: str) -> DataFrame:
    """Named columns to (name, value) rows."""
    return df.unpivot(ids, cols, key, value)


def to_intervals(
    df: DataFrame,
    ids: list[str],
    status: str = "Stat",
    measures: dict[str, dict[int, Column]] | None = None,
    keep: list[str] = (),
    drop_missing: bool = True,
    first_start: str | None = None,
) -> DataFrame:
    """Interval records from a wide panel with recoded statuses.

    Each pair of consecutive years gives a record (label, start, end, survival);
    ``measures`` maps an output column to its expression per end year. Years are
    paired by name, so a missing year column breaks the chain instead of bridging it.
    ``first_start`` adds the start of the row's earliest record, still in the same
    pass (right when a row holds the individual's whole history).
    """
    stats = {y: c for c, y in family(df, status)}
    measures = measures or {}
    rows = []
    for y in sorted(stats):
        if y - 1 not in stats:
            continue
        rows.append(
            F.struct(
                interval_label(y).alias("interval"),
                F.lit(y - 1).alias("start_int"),
                F.lit(y).alias("end_int"),
                transition(stats[y - 1], stats[y]).alias("survival"),
                *[
                    by_year.get(y, F.lit(None)).cast("double").alias(name)
                    for name, by_year in measures.items()
                ],
            )
        )
    extra = []
    if first_start:
        starts = [F.when(r["survival"].isNotNull(), r["start_int"]) for r in rows]
        extra = [(F.least(*starts) if len(starts) > 1 else starts[0]).alias(first_start)]
    long = df.select(*ids, *keep, *extra, F.inline(F.array(*rows)))
    return long.filter(F.col("survival").isNotNull()) if drop_missing else long


def family_measure(df: DataFrame, measure: str) -> dict[int, Column]:
    """A family as a ``measures`` entry of :func:`to_intervals`, cast to numbers."""
    return {y: to_num(c) for c, y in family(df, measure)}
