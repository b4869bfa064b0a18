"""Keys, location codes and column families."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_key(col: str | Column, prefix: str) -> Column:
    """``"p" + id``; a missing id stays missing."""
    return F.concat(F.lit(prefix), as_col(col).cast("string"))


def composite_key(cols: list[str | Column], sep: str = "_", na: str = "null") -> Column:
    """Join key parts with ``sep``.

    ``na="null"`` makes the whole key missing when a part is missing;
    ``na="literal"`` writes the text ``NA`` for the missing part.
    """
    parts = [as_col(c).cast("string") for c in cols]
    if na == "literal":
        return F.concat_ws(sep, *[F.coalesce(p, F.lit("NA")) for p in parts])
    if na != "null":
        raise ValueError(f"na must be 'null' or 'literal', not {na!r}")
    spaced = [parts[0]]
    for p in parts[1:]:
        spaced += [F.lit(sep), p]
    return F.concat(*spaced)


def split_code(df: DataFrame, col: str, into: list[str], sep: str = "_", remove: bool = True) -> DataFrame:
    """Split ``col`` on a literal delimiter.

    Too few pieces leave the last columns NULL, surplus pieces are dropped.
    ``into`` may name ``col`` itself, which then keeps its first piece.
    """
    pieces = F.split(F.col(col), re.escape(sep))
    out = {name: F.get(pieces, F.lit(i)) for i, name in enumerate(into)}
    split = df.withColumns(out)
    return split if not remove or col in into else split.drop(col)


def split_at(df: DataFrame, col: str, into: tuple[str, str], pos: int, remove: bool = True) -> DataFrame:
    """Cut ``col`` in two: after ``pos`` characters, or ``-pos`` from the end."""
    c, n = F.col(col), F.length(F.col(col))
    cut = F.least(F.lit(pos), n) if pos >= 0 else F.greatest(n + F.lit(pos), F.lit(0))
    split = df.withColumns({into[0]: F.substring(c, F.lit(1), cut), into[1]: F.substring(c, cut + 1, n)})
    return split if not remove or col in into else split.drop(col)


def substr(col: str | Column, start: int, length: int) -> Column:
    """Fixed substring, 1-based."""
    return F.substring(as_col(col), start, length)


def parse_point(df: DataFrame, col: str, distance_type: str = "double") -> DataFrame:
    """``C10E_N`` -> PointType ``C``, Distance 10, TransDir ``E``, PlotDir ``N``.

    The distance keeps all its digits (``P100W`` -> 100); text that is no number
    gives a NULL distance.
    """
    out = split_code(df, col, ["_body", "PlotDir"], "_", remove=False)
    out = split_at(out, "_body", ("_rest", "TransDir"), -1)
    out = split_at(out, "_rest", ("PointType", "_dist"), 1)
    return out.withColumn("Distance", F.col("_dist").try_cast(distance_type)).drop("_dist")


def family(columns: DataFrame | list[str], measure: str, pivot: int = 70) -> list[tuple[str, int]]:
    """Columns ``<measure><yy>`` as (column, four-digit year), oldest first.

    Two-digit years from ``pivot`` on belong to the 1900s. Years come from the
    names, so the order of the columns in the file does not matter.
    """
    names = columns.columns if isinstance(columns, DataFrame) else columns
    hit = re.compile(rf"^{re.escape(measure)}(\d{{2}})$")
    found = [(c, int(m.group(1))) for c in names if (m := hit.match(c))]
    return sorted(((c, yy + (1900 if yy >= pivot else 2000)) for c, yy in found), key=lambda p: p[1])


def drop_columns(df: DataFrame, pattern: str) -> DataFrame:
    """Drop every column whose name matches the regular expression."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def rename_first(df: DataFrame, name: str) -> DataFrame:
    """Rename the first column, whatever it was called."""
    return df.withColumnRenamed(df.columns[0], name)


def plain_names(df: DataFrame) -> DataFrame:
    """Replace dots in column names, which Spark would read as struct access."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])
