"""Status codes, tolerant casts, masks and the survival transition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import as_col, family

# Census codes that mean "dead", and the three ways of reading them.
DEAD_CODES = ("PD", "NF", "nf")
POLICIES = {
    "missing_is_dead": (("PD",), "dead"),
    "codes_and_missing_dead": (DEAD_CODES, "dead"),
    "codes_dead_keep_missing": (DEAD_CODES, "keep"),
}


def to_num(col: str | Column) -> Column:
    """Number, or NULL where the text is none."""
    return as_col(col).try_cast("double")


def recode_status(col: str | Column, dead: tuple[str, ...] = DEAD_CODES, missing: str = "keep") -> Column:
    """Status text to 1/0: dead codes become 0 before the cast, missing stays or becomes 0."""
    if missing not in ("keep", "dead"):
        raise ValueError(f"missing must be 'keep' or 'dead', not {missing!r}")
    c = as_col(col).cast("string")
    out = F.when(c.isin(*dead), F.lit(0.0))
    if missing == "dead":
        out = out.when(c.isNull(), F.lit(0.0))
    return out.otherwise(c.try_cast("double"))


def recode_by_policy(col: str | Column, policy: str = "codes_dead_keep_missing") -> Column:
    dead, missing = POLICIES[policy]
    return recode_status(col, dead, missing)


def recode_family(df: DataFrame, measure: str = "Stat", policy: str = "codes_dead_keep_missing") -> DataFrame:
    return df.withColumns({c: recode_by_policy(c, policy) for c, _ in family(df, measure)})


def replace_all(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Replace whole values in every string column."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.replace(mapping, subset=texts) if texts else df


def cast_family(df: DataFrame, measure: str) -> DataFrame:
    return df.withColumns({c: to_num(c) for c, _ in family(df, measure)})


def null_if(df: DataFrame, cols: list[str], sentinel: float) -> DataFrame:
    """Sentinel value to NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def mask_where(col: str | Column, cond: Column, value: float | str | None = None) -> Column:
    """``value`` where ``cond`` holds, the column elsewhere (also where ``cond`` is missing)."""
    return F.when(cond, F.lit(value)).otherwise(as_col(col))


def transition(prev: str | Column, cur: str | Column) -> Column:
    """1 survived, 0 died, NULL when not alive at the start or unknown at the end."""
    p, c = as_col(prev), as_col(cur)
    return F.when((p == 1) & c.isin(0, 1), c.cast("double"))


def age_in(birth: str | Column, year: int | Column) -> Column:
    """Age in ``year``, counting the birth year as 1."""
    return (F.lit(year) if isinstance(year, int) else year) - as_col(birth) + 1


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / (a + b)``; NULL when either is missing or both are zero."""
    x, y = as_col(a), as_col(b)
    return F.try_divide(x, x + y)


def log_of(col: str | Column) -> Column:
    """Natural log; NULL at or below zero."""
    c = as_col(col)
    return F.when(c > 0, F.log(c))


def as_factor(df: DataFrame, col: str) -> DataFrame:
    """Treat a column as categories: whole numbers lose their ``.0``, the first level in number order is the baseline."""
    c = F.col(col)
    if dict(df.dtypes)[col] in ("double", "float"):
        return df.withColumn(col, F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")))
    return df.withColumn(col, c.cast("string"))
