"""Typed reads of delimited and Parquet tables, and the one sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    null_value: str = "NA",
    fmt: str | None = None,
) -> DataFrame:
    """Read a table; CSV gets an explicit schema, a header and ``NA`` as missing.

    A UTF-8 byte order mark is tolerated. Columns are matched by name against the
    header, so a file whose columns come in another order still reads right.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    raw = spark.read.options(header=True, nullValue=null_value, inferSchema=False).csv(path)
    if schema is None:
        return raw
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # Everything is read as text first: a dirty cell becomes NULL, never an error.
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return raw.select(*[raw[f"`{f.name}`"].try_cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace the table at ``path``."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header=True, nullValue="NA").csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
