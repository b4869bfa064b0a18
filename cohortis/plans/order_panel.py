"""A census panel read out of an order history.

Individual = customer, census year = order year, alive = ordered in that year.
``orders`` becomes the wide table a census yields: ``Stat`` codes with ``PD`` in
the first missed year and ``NF`` in the second, nothing before the first order;
``Lvs`` = orders of the year, ``Damage`` = largest priority digit, ``LiveBrch`` and
``DeadBrch`` = orders of status F and O.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import family
from ..functions.status import ratio, recode_family
from ..operators.reshape import family_measure, to_intervals

YEARS = tuple(range(1995, 2002))


class Tables:
    """The Parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def yy(year: int) -> str:
    return f"{year % 100:02d}"


def wide_panel(orders: DataFrame, years: tuple[int, ...] = YEARS) -> DataFrame:
    """One row per customer; a single aggregation, so a customer with very many orders is no burden.

    An order of a year that is not in ``years`` would be missing from the panel, so it is an error; one without a date
    belongs to no year.
    """
    year = F.year("o_orderdate")
    outside = F.raise_error(F.concat(F.lit("order outside the years of the panel: "), year.cast("string"))).cast("int")
    o = orders.select(
        F.col("o_custkey").alias("id"),
        F.when(year.isNull() | year.isin(*years), year).otherwise(outside).alias("_y"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("_p"),
        F.col("o_orderstatus").alias("_s"),
    )
    aggs = [F.expr("min(_y) AS _born"), F.expr("min(CASE WHEN _s = 'F' THEN _y END) AS _seen")]
    for y in years:
        aggs += [
            F.expr(f"count_if(_y = {y}) AS _n{y}"),
            F.expr(f"max(CASE WHEN _y = {y} THEN _p END) AS _d{y}"),
            F.expr(f"count_if(_y = {y} AND _s = 'F') AS _f{y}"),
            F.expr(f"count_if(_y = {y} AND _s = 'O') AS _o{y}"),
        ]
    grouped = o.groupBy("id").agg(*aggs)

    def ordered(y: int) -> Column:
        return F.col(f"_n{y}") > 0 if y in years else F.lit(False)

    cols = [F.col("id"), F.when(F.col("_seen") == F.col("_born"), F.col("_born")).alias("BirthYear")]
    for y in years:
        stat = (
            F.when(ordered(y), "1")
            .when(F.lit(y) < F.col("_born"), F.lit(None).cast("string"))
            .when(ordered(y - 1), "PD")
            .when(ordered(y - 2), "NF")
            .otherwise("0")
        )
        cols += [
            stat.alias(f"Stat{yy(y)}"),
            F.when(ordered(y), F.col(f"_n{y}")).cast("string").alias(f"Lvs{yy(y)}"),
            F.col(f"_d{y}").cast("double").alias(f"Damage{yy(y)}"),
            F.when(ordered(y), F.col(f"_f{y}")).alias(f"LiveBrch{yy(y)}"),
            F.when(ordered(y), F.col(f"_o{y}")).alias(f"DeadBrch{yy(y)}"),
        ]
    return grouped.select(*cols)


def census_measures(panel: DataFrame) -> dict[str, dict[int, Column]]:
    """Leaf number, damage and live-branch share, each under the year it ends."""
    live, dead = dict((y, c) for c, y in family(panel, "LiveBrch")), dict((y, c) for c, y in family(panel, "DeadBrch"))
    return {
        "leafNumber": family_measure(panel, "Lvs"),
        "seedDamage": family_measure(panel, "Damage"),
        "brchLvD": {
            y: ratio(F.col(live[y]).try_cast("double"), F.col(dead[y]).try_cast("double")) for y in live if y in dead
        },
    }


def interval_records(orders: DataFrame, measures: list[str] = ("leafNumber", "seedDamage", "brchLvD")) -> DataFrame:
    """Recoded interval records of the order panel.

    Name the measures a query needs: Spark cannot drop unused fields of the reshaped
    structs by itself, and each measure costs an aggregate per year.
    """
    panel = recode_family(wide_panel(orders))
    available = census_measures(panel)
    wanted = {m: available[m] for m in measures}
    return to_intervals(panel, ["id"], "Stat", wanted, keep=["BirthYear"], first_start="first_start")
