"""Panel reshapes, interval records, ages, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.season import split_interval, with_end_year
from ...functions.status import mask_where, ratio, recode_family
from ...operators import aggregate as agg
from ...operators import panel as pan
from ...operators import reshape
from ...operators.filters import drop_interval
from ...operators.joins import order_by_value
from ..order_panel import YEARS, interval_records as records_of, wide_panel, yy
from . import query, rounded

# One row per (customer, year) with the raw status and the recoded one, in plain SQL.
GRID = """
WITH oy AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n,
         max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS d,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o
  FROM orders GROUP BY 1, 2),
who AS (SELECT id, min(y) AS born, min(y) FILTER (WHERE f > 0) AS seen FROM oy GROUP BY 1),
yrs AS (SELECT CAST(range AS INTEGER) AS y FROM range(1995, 2002)),
g0 AS (
  SELECT w.id, w.born, CASE WHEN w.seen = w.born THEN w.born END AS birth, yrs.y, oy.n, oy.d, oy.f, oy.o
  FROM who w CROSS JOIN yrs LEFT JOIN oy ON oy.id = w.id AND oy.y = yrs.y),
g1 AS (
  SELECT *, lag(n) OVER (PARTITION BY id ORDER BY y) AS n1, lag(n, 2) OVER (PARTITION BY id ORDER BY y) AS n2 FROM g0),
g2 AS (
  SELECT *, CASE WHEN n > 0 THEN '1' WHEN y < born THEN NULL WHEN n1 > 0 THEN 'PD' WHEN n2 > 0 THEN 'NF' ELSE '0' END AS raw
  FROM g1),
g AS (
  SELECT id, born, birth, y, raw, CASE WHEN raw IS NULL THEN NULL WHEN raw = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS st,
         n::DOUBLE AS lvs, d::DOUBLE AS dmg, f::DOUBLE AS live, o::DOUBLE AS dead,
         CASE WHEN f + o > 0 THEN f::DOUBLE / (f + o) END AS lvd
  FROM g2),
iv0 AS (SELECT *, lag(st) OVER (PARTITION BY id ORDER BY y) AS prev FROM g),
iv AS (
  SELECT id, birth, CAST(y - 1 AS VARCHAR) || '-' || CAST(y AS VARCHAR) AS interval, CAST(y - 1 AS INTEGER) AS start_int,
         CAST(y AS INTEGER) AS end_int, st AS survival, lvs AS leafNumber, dmg AS seedDamage, lvd AS brchLvD
  FROM iv0 WHERE prev = 1 AND st IS NOT NULL)
"""


@query(
    GRID + """SELECT interval, round(sum(survival) / count(*), 6) AS propSurv, count(*)::BIGINT AS abund
    FROM iv GROUP BY interval"""
)
def interval_survival(t):
    return rounded(agg.interval_survival(records_of(t.orders, [])))


@query(
    GRID + """SELECT id, interval, start_int, end_int, survival, leafNumber, seedDamage, round(brchLvD, 6) AS brchLvD,
    (start_int - coalesce(birth, min(start_int) OVER (PARTITION BY id)) + 1)::DOUBLE AS yearsAlive FROM iv"""
)
def interval_records(t):
    age = pan.age_from_start(F.col("BirthYear"), F.col("start_int"), F.col("first_start")).cast("double")
    return rounded(records_of(t.orders).withColumn("yearsAlive", age).drop("BirthYear", "first_start"))


@query(GRID + "SELECT id, y AS year, lvs AS leafNumber FROM g")
def unpivot_family(t):
    return reshape.unpivot_family(wide_panel(t.orders), ["id"], "Lvs", "leafNumber")


@query(GRID + "SELECT id, y AS year, st AS Stat, lvs AS Lvs, dmg AS Damage, CAST(NULL AS DOUBLE) AS Hgt FROM g")
def unpivot_families(t):
    panel = recode_family(wide_panel(t.orders))
    return reshape.unpivot_families(panel, ["id"], ["Stat", "Lvs", "Damage", "Hgt"])


@query(
    """SELECT CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN l_returnflag ELSE 'other' END AS Species, round(sum(l_quantity), 6) AS Abund FROM lineitem GROUP BY 1
    UNION ALL SELECT 'other', 0.0 WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N', 'R'))
    ORDER BY 2 DESC"""
)
def gather_columns(t):
    """A column per flag and one for all others, so every line item counts."""
    flags = ["A", "N", "R"]
    flag, known = F.col("l_returnflag"), F.coalesce(F.col("l_returnflag").isin(flags), F.lit(False))
    wide = t.lineitem.select(*[F.when(flag == f, F.col("l_quantity")).alias(f) for f in flags], F.when(~known, F.col("l_quantity")).alias("other"))
    gathered = reshape.gather(agg.sum_columns(wide, [*flags, "other"]), [], [*flags, "other"], "Species", "Abund")
    return order_by_value(rounded(gathered), "Abund", True)


@query(
    """WITH s AS (SELECT l_partkey AS id, CAST(year(l_shipdate) AS INTEGER) AS y,
                  max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS st FROM lineitem GROUP BY 1, 2),
    p AS (SELECT *, lag(st) OVER w AS prev, lag(y) OVER w AS py FROM s WINDOW w AS (PARTITION BY id ORDER BY y))
    SELECT id, py AS start_int, y AS end_int, st::DOUBLE AS survival FROM p WHERE prev = 1 AND py = y - 1"""
)
def transitions_long(t):
    states = t.lineitem.select(
        F.col("l_partkey").alias("id"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("status"),
    )
    return pan.transitions_long(states, ["id"], "year", "status")


def _aged(t, mode: str):
    rows = records_of(t.orders, []).select("id", "interval", "BirthYear", "start_int")
    out = pan.with_age(rows, ["id"], "BirthYear", "start_int", mode)
    return out.select("id", "interval", "yearsAlive")


@query(
    GRID + """SELECT id, interval, (start_int - coalesce(birth, min(start_int) OVER (PARTITION BY id)) + 1)::DOUBLE AS yearsAlive
    FROM iv"""
)
def age_at_interval(t):
    return _aged(t, "true")


@query(
    GRID + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_int) AS up,
      row_number() OVER (PARTITION BY id ORDER BY start_int DESC) AS down,
      min(start_int) OVER (PARTITION BY id) AS lo, max(start_int) OVER (PARTITION BY id) AS hi FROM iv)
    SELECT a.id, a.interval, (a.hi - coalesce(a.birth, a.lo) + 1 - (b.start_int - a.lo))::DOUBLE AS yearsAlive
    FROM r a JOIN r b ON a.id = b.id AND a.down = b.up"""
)
def age_mirrored(t):
    return _aged(t, "mirrored")


@query(
    GRID + """SELECT id, min(start_int) AS first_year, max(start_int) AS last_year FROM iv GROUP BY id"""
)
def individual_span(t):
    return pan.span(records_of(t.orders, []), ["id"], "start_int")


@query(
    GRID + """SELECT id, interval, start_int, end_int, end_int AS "WINTER", survival FROM iv WHERE interval <> '1995-1996'"""
)
def interval_ends(t):
    rows = records_of(t.orders, []).select("id", "interval", "survival")
    return with_end_year(split_interval(drop_interval(rows, "1995-1996")))


@query(
    GRID + "SELECT id, y AS year, round(lvd, 6) AS ratio FROM g"
)
def branch_ratio(t):
    p = reshape.unpivot_families(wide_panel(t.orders), ["id"], ["LiveBrch", "DeadBrch"])
    return rounded(p.select("id", "year", ratio("LiveBrch", "DeadBrch").alias("ratio")))


_MASKED = ", ".join(
    f"max(CASE WHEN y = {y} AND p <> 0 THEN s END) AS surv{yy(y)}" for y in YEARS[1:]
)


@query(
    GRID + f""", z AS (SELECT id, y, CASE WHEN raw = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM g),
    zz AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY y) AS p FROM z)
    SELECT id, {_MASKED} FROM zz GROUP BY id"""
)
def mask_not_alive(t):
    p = recode_family(wide_panel(t.orders), "Stat", "codes_and_missing_dead")
    return p.select(
        "id",
        *[mask_where(f"Stat{yy(y)}", F.col(f"Stat{yy(y - 1)}") == 0).alias(f"surv{yy(y)}") for y in YEARS[1:]],
    )


@query(
    GRID + """SELECT id, y AS year, dmg AS seedDamage, CASE WHEN st = 1 THEN 0.0::DOUBLE + dmg ELSE 0.0::DOUBLE END AS aliveDamage FROM g"""
)
def mask_to_zero(t):
    p = reshape.unpivot_families(recode_family(wide_panel(t.orders)), ["id"], ["Stat", "Damage"])
    alive = mask_where("Damage", F.coalesce(F.col("Stat") != 1, F.lit(True)), 0.0)
    return p.select("id", "year", F.col("Damage").alias("seedDamage"), alive.alias("aliveDamage"))


# -- duplicates: the line item key is held by up to several rows -------------

_LINES = """WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'R' THEN 'PD' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL
       WHEN l_linestatus = 'O' THEN '1' ELSE '0' END AS last_status FROM lineitem)
"""
_KEY = ["l_orderkey", "l_linenumber"]


def _lines(t):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    code = (
        F.when(flag == "R", "PD")
        .when((flag == "N") & (status == "F"), F.lit(None).cast("string"))
        .when(status == "O", "1")
        .otherwise("0")
    )
    return t.lineitem.select(*_KEY, "l_partkey", "l_suppkey", code.alias("last_status"))


@query(
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_keys, count(*) FILTER (WHERE n > 1)::BIGINT AS n_duplicated_keys,
    sum(n - 1)::BIGINT AS n_surplus_rows FROM k"""
)
def key_audit(t):
    return pan.key_audit(t.lineitem, _KEY)


@query(
    _LINES + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_status,
    (count(*) OVER (PARTITION BY l_orderkey, l_linenumber))::BIGINT AS "count",
    count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dups FROM li"""
)
def tag_duplicates(t):
    return pan.tag_duplicates(_lines(t), _KEY)


@query(
    _LINES + """, c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM li)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_status FROM c
    WHERE NOT (n > 1 AND last_status IS NOT DISTINCT FROM '0')"""
)
def drop_dead_duplicates(t):
    return pan.drop_dead_duplicates(_lines(t), _KEY, "last_status")
