"""Survival rates, abundances, climate summaries, compositions, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.bins import bin_by
from ...functions.codes import composite_key
from ...functions.season import WINTER_MONTHS, season_year
from ...functions.status import age_in, recode_family
from ...operators import aggregate as agg
from ...operators.filters import in_months, in_sites, require, since
from ...operators.joins import left_join, order_by_value
from ..order_panel import wide_panel, yy
from . import query, rounded
from .panel import GRID

# Wide year pair for the SQL side: alive at start, alive at end, covariates of the start year.
PAIR = GRID + """, p AS (SELECT a.id, a.birth, a.st AS s0, b.st AS s1, a.dmg, a.lvs, c.c_nationkey, c.c_mktsegment,
  c.c_nationkey || '_' || c.c_mktsegment AS transect,
  CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 6 ELSE floor(c_acctbal / 2000) + 1 END AS INTEGER) AS bin
  FROM g a JOIN g b ON a.id = b.id AND a.y = 1998 AND b.y = 1999 LEFT JOIN customer c ON c.c_custkey = a.id)
"""
_RATE = "round(sum(coalesce(s1, 0)) / count(*), 6) AS rate, count(*)::BIGINT AS abund_start, count(*) FILTER (WHERE s1 = 1)::BIGINT AS abund_end"

BALANCE_BREAKS = (0, 2000, 4000, 6000, 8000, 10000)


def panel(t):
    return recode_family(wide_panel(t.orders))


def panel_with_customers(t):
    """The panel and its customers; both sides have one row per key."""
    who = t.customer.select(
        F.col("c_custkey").alias("id"),
        "c_nationkey",
        "c_mktsegment",
        composite_key(["c_nationkey", "c_mktsegment"]).alias("transect"),
        bin_by("c_acctbal", BALANCE_BREAKS).alias("bin"),
    )
    return left_join(panel(t), who, ["id"])


_PAIRS = ((1995, 1996), (1997, 1998), (1998, 1999), (1997, 1999))


@query(
    GRID + " UNION ALL ".join(
        f"""SELECT '{a}-{b}' AS pair, round(sum(CASE WHEN b.st = 1 THEN 1.0::DOUBLE ELSE 0 END) / count(*), 6) AS rate,
        count(*)::BIGINT AS abund_start, count(*) FILTER (WHERE b.st = 1)::BIGINT AS abund_end
        FROM g a JOIN g b ON a.id = b.id AND a.y = {a} AND b.y = {b} WHERE a.st = 1"""
        for a, b in _PAIRS
    )
)
def cohort_rate_global(t):
    return rounded(agg.survival_rates(panel(t), {f"{a}-{b}": (f"Stat{yy(a)}", f"Stat{yy(b)}") for a, b in _PAIRS}))


@query(PAIR + f"SELECT transect, bin, {_RATE} FROM p WHERE s0 = 1 GROUP BY 1, 2")
def cohort_rate_by_bin(t):
    return rounded(agg.survival_rate(panel_with_customers(t), "Stat98", "Stat99", ["transect", "bin"]))


@query(PAIR + f"SELECT transect, {_RATE}, round(avg(dmg), 6) AS mean_damage FROM p WHERE s0 = 1 GROUP BY 1")
def cohort_rate_by_transect(t):
    return rounded(
        agg.survival_rate(panel_with_customers(t), "Stat98", "Stat99", ["transect"], {"mean_damage": "Damage98"})
    )


@query(
    PAIR + f"""SELECT c_nationkey, {_RATE}, round(avg(dmg), 6) AS mean_damage, round(avg(lvs), 6) AS mean_leaves,
    round(avg(1998 - birth + 1), 6) AS mean_age FROM p WHERE s0 = 1 GROUP BY 1"""
)
def cohort_rate_by_plot(t):
    p = panel_with_customers(t).withColumn("age", age_in("BirthYear", 1998))
    means = {"mean_damage": "Damage98", "mean_leaves": "Lvs98", "mean_age": "age"}
    p = p.withColumn("Lvs98", F.col("Lvs98").try_cast("double"))
    return rounded(agg.survival_rate(p, "Stat98", "Stat99", ["c_nationkey"], means))


@query(
    PAIR + f"""SELECT transect, bin, {_RATE} FROM p WHERE s0 = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2"""
)
def site_filter_rate(t):
    here = in_sites(panel_with_customers(t), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return rounded(agg.survival_rate(here, "Stat98", "Stat99", ["transect", "bin"]))


@query(PAIR + f"SELECT dmg AS \"Damage98\", {_RATE} FROM p WHERE s0 = 1 AND dmg IS NOT NULL GROUP BY 1")
def cohort_rate_by_class(t):
    return require(rounded(agg.survival_rate(panel(t), "Stat98", "Stat99", ["Damage98"])), ["Damage98"])


@query(
    GRID + f"""SELECT a.birth AS "BirthYear", {_RATE} FROM (SELECT a.birth, b.st AS s1 FROM g a JOIN g b ON a.id = b.id
    AND a.y = 1998 AND b.y = 1999 WHERE a.st = 1 AND a.birth <> 1996) a GROUP BY 1"""
)
def cohort_rate_by_cohort(t):
    return rounded(agg.survival_rate(panel(t).filter(F.col("BirthYear") != 1996), "Stat98", "Stat99", ["BirthYear"]))


@query(
    GRID + """SELECT birth AS "BirthYear", sum(CASE WHEN y = 1998 THEN st END)::DOUBLE AS "Abund98",
    sum(CASE WHEN y = 1999 THEN st END)::DOUBLE AS "Abund99" FROM (SELECT id, birth, y, coalesce(st, 0) AS st FROM g) GROUP BY 1"""
)
def abundance_by_cohort(t):
    return agg.abundance(panel(t), ["BirthYear"], {"Abund98": "Stat98", "Abund99": "Stat99"})


# -- seasons ------------------------------------------------------------------

_WINTER = """WITH w AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
  CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS INTEGER) AS "WINTER"
  FROM orders WHERE month(o_orderdate) IN (12, 1, 2) AND o_orderdate >= DATE '1996-06-06'),
s AS (SELECT "WINTER", median(o_totalprice) AS medprice, avg(o_totalprice) AS meanprice, stddev_samp(o_totalprice) AS sdprice,
  count(*) FILTER (WHERE o_totalprice >= 250000)::BIGINT AS highdays, count(*)::BIGINT AS n FROM w GROUP BY 1)
"""


def winter_orders(t):
    cold = in_months(since(t.orders, "o_orderdate", "1996-06-06"), "o_orderdate", WINTER_MONTHS)
    return cold.withColumn("WINTER", season_year("o_orderdate"))


def seasons(t, orders=None):
    return agg.climate_summary(
        winter_orders(t) if orders is None else orders,
        ["WINTER"],
        medians={"medprice": "o_totalprice"},
        means={"meanprice": "o_totalprice"},
        sds={"sdprice": "o_totalprice"},
        at_least={"highdays": ("o_totalprice", 250000)},
        count="n",
    )


SEASON_SQL = _WINTER


@query(
    _WINTER + """SELECT "WINTER", round(medprice, 6) AS medprice, round(meanprice, 6) AS meanprice, round(sdprice, 6) AS sdprice,
    highdays, n FROM s"""
)
def season_summary(t):
    return rounded(seasons(t))


@query(
    _WINTER + """SELECT round(median(medprice), 6) AS medmedprice, round(median(highdays), 6) AS medhighdays,
    round(avg(n), 6) AS mean_n FROM s"""
)
def season_of_seasons(t):
    return rounded(
        agg.summary_of_summaries(seasons(t), {"medmedprice": "medprice", "medhighdays": "highdays"}, {"mean_n": "n"})
    )


@query(
    _WINTER + """SELECT "WINTER", count(*)::BIGINT AS n FROM w WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY 1"""
)
def season_counts(t):
    site = since(t.orders, "o_orderdate", "1996-06-06", ("o_orderstatus", "F"))
    rows = in_months(site, "o_orderdate", WINTER_MONTHS).withColumn("WINTER", season_year("o_orderdate"))
    known = F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice"))
    return agg.freq(require(rows.withColumn("known", known), ["known"]), ["WINTER"])


@query(
    _WINTER + """, v AS (SELECT "WINTER", CASE WHEN o_totalprice < 2000 AND "WINTER" = 1998 THEN NULL ELSE o_totalprice END AS x,
      o_totalprice AS y FROM w)
    SELECT "WINTER", CASE WHEN count(x) = count(*) THEN count(*) FILTER (WHERE x <= 50000)::BIGINT END AS below,
    CASE WHEN count(x) = count(*) THEN round(avg(x), 6) END AS meanave, CASE WHEN count(x) = count(*) THEN round(stddev_samp(x), 6) END AS sdave,
    round(avg(y), 6) AS meanmax, round(stddev_samp(y), 6) AS sdmax FROM v GROUP BY 1"""
)
def temperature_summary(t):
    hole = (F.col("o_totalprice") < 2000) & (F.col("WINTER") == 1998)
    rows = winter_orders(t).select(
        "WINTER", F.when(~hole, F.col("o_totalprice")).alias("x"), F.col("o_totalprice").alias("y")
    )
    return rounded(agg.temperature_summary(rows, ["WINTER"], ("x", 50000), {"ave": "x", "max": "y"}))


@query(
    """SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS scaled
    FROM part"""
)
def standardize(t):
    return rounded(agg.standardize(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "scaled").drop("p_retailprice"))


# -- tables, compositions, classes -------------------------------------------


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def freq_table(t):
    return order_by_value(agg.freq(t.events, ["event_type"], na="drop"), "n", desc=True)


@query("SELECT value < 5 AS is_missing, count(*)::BIGINT AS n FROM events GROUP BY 1")
def freq_missing(t):
    return agg.freq_missing(t.events.select(F.when(F.col("value") >= 5, F.col("value")).alias("value")), "value")


@query(
    """SELECT l_shipdate_year, CASE WHEN l_discount > 0 THEN l_returnflag END AS class, count(*)::BIGINT AS n
    FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year FROM lineitem) GROUP BY 1, 2"""
)
def category_counts(t):
    rows = t.lineitem.select(
        F.year("l_shipdate").alias("l_shipdate_year"), F.when(F.col("l_discount") > 0, F.col("l_returnflag")).alias("class")
    )
    return agg.freq(rows, ["l_shipdate_year", "class"])


_FLAGS = ("A", "N", "R")
_SUMS = ", ".join(f"sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity ELSE 0 END) AS \"{f}sum\"" for f in _FLAGS)
_SHARES = ", ".join(f'round("{f}sum", 6) AS "{f}sum", round("{f}sum" / "Plottotal", 6) AS "{f}per"' for f in _FLAGS)


def _flag_parts(t, total):
    parts = [F.when(F.col("l_returnflag") == f, F.col("l_quantity")).alias(f) for f in _FLAGS]
    return t.lineitem.select("l_suppkey", total.alias("Total"), *parts)


@query(
    f"""WITH c AS (SELECT l_suppkey, sum(l_quantity) AS "Plottotal", {_SUMS} FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round("Plottotal", 6) AS "Plottotal", {_SHARES} FROM c"""
)
def composition(t):
    return rounded(agg.composition(_flag_parts(t, F.col("l_quantity")), ["l_suppkey"], list(_FLAGS), "Total"))


@query(
    f"""WITH c AS (SELECT l_suppkey, {_SUMS}, sum(l_quantity) AS "Plottotal" FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round("Plottotal", 6) AS "Plottotal", {_SHARES} FROM c"""
)
def composition_from_parts(t):
    return rounded(agg.composition(_flag_parts(t, F.col("l_quantity")).drop("Total"), ["l_suppkey"], list(_FLAGS)))


@query(
    f"""WITH c AS (SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE l_quantity = 50 AND l_discount = 0.1::DOUBLE) = 0 THEN sum(l_quantity) END
      AS "Plottotal", {_SUMS} FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round("Plottotal", 6) AS "Plottotal", {_SHARES} FROM c"""
)
def composition_poisoned(t):
    hole = (F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1)
    rows = _flag_parts(t, F.when(~hole, F.col("l_quantity")))
    return rounded(agg.composition(rows, ["l_suppkey"], list(_FLAGS), "Total", na_rm_total=False))


@query(
    """SELECT s_nationkey, CAST(CASE WHEN l_quantity >= 50 THEN 6 ELSE floor(l_quantity / 10) + 1 END AS INTEGER) AS bin,
    round(avg(l_discount), 6) AS mean_discount, round(avg(l_tax), 6) AS mean_tax, round(avg(NULLIF(l_discount, 0)), 6) AS mean_known
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"""
)
def env_means(t):
    return rounded(environment(t))


def environment(t):
    """Line item means per supplier nation and quantity bin; suppliers have unique keys."""
    sites = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = left_join(t.lineitem.select("l_suppkey", "l_quantity", "l_discount", "l_tax"), sites, ["l_suppkey"], small=True)
    rows = rows.filter(F.col("s_nationkey").isNotNull()).withColumns(
        {"bin": bin_by("l_quantity", (0, 10, 20, 30, 40, 50)), "known": F.nullif(F.col("l_discount"), F.lit(0.0))}
    )
    return agg.mean_by(
        rows, ["s_nationkey", "bin"], {"mean_discount": "l_discount", "mean_tax": "l_tax", "mean_known": "known"}
    )


# Outcome by class, used by the model queries too: returned (1/0) by order priority.
RETURNED_SQL = """WITH r AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS class,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, l_discount AS discount, l_tax AS tax, l_quantity AS quantity,
  CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS open
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""


def returned(t):
    """Line items with their order's priority class; order keys are unique."""
    o = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("class")
    )
    li = t.lineitem.select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("open"),
    )
    return li.join(o, "l_orderkey").drop("l_orderkey")


@query(
    RETURNED_SQL + "SELECT class, count(*)::BIGINT AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd FROM r GROUP BY 1"
)
def class_stats(t):
    return rounded(agg.class_stats(returned(t), "class", "y"))


@query(
    RETURNED_SQL + """SELECT CASE WHEN class <= 2 THEN 'low' ELSE 'high' END AS pool, count(*)::BIGINT AS n, round(avg(y), 6) AS mean,
    round(stddev_samp(y), 6) AS sd FROM r WHERE class <> 3 GROUP BY 1"""
)
def pooled_class_stats(t):
    return rounded(agg.pooled_class_stats(returned(t), "class", "y", {"low": [1, 2], "high": [4, 5]}))


_PROFILE = ("l_quantity", "l_extendedprice", "known_discount", "l_tax")


@query(
    "WITH v AS (SELECT *, NULLIF(l_discount, 0) AS known_discount FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c})::BIGINT AS n, (count(*) - count({c}))::BIGINT AS n_missing, min({c}) AS min,
        round(avg({c}), 6) AS mean, max({c}) AS max, round(stddev_samp({c}), 6) AS sd, round(quantile_cont({c}, 0.25), 6) AS q1,
        round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM v"""
        for c in _PROFILE
    )
)
def profile(t):
    v = t.lineitem.withColumn("known_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return rounded(agg.profile(v, list(_PROFILE)))


def _box_sql(table: str, group: str, value: str) -> str:
    """Hinges are means of the one or two values at depth d from either end."""
    return f"""WITH v AS (SELECT {group} AS g, {value} AS x, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS r,
      count(*) OVER (PARTITION BY {group}) AS n FROM {table} WHERE {value} IS NOT NULL),
    d AS (SELECT *, floor((n + 3) / 2) / 2 AS d FROM v),
    q AS (SELECT g, avg(x) FILTER (WHERE r IN (floor(d), ceil(d))) AS q1, median(x) AS median,
      avg(x) FILTER (WHERE n + 1 - r IN (floor(d), ceil(d))) AS q3 FROM d GROUP BY g),
    b AS (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS within FROM v JOIN q USING (g))
    SELECT g AS {group}, count(*)::BIGINT AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
    round(any_value(q3), 6) AS q3, min(x) FILTER (WHERE within) AS whisker_low, max(x) FILTER (WHERE within) AS whisker_high,
    count(*) FILTER (WHERE NOT within)::BIGINT AS n_outliers FROM b GROUP BY g"""


@query(_box_sql("orders", "o_orderpriority", "o_totalprice"))
def box_stats(t):
    return rounded(agg.box_stats(t.orders, ["o_orderpriority"], "o_totalprice"))


@query(_box_sql("events", "event_type", "value"))
def box_stats_large_groups(t):
    """The same operator with every group treated as too large for one task."""
    return rounded(agg.box_stats(t.events, ["event_type"], "value", group_rows=500))
