"""Left joins with their quirks, semi and anti joins, lookups, climate joins, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.bins import bin_by, side_offset
from ...functions.codes import composite_key
from ...functions.season import season_year
from ...operators import aggregate as agg
from ...operators import joins
from ...operators.reshape import unpivot_family
from ..order_panel import interval_records, wide_panel
from . import query, rounded
from .aggregates import SEASON_SQL, environment, seasons, winter_orders
from .panel import GRID

# Environment means per nation and bin, as SQL.
_ENV = """env AS (SELECT s_nationkey AS nation, CAST(CASE WHEN l_quantity >= 50 THEN 6 ELSE floor(l_quantity / 10) + 1 END AS INTEGER) AS bin,
  avg(l_discount) AS mean_discount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def _bin_key(df, nation):
    return df.withColumn("key", composite_key([nation, "bin"]))


@query(
    f"""WITH {_ENV}, c AS (SELECT c_nationkey || '_' || CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 6
      ELSE floor(c_acctbal / 2000) + 1 END AS INTEGER) AS key, count(*)::BIGINT AS abund, avg(c_acctbal) AS balance FROM customer GROUP BY 1)
    SELECT nation || '_' || bin AS key, nation AS s_nationkey, bin, round(mean_discount, 6) AS mean_discount, abund, round(balance, 6) AS balance
    FROM env LEFT JOIN c ON c.key = nation || '_' || bin"""
)
def left_join_bins(t):
    """Both sides are aggregates of one row per bin key."""
    env = _bin_key(environment(t).select("s_nationkey", "bin", "mean_discount"), "s_nationkey")
    cust = t.customer.withColumn("bin", bin_by("c_acctbal", (0, 2000, 4000, 6000, 8000, 10000)))
    cust = _bin_key(cust, "c_nationkey").groupBy("key").agg(F.count(F.lit(1)).alias("abund"), F.avg("c_acctbal").alias("balance"))
    return rounded(joins.left_join(env, cust, ["key"]))


@query(
    f"""WITH {_ENV} SELECT nation || '_' || bin AS key, round(mean_discount, 6) AS mean_discount, c_custkey, c_acctbal
    FROM env LEFT JOIN customer ON c_nationkey || '_' || CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 6
      ELSE floor(c_acctbal / 2000) + 1 END AS INTEGER) = nation || '_' || bin"""
)
def left_join_fanout(t):
    """One bin row meets many points."""
    env = _bin_key(environment(t).select("s_nationkey", "bin", "mean_discount"), "s_nationkey").select("key", "mean_discount")
    cust = t.customer.withColumn("bin", bin_by("c_acctbal", (0, 2000, 4000, 6000, 8000, 10000)))
    points = _bin_key(cust, "c_nationkey").select("key", "c_custkey", "c_acctbal")
    return rounded(joins.fan_out_join(env, points, ["key"]))


@query(
    """SELECT c.nationkey AS nationkey, c.c_custkey, c.name AS name_x, n.name AS name_y, n.adj
    FROM (SELECT c_custkey, c_name AS name, c_nationkey AS nationkey FROM customer) c
    LEFT JOIN (SELECT n_nationkey AS nationkey, n_name AS name, CASE n_regionkey WHEN 1 THEN -50.0::DOUBLE WHEN 2 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS adj
      FROM nation WHERE n_regionkey <> 3) n ON c.nationkey = n.nationkey"""
)
def left_join_suffix(t):
    c = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"))
    n = t.nation.filter(F.col("n_regionkey") != 3).select(
        F.col("n_nationkey").alias("nationkey"),
        F.col("n_name").alias("name"),
        side_offset(F.col("n_regionkey").cast("string"), {"1": -50, "2": 50}).alias("adj"),
    )
    return joins.left_join(c, n, ["nationkey"], small=True)


@query(
    """SELECT a.point, a.o_totalprice, b.n, round(b.mean_quantity, 6) AS mean_quantity
    FROM (SELECT o_orderkey AS point, o_totalprice FROM orders) a
    LEFT JOIN (SELECT l_orderkey AS point, count(*)::BIGINT AS n, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1) b ON a.point = b.point"""
)
def left_join_points(t):
    left = t.orders.select(F.col("o_orderkey").alias("point"), "o_totalprice")
    right = t.lineitem.groupBy(F.col("l_orderkey").alias("point")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity")
    )
    return rounded(joins.left_join(left, right, ["point"], unique=True))


@query(
    GRID + """, lv AS (SELECT id, CAST(y - 1 AS VARCHAR) || '-' || CAST(y AS VARCHAR) AS interval, lvs AS leafNumber FROM g),
    dm AS (SELECT id, CAST(y - 1 AS VARCHAR) || '-' || CAST(y AS VARCHAR) AS interval, dmg AS seedDamage FROM g)
    SELECT id, interval, survival, lv.leafNumber, dm.seedDamage FROM iv LEFT JOIN lv USING (id, interval) LEFT JOIN dm USING (id, interval)"""
)
def left_join_natural(t):
    """Chained joins on all shared columns; the interval records carry the same measures without a join."""
    p = wide_panel(t.orders)
    out = interval_records(t.orders, []).select("id", "interval", "survival")
    for measure, name in (("Lvs", "leafNumber"), ("Damage", "seedDamage")):
        out = joins.left_join_natural(out, unpivot_family(p, ["id"], measure, name, label="interval"))
    return out


_CUST = "CASE WHEN c_acctbal >= 0 THEN c_nationkey END"


@query(
    f"""SELECT c_custkey, s.n FROM (SELECT c_custkey, {_CUST} AS k FROM customer) c
    LEFT JOIN (SELECT CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS k, count(*)::BIGINT AS n FROM supplier GROUP BY 1) s
    ON c.k IS NOT DISTINCT FROM s.k"""
)
def left_join_nullsafe(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("k"))
    s = t.supplier.groupBy(F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return joins.left_join(c, s, ["k"], null_safe=True, unique=True).drop("k")


@query(
    f"""SELECT c_custkey, s.n FROM (SELECT c_custkey, {_CUST} AS k FROM customer) c
    LEFT JOIN (SELECT CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS k, count(*)::BIGINT AS n FROM supplier GROUP BY 1) s ON c.k = s.k"""
)
def left_join_null_unmatched(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("k"))
    s = t.supplier.groupBy(F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return joins.left_join(c, s, ["k"], unique=True).drop("k")


@query(
    """SELECT o_orderkey, o_custkey, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def lookup_join(t):
    dim = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return joins.lookup(t.orders.select("o_orderkey", "o_custkey"), dim, "o_custkey", "c_acctbal")


@query(
    SEASON_SQL + """SELECT o_orderkey, w.winter AS "WINTER", round(s.medprice, 6) AS medprice, s.highdays
    FROM (SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS INTEGER) AS winter FROM orders) w
    LEFT JOIN s ON s."WINTER" = w.winter"""
)
def climate_join(t):
    rows = t.orders.select("o_orderkey", season_year("o_orderdate").alias("WINTER"))
    return rounded(joins.join_climate(rows, seasons(t).select("WINTER", "medprice", "highdays")))


@query(
    SEASON_SQL + """, s2 AS (SELECT "WINTER", median(o_totalprice) AS medprice FROM w WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT "WINTER", round(s.medprice, 6) AS medprice_x, round(s2.medprice, 6) AS medprice_y FROM s JOIN s2 USING ("WINTER")"""
)
def pair_on_season(t):
    site = seasons(t, winter_orders(t).filter(F.col("o_orderstatus") == "F"))
    pick = ["WINTER", "medprice"]
    return rounded(joins.pair_on(seasons(t).select(*pick), site.select(*pick), "WINTER"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def semi_join(t):
    big = t.orders.filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi_join(t.customer.select("c_custkey", "c_mktsegment"), big, ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti_join(t):
    big = t.orders.filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_join(t.customer.select("c_custkey", "c_mktsegment"), big, ["c_custkey"])


@query(
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'"""
)
def union_fill(t):
    """Two slices that hold all orders, the second without a column of the first."""
    finished = F.col("o_orderstatus").eqNullSafe("F")
    a = t.orders.filter(finished).select("o_orderkey", "o_totalprice", "o_orderpriority")
    b = t.orders.filter(~finished).select("o_totalprice", "o_orderkey")
    return joins.union_fill(a, b)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_keys(t):
    return joins.distinct_keys(t.lineitem, ["l_partkey", "l_suppkey"])


@query("""SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal), 6) AS balance FROM customer GROUP BY 1""")
def order_by_value(t):
    n = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), agg.total("c_acctbal").alias("balance"))
    return joins.order_by_value(rounded(n), "balance", desc=True)
