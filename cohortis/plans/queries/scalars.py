"""Codes, keys, casts, bins, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import bins, codes, season, status
from ...operators.aggregate import freq
from ...session import scratch
from ...sources.tables import read_table, write_table
from . import as_long, query, rounded

_RAW = """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus = 'O' THEN NULL
  WHEN o_orderpriority = '5-LOW' THEN 'NF' WHEN o_orderpriority = '1-URGENT' THEN 'nf'
  WHEN o_orderpriority = '3-MEDIUM' THEN '0' ELSE 'PD' END AS raw FROM orders)
"""


def _raw(t):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    raw = (
        F.when(s == "F", "1")
        .when(s == "O", F.lit(None).cast("string"))
        .when(p == "5-LOW", "NF")
        .when(p == "1-URGENT", "nf")
        .when(p == "3-MEDIUM", "0")
        .otherwise("PD")
    )
    return t.orders.select("o_orderkey", raw.alias("raw"))


def _recoded(t, policy):
    return _raw(t).withColumn("status", status.recode_by_policy("raw", policy))


@query(_RAW + """SELECT o_orderkey, raw, CASE WHEN raw IS NULL OR raw = 'PD' THEN 0.0::DOUBLE ELSE TRY_CAST(raw AS DOUBLE) END AS status FROM r""")
def status_recode_missing_is_dead(t):
    return _recoded(t, "missing_is_dead")


@query(_RAW + """SELECT o_orderkey, raw, CASE WHEN raw = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status FROM r""")
def status_recode_codes_and_missing_dead(t):
    return _recoded(t, "codes_and_missing_dead")


@query(_RAW + """SELECT o_orderkey, raw, CASE WHEN raw IN ('PD', 'NF', 'nf') THEN 0.0::DOUBLE ELSE TRY_CAST(raw AS DOUBLE) END AS status FROM r""")
def status_recode_codes_dead_keep_missing(t):
    return _recoded(t, "codes_dead_keep_missing")


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '0' WHEN 'O' THEN '1' ELSE o_orderstatus END AS o_orderstatus,
    CASE o_orderpriority WHEN '5-LOW' THEN '0' ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM orders"""
)
def replace_all_codes(t):
    cols = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return status.replace_all(cols, {"P": "0", "O": "1", "5-LOW": "0"})


@query(
    """SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS "Lvs01",
    TRY_CAST(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS "Lvs02" FROM orders"""
)
def tolerant_cast(t):
    raw = codes.split_code(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["Lvs01", "Lvs02"], "-")
    return status.cast_family(raw, "Lvs")


@query(
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS word,
    CAST(NULL AS VARCHAR) AS rest FROM orders"""
)
def split_code(t):
    return codes.split_code(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["level", "word", "rest"], "-")


@query(
    """SELECT p_partkey, substr(p_brand, 1, length(p_brand) - 1) AS head, right(p_brand, 1) AS tail,
    left(p_brand, 5) AS brand, substr(p_brand, 6) AS number FROM part"""
)
def split_position(t):
    out = codes.split_at(t.part.select("p_partkey", "p_brand"), "p_brand", ("head", "tail"), -1, remove=False)
    return codes.split_at(out, "p_brand", ("brand", "number"), 5)


@query(
    """WITH c AS (SELECT 'C' || CAST(l_linenumber * 10 AS VARCHAR) || l_returnflag ||
      CASE WHEN l_linestatus = 'O' THEN '' ELSE '_' || l_linestatus END AS point,
      l_linenumber * 10.0::DOUBLE AS dist, l_returnflag AS side, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS dir
      FROM lineitem)
    SELECT point, 'C' AS "PointType", dist AS "Distance", side AS "TransDir", dir AS "PlotDir", count(*)::BIGINT AS n
    FROM c GROUP BY ALL"""
)
def parse_point(t):
    tail = F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("_"), F.col("l_linestatus")))
    code = F.concat(F.lit("C"), (F.col("l_linenumber") * 10).cast("string"), F.col("l_returnflag"), tail)
    points = codes.parse_point(t.lineitem.select(code.alias("point")), "point")
    return freq(points, ["point", "PointType", "Distance", "TransDir", "PlotDir"])


@query(
    """SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS level, substr(o_orderpriority, 3, 3) AS word FROM orders"""
)
def fixed_substring(t):
    return t.orders.select(
        "o_orderkey", codes.substr("o_orderpriority", 1, 1).alias("level"), codes.substr("o_orderpriority", 3, 3).alias("word")
    )


@query(
    """WITH k AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS s
    FROM orders) SELECT o_orderkey, 'p' || c AS plot, 'p' || c || '_' || s AS key_null, 'p' || c || '_' || coalesce(s, 'NA') AS key_text FROM k"""
)
def composite_key(t):
    s = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    keyed = t.orders.select("o_orderkey", codes.prefix_key("o_custkey", "p").alias("plot"), s.alias("s"))
    return keyed.select(
        "o_orderkey",
        "plot",
        codes.composite_key(["plot", "s"]).alias("key_null"),
        codes.composite_key(["plot", "s"], na="literal").alias("key_text"),
    )


@query(
    """SELECT l_returnflag, count(*)::BIGINT AS n, count(NULLIF(l_discount, 0))::BIGINT AS n_known,
    round(avg(NULLIF(l_discount, 0)), 6) AS mean_discount, round(avg(NULLIF(l_tax, 0)), 6) AS mean_tax FROM lineitem GROUP BY 1"""
)
def sentinel_null(t):
    clean = status.null_if(t.lineitem.select("l_returnflag", "l_discount", "l_tax"), ["l_discount", "l_tax"], 0.0)
    return rounded(
        clean.groupBy("l_returnflag").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("l_discount").alias("n_known"),
            F.avg("l_discount").alias("mean_discount"),
            F.avg("l_tax").alias("mean_tax"),
        )
    )


@query(
    """SELECT CAST(CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 6 ELSE floor(l_quantity / 10) + 1 END AS INTEGER) AS bin,
    CAST((l_quantity >= 5)::INT + (l_quantity >= 20)::INT + (l_quantity >= 45)::INT AS INTEGER) AS uneven,
    count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2"""
)
def bin_counts(t):
    b = t.lineitem.select(
        bins.bin_by("l_quantity", (0, 10, 20, 30, 40, 50)).alias("bin"), bins.bin_by("l_quantity", (5, 20, 45)).alias("uneven")
    )
    return freq(b, ["bin", "uneven"])


@query(
    """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN -50.0::DOUBLE WHEN 'LARGE' THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS adj,
    round(sqrt(power(p_size + CASE p_type WHEN 'SMALL' THEN -50 WHEN 'LARGE' THEN 50 ELSE 0 END - 25.5::DOUBLE, 2)
      + power(p_retailprice - 950.25::DOUBLE, 2)), 6) AS dist FROM part"""
)
def distance_to_origin(t):
    adj = t.part.withColumn("adj", bins.side_offset("p_type", {"SMALL": -50, "LARGE": 50}))
    dist = bins.distance_to(F.col("p_size") + F.col("adj"), "p_retailprice", (25.5, 950.25))
    return rounded(adj.select("p_partkey", "adj", dist.alias("dist")))


@query(
    """SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS log_bal FROM customer"""
)
def log_covariate(t):
    return rounded(t.customer.select("c_custkey", "c_acctbal", status.log_of("c_acctbal").alias("log_bal")))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
    CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS INTEGER) AS winter,
    CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS interval,
    (2001 - year(o_orderdate) + 1)::BIGINT AS age FROM orders"""
)
def date_parts(t):
    d = season.date_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")
    out = d.select(
        "o_orderkey",
        "month",
        "year",
        season.season_year("o_orderdate").alias("winter"),
        season.interval_label(F.col("year")).alias("interval"),
        status.age_in("year", 2001).alias("age"),
    )
    return as_long(out, "age")


@query(
    """SELECT c_custkey, round(1 / (1 + exp(-0.001::DOUBLE * (c_acctbal - 4500))), 6) AS predicted FROM customer"""
)
def predicted_curve(t):
    return rounded(
        bins.predict_logistic_curve(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 4500, -0.001).drop("c_acctbal")
    )


@query(_RAW + """SELECT o_orderkey AS id, raw AS Stat95, o_totalprice AS Hgt95, CAST(o_orderdate AS DATE) AS day FROM r JOIN orders USING (o_orderkey)""")
def delimited_round_trip(t):
    """Written as delimited text with missing cells as NA, read back with a schema, columns renamed."""
    orders = t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate")).join(_raw(t), "o_orderkey")
    path = scratch(orders.sparkSession) + ".csv"
    write_table(orders, path, "csv")
    read = read_table(orders.sparkSession, path, "o_orderkey bigint, raw string, o_totalprice double, o_orderdate date")
    return codes.rename_first(read, "id").withColumnsRenamed({"raw": "Stat95", "o_totalprice": "Hgt95", "o_orderdate": "day"})


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders""")
def partitioned_round_trip(t):
    """Written as Parquet in a folder per status, read back whole."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    path = scratch(orders.sparkSession)
    write_table(orders, path, partition_by=["o_orderstatus"])
    return read_table(orders.sparkSession, path, orders.schema)


@query("""SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def factor_levels(t):
    """Whole numbers as categories."""
    levels = status.as_factor(t.lineitem.select(F.col("l_quantity").cast("double").alias("quantity")), "quantity")
    return levels.groupBy("quantity").agg(F.count(F.lit(1)).alias("n"))
