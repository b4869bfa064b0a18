"""Scalars against hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortis.functions import bins, codes, season, status


def col(df, c="v"):
    return [r[c] for r in df.collect()]


def test_transition(spark):
    df = spark.createDataFrame(
        [(p, c) for p in (1, 0, None) for c in (1, 0, None)], "p int, c int"
    ).withColumn("v", status.transition("p", "c"))
    assert col(df) == [1.0, 0.0, None] + [None] * 6


@pytest.mark.parametrize(
    ("policy", "expected"),
    [
        ("missing_is_dead", [1, 0, 0, None, None, 0]),
        ("codes_and_missing_dead", [1, 0, 0, 0, 0, 0]),
        ("codes_dead_keep_missing", [1, 0, 0, 0, 0, None]),
    ],
)
def test_policies(spark, policy, expected):
    df = spark.createDataFrame([(s,) for s in ("1", "0", "PD", "NF", "nf", None)], "s string")
    assert col(df.select(status.recode_by_policy("s", policy).alias("v"))) == expected


def test_recode_rejects_unknown(spark):
    with pytest.raises(ValueError):
        status.recode_status("s", missing="drop")


def test_tolerant_cast_and_replace(spark):
    df = spark.createDataFrame([("PD", "3", 1), ("2.5", "x", 2)], "Lvs19 string, note string, n int")
    assert col(status.cast_family(df, "Lvs"), "Lvs19") == [None, 2.5]
    out = status.replace_all(df, {"PD": "0", "x": "0"})
    assert [tuple(r) for r in out.collect()] == [("0", "3", 1), ("2.5", "0", 2)]


def test_ratio_mask_sentinel_log(spark):
    df = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0), (None, 2.0)], "a double, b double")
    assert col(df.select(status.ratio("a", "b").alias("v"))) == [0.75, None, None]
    assert col(df.select(status.mask_where("b", F.col("a") == 0).alias("v"))) == [1.0, None, 2.0]
    assert col(df.select(status.mask_where("b", F.col("a") == 0, 9.0).alias("v"))) == [1.0, 9.0, 2.0]
    assert col(status.null_if(df, ["a"], 3), "a") == [None, 0.0, None]
    assert col(df.select(status.log_of("a").alias("v")))[1:] == [None, None]


def test_keys(spark):
    df = spark.createDataFrame([("1", "E"), ("2", None)], "a string, b string")
    assert col(df.select(codes.prefix_key("a", "p").alias("v"))) == ["p1", "p2"]
    assert col(df.select(codes.composite_key(["a", "b"]).alias("v"))) == ["1_E", None]
    assert col(df.select(codes.composite_key(["a", "b"], "-", "literal").alias("v"))) == ["1-E", "2-NA"]
    with pytest.raises(ValueError):
        codes.composite_key(["a"], na="x")


def test_split_code(spark):
    df = spark.createDataFrame([("a_b_c",), ("a",), (None,), ("a.b",)], "v string")
    got = [tuple(r) for r in codes.split_code(df, "v", ["x", "y"]).collect()]
    assert got == [("a", "b"), ("a", None), (None, None), ("a.b", None)]
    dotted = codes.split_code(df, "v", ["v", "y"], ".").collect()[3]
    assert tuple(dotted) == ("a", "b")


def test_split_at(spark):
    df = spark.createDataFrame([("C10E",), ("E",), ("",), (None,)], "v string")
    assert [tuple(r) for r in codes.split_at(df, "v", ("x", "y"), -1).collect()] == [("C10", "E"), ("", "E"), ("", ""), (None, None)]
    assert [tuple(r) for r in codes.split_at(df, "v", ("x", "y"), 1).collect()] == [("C", "10E"), ("E", ""), ("", ""), (None, None)]


def test_parse_point(spark):
    df = spark.createDataFrame([("C10E_N",), ("P100W",), ("bad",)], "Point string")
    got = [tuple(r[c] for c in ("PointType", "Distance", "TransDir", "PlotDir")) for r in codes.parse_point(df, "Point").collect()]
    assert got == [("C", 10.0, "E", "N"), ("P", 100.0, "W", None), ("b", None, "d", None)]
    assert col(df.select(codes.substr("Point", 2, 2).alias("v")))[:2] == ["10", "10"]


def test_family():
    names = ["Stat20", "Stat19", "Stat98", "Status", "Stat2020", "Lvs19"]
    assert codes.family(names, "Stat") == [("Stat98", 1998), ("Stat19", 2019), ("Stat20", 2020)]


def test_bins(spark):
    df = spark.createDataFrame([("-1",), ("0",), ("19",), ("20",), ("99",), ("100",), ("120",), (None,), ("x",)], "v string")
    assert col(df.select(bins.bin_by("v").alias("v"))) == [0, 1, 1, 2, 5, 6, 6, None, None]
    assert col(df.select(bins.bin_by("v", (0, 19, 100)).alias("v"))) == [0, 1, 2, 2, 2, 3, 3, None, None]


def test_distance(spark):
    origin = (283404.12, 4868995.17)
    df = spark.createDataFrame([("E",), ("W",), (None,)], "side string")
    east = F.lit(283504.12) + bins.side_offset("side", {"E": -50, "W": 50})
    got = col(df.select(bins.distance_to(east, F.lit(4868995.17), origin).alias("v")))
    assert got == pytest.approx([50.0, 150.0, 100.0])


def test_seasons(spark):
    df = spark.createDataFrame([("2018-12-03",), ("2019-02-28",), ("2019-03-01",), ("soon",)], "d string")
    assert col(df.select(season.season_year("d").alias("v"))) == [2019, 2019, 2019, None]
    assert col(season.date_parts(df, "d"), "month") == ["12", "02", "03", None]
    df = spark.createDataFrame([("2019-2020",), ("odd",)], "interval string")
    assert [tuple(r) for r in season.split_interval(df).collect()] == [("2019-2020", 2019, 2020), ("odd", None, None)]
    assert col(df.select(season.interval_label(2010).alias("v")))[0] == "2009-2010"
    assert col(df.select(season.interval_label(F.lit(2010)).alias("v")))[0] == "2009-2010"
    d = spark.createDataFrame([(dt.date(2018, 12, 3),)], "d date")
    assert col(d.select(season.season_year("d").alias("v"))) == [2019]


def test_curve_is_finite_far_out(spark):
    df = spark.createDataFrame([(-1e6,), (2.0,), (1e6,)], "x double")
    assert col(bins.predict_logistic_curve(df, "x", 2.0, 1.0), "predicted") == [1.0, 0.5, 0.0]


def test_factor_text(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (None,)], "d double")
    assert col(status.as_factor(df, "d"), "d") == ["1", "2.5", None]
