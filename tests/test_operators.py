"""Reshapes, panel operators, joins and aggregates on small tables."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.functions.status import recode_family
from cohortis.operators import aggregate as agg
from cohortis.operators import filters, joins, panel, quantiles, reshape, skew

WIDE = [("a", "1", "1", "PD"), ("b", None, "1", "1"), ("c", "1", "0", "0")]


@pytest.fixture(scope="module")
def wide(spark):
    return recode_family(spark.createDataFrame(WIDE, "id string, Stat18 string, Stat19 string, Stat20 string"))


def test_intervals(wide, rows):
    iv = reshape.to_intervals(wide, ["id"], first_start="first")
    assert rows(iv, "id", "interval", "survival", "first") == [
        ("a", "2018-2019", 1.0, 2018), ("a", "2019-2020", 0.0, 2018), ("b", "2019-2020", 1.0, 2019), ("c", "2018-2019", 0.0, 2018),
    ]
    assert rows(agg.interval_survival(iv)) == [("2018-2019", 0.5, 2), ("2019-2020", 0.5, 2)]
    assert iv._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_intervals_do_not_bridge_a_missing_year(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0.0)], "id string, Stat20 double, Stat17 double, Stat18 double")
    assert rows(reshape.to_intervals(df, ["id"]), "interval", "survival") == [("2017-2018", 0.0)]


def test_unpivots(spark, rows):
    df = spark.createDataFrame([("a", "3", None, 1.0)], "id string, Lvs19 string, Lvs20 string, Damage20 double")
    assert rows(reshape.unpivot_family(df, ["id"], "Lvs", "n")) == [("a", 2019, 3.0), ("a", 2020, None)]
    assert rows(reshape.unpivot_family(df, ["id"], "Lvs", "n", "interval"))[0][1] == "2018-2019"
    assert rows(reshape.unpivot_families(df, ["id"], ["Lvs", "Damage"])) == [("a", 2019, 3.0, None), ("a", 2020, None, 1.0)]


def test_long_transitions(spark, rows):
    long = spark.createDataFrame(
        [("a", 2018, 1), ("a", 2019, 1), ("a", 2019, 0), ("a", 2021, 1), ("b", 2018, 0), ("b", 2019, 1), ("c", 2018, 1), ("c", 2019, 0)],
        "id string, y int, s int",
    )
    assert rows(panel.transitions_long(long, ["id"], "y", "s")) == [("a", 2018, 2019, 1.0), ("c", 2018, 2019, 0.0)]


AGES = [
    (2011, "true", [1, 2, 5]), (2011, "mirrored", [1, 4, 5]), (2009, "true", [3, 4, 7]), (2009, "mirrored", [3, 6, 7]), (None, "true", [1, 2, 5]),
]


@pytest.mark.parametrize(("birth", "mode", "ages"), AGES)
def test_ages(spark, rows, birth, mode, ages):
    df = spark.createDataFrame([("k", birth, y) for y in (2011, 2012, 2015)], "id string, birth int, start_int int")
    assert [r[0] for r in rows(panel.with_age(df, ["id"], gap_mode=mode).orderBy("start_int"), "yearsAlive")] == sorted(map(float, ages))


def test_ages_without_gap_agree(spark, rows):
    df = spark.createDataFrame([("k", 2011, y) for y in (2011, 2012, 2013)], "id string, birth int, start_int int")
    for mode in ("true", "mirrored"):
        assert rows(panel.with_age(df, ["id"], gap_mode=mode), "start_int", "yearsAlive") == [(2011, 1.0), (2012, 2.0), (2013, 3.0)]


DUPLICATES = [("k1", "0"), ("k1", "1"), ("k2", "0"), ("k3", "0"), ("k3", None), ("k4", "PD"), ("k4", "0"), ("k5", "0"), ("k5", "0")]


def test_dead_duplicates(spark, rows):
    df = spark.createDataFrame(DUPLICATES, "id string, s string")
    assert rows(panel.drop_dead_duplicates(df, ["id"], "s")) == [("k1", "1"), ("k2", "0"), ("k3", None), ("k4", "PD")]


def test_audit_and_tags(spark, rows):
    df = spark.createDataFrame(DUPLICATES + [(None, "1"), (None, "0")], "id string, s string")
    assert rows(panel.key_audit(df, ["id"])) == [(11, 6, 5, 5)]
    assert rows(panel.key_audit(df, ["id"], approx=True)) == [(11, 6)]
    tags = {r[0]: (r[1], r[2]) for r in rows(panel.tag_duplicates(df, ["id"]), "id", "count", "dups")}
    assert tags["k2"] == (1, False) and tags["k5"] == (2, True) and tags[None] == (2, True)


def test_group_values_of_a_hot_key(spark):
    random.seed(3)
    data = [(random.choice(["hot"] * 20 + ["a", "b", "c", None]), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v int").repartition(5)
    got = skew.with_group_values(df, ["k"], {"n": F.count(F.lit(1)), "total": F.sum("v"), "first": F.min("v")}).collect()
    groups: dict = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    expected = [(str(k), v, len(groups[k]), sum(groups[k]), min(groups[k])) for k, v in data]
    assert sorted((str(r.k), r.v, r.n, r.total, r["first"]) for r in got) == sorted(expected)


def test_unique_join_of_a_hot_key(spark):
    data = [("hot" if i % 3 else random.choice(["a", "b", None]), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, v int").repartition(4)
    dim = {"a": 1, "hot": 2, None: 3, "zz": 4}
    other = spark.createDataFrame(list(dim.items()), "k string, d int")
    for safe in (True, False):
        want = sorted((v, str(dim.get(k) if k is not None or safe else None)) for k, v in data)
        assert sorted((r.v, str(r.d)) for r in skew.split_join(df, other, ["k"], "left", safe).collect()) == want
    assert joins.semi_join(df, other, ["k"]).count() + joins.anti_join(df, other, ["k"]).count() == 200
    assert joins.anti_join(df, other, ["k"]).filter("k <> 'b'").count() == 0


def test_keys_of_different_types_meet(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([(1, "p")], "k bigint, w string")
    assert sorted((r.v, r.w) for r in skew.split_join(left, right, ["k"]).collect()) == [("x", "p"), ("y", None)]


HOT_KEY = {
    "lookup": lambda df, dim: joins.lookup(df, dim, "k", "d"),
    "grouped": lambda df, dim: joins.left_join(df, dim.groupBy("k").agg(F.sum("d").alias("d")), ["k"], unique=True),
    "fan_out": lambda df, dim: joins.fan_out_join(dim, df, ["k"]),
    "semi": lambda df, dim: joins.semi_join(df, dim, ["k"]),
    "anti": lambda df, dim: joins.anti_join(df, dim.filter("k > 50"), ["k"]),
    "tags": lambda df, dim: panel.tag_duplicates(df, ["k"]),
    "dead": lambda df, dim: panel.drop_dead_duplicates(df, ["k"], "s"),
    "age": lambda df, dim: panel.with_age(df, ["k"]),
    "mirrored": lambda df, dim: panel.with_age(df, ["k"], gap_mode="mirrored"),
}


@pytest.mark.parametrize("name", HOT_KEY)
def test_a_hot_key_is_split(spark, tmp_path, name):
    """Nine of ten rows have one key: its partition is read by several tasks, and the rows are all there."""
    folder = str(tmp_path)
    hot = F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id") % 97).cast("int")
    spark.range(0, 60_000, 1, 12).select(
        hot.alias("k"), F.lit("PD").alias("s"), F.lit(2000).alias("birth"), (F.col("id") % 9 + 2000).cast("int").alias("start_int"),
        F.sha2(F.col("id").cast("string"), 256).alias("fill"),
    ).write.parquet(f"{folder}/rows")
    spark.range(97).select(F.col("id").cast("int").alias("k"), F.col("id").alias("d")).write.parquet(f"{folder}/dim")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = HOT_KEY[name](spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/dim"))
        assert len(out.collect()) == out.count() >= 54_000
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan, plan




@pytest.fixture(scope="module")
def sides(spark):
    l = spark.createDataFrame([(None, "x"), (1, "y"), (1, "z"), (2, "w")], "k int, v string")
    r = spark.createDataFrame([(None, 10), (1, 11), (3, 13)], "k int, n int")
    return l, r


@pytest.mark.parametrize("how", [{}, {"unique": True}, {"small": True}])
def test_left_join_nulls(sides, rows, how):
    l, r = sides
    assert rows(joins.left_join(l, r, ["k"], null_safe=True, **how), "v", "n") == [("w", None), ("x", 10), ("y", 11), ("z", 11)]
    assert rows(joins.left_join(l, r, ["k"], **how), "v", "n") == [("w", None), ("x", None), ("y", 11), ("z", 11)]


def test_join_variants(sides, rows, spark):
    l, r = sides
    assert rows(joins.semi_join(l, r, ["k"]), "v") == [("x",), ("y",), ("z",)]
    assert rows(joins.semi_join(l, r, ["k"], null_safe=False), "v") == [("y",), ("z",)]
    assert rows(joins.anti_join(l, r, ["k"]), "v") == [("w",)]
    assert rows(joins.anti_join(l, r, ["k"], null_safe=False), "v") == [("w",), ("x",)]
    many = spark.createDataFrame([(1, 1.0), (1, 2.0), (9, 3.0), (None, 4.0)], "k int, p double")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert rows(joins.fan_out_join(one, many, ["k"]), "v", "p") == [("a", 1.0), ("a", 2.0), ("b", None), ("c", None)]
    clash = joins.left_join(one, one.withColumn("x", F.lit(1)), ["k"])
    assert clash.columns == ["k", "v_x", "v_y", "x"]
    with pytest.raises(ValueError):
        joins.left_join_natural(one, many.toDF("a", "b"))
    assert joins.left_join_natural(l, r).count() == 4
    stacked = joins.union_fill(l, r)
    assert stacked.columns == ["k", "v", "n"] and stacked.count() == 7
    assert joins.distinct_keys(l, ["k"]).count() == 3
    assert [x.k for x in joins.order_by_value(l.select("k"), "k", desc=True).collect()] == [2, 1, 1, None]
    assert joins.lookup(l, r.withColumn("z", F.lit(0)), "k", "n").columns == ["k", "v", "n"]


def test_rates(spark, rows):
    df = spark.createDataFrame([("p", 1, 1, 2.0), ("p", 1, 0, None), ("p", 1, None, 4.0), ("q", 0, 1, 1.0)], "g string, s int, e int, d double")
    assert rows(agg.survival_rate(df, "s", "e", ["g"], {"m": "d"})) == [("p", pytest.approx(1 / 3), 3, 1, 3.0)]
    assert rows(agg.survival_rate(df.filter("g = 'zz'"), "s", "e")) == [(None, 0, 0)]
    assert rows(agg.abundance(df, ["g"], {"n": "e"})) == [("p", 1), ("q", 1)]


def test_missing_value_modes(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0)], "g string, x double")
    got = df.groupBy("g").agg(agg.total("x").alias("s"), agg.total("x", False).alias("p"), agg.mean("x", False).alias("m"), agg.sd("x").alias("sd"))
    assert rows(got) == [("a", 1.0, None, None, None), ("b", 0.0, None, None, None), ("c", 2.0, 2.0, 2.0, None)]
    assert rows(agg.freq_missing(df, "x")) == [(False, 2), (True, 2)]
    assert rows(agg.freq(df, ["x"], na="drop")) == [(1.0, 1), (2.0, 1)]
    assert len(rows(agg.freq(df, ["x"]))) == 3


def test_composition(spark, rows):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (3.0, 0.0, 3.0), (None, 4.0, 4.0)], "A double, B double, Total double")
    cols = ["Plottotal", "Asum", "Aper", "Bsum", "Bper"]
    assert rows(agg.composition(df, [], ["A", "B"], "Total"), *cols) == [(10.0, 4.0, 0.4, 6.0, 0.6)]
    assert rows(agg.composition(df, [], ["A", "B"]), *cols) == [(10.0, 4.0, 0.4, 6.0, 0.6)]
    holed = df.withColumn("Total", F.when(F.col("A") != 3, F.col("Total")))
    assert rows(agg.composition(holed, [], ["A", "B"], "Total", False), *cols) == [(None, 4.0, None, 6.0, None)]


def test_climate_summary(spark, rows):
    df = spark.createDataFrame([(2012, x) for x in (None, 50.0, 49.0, 80.0)], "w int, f double")
    for limit in (1000, 1):
        got = agg.climate_summary(df, ["w"], {"med": "f"}, {"mean": "f"}, {"sd": "f"}, {"deep": ("f", 50)}, "n", limit)
        assert rows(got, "w", "med", "deep", "n") == [(2012, 50.0, 2, 4)]
    four = spark.createDataFrame([(x,) for x in (1.0, 2.0, 10.0, 20.0)], "x double")
    p = agg.profile(four, ["x"]).first()
    assert (p["median"], p["q1"], p["n"], p["n_missing"]) == (6.0, 1.75, 4, 0) and p["sd"] == pytest.approx(8.80814017448254)
    big = agg.profile(four, ["x"], group_rows=2).first()
    assert (big["median"], big["q1"], big["q3"], big["sd"]) == (p["median"], p["q1"], p["q3"], p["sd"])


def test_survival_rates_of_several_pairs(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, None), (0, 1, 1), (None, 1, 1)], "a int, b int, c int")
    got = {r.pair: tuple(r)[1:] for r in agg.survival_rates(df, {"ab": ("a", "b"), "bc": ("b", "c"), "none": ("c", "a")}).collect()}
    assert got == {"ab": (0.5, 2, 1), "bc": (2 / 3, 3, 2), "none": (0.0, 2, 0)}
    assert agg.survival_rates(df.where("a = 5"), {"ab": ("a", "b")}).first() == ("ab", None, 0, 0)


def test_standardize(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert [r.z for r in agg.standardize(df, "x", "z").collect()] == [-1.0, 0.0, 1.0, None]
    assert [r.z for r in agg.standardize(spark.createDataFrame([(1.0,)], "x double"), "x", "z").collect()] == [None]


@pytest.mark.parametrize("kind", ["uniform", "ties", "wide", "lognormal"])
def test_quantiles_of_large_groups(spark, kind):
    """One group holds most rows; every quantile agrees with plain interpolation."""
    rng = np.random.default_rng(7)
    draw = {
        "uniform": lambda n: rng.random(n) * 100,
        "ties": lambda n: rng.integers(0, 5, n).astype(float),
        "wide": lambda n: 10.0 ** rng.integers(-12, 12, n),
        "lognormal": lambda n: np.exp(rng.normal(0, 5, n)),
    }[kind]
    data = [("hot", float(v)) for v in draw(3001)] + [("b", float(v)) for v in draw(50)] + [("one", 4.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(6)
    probs = {"p0": 0.0, "q1": 0.25, "med": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "x", probs, group_rows=40).collect()}
    for g in ("hot", "b", "one"):
        xs = [v for k, v in data if k == g and v is not None]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12), (g, name)
    assert got["none"]["med"] is None and len(got) == 4
    everything = quantiles.quantiles(df, [], "x", probs, group_rows=40).first()
    assert everything["med"] == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.5), rel=1e-12)


def test_quantiles_with_buckets_of_two(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 2)
    df = spark.createDataFrame([(float(i * i),) for i in range(40)], "x double")
    assert quantiles.quantiles(df, [], "x", {"m": 0.5}, 5).first()["m"] == statistics.median(i * i for i in range(40))


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200])
def test_quantiles_need_few_rounds(spark, monkeypatch, scale):
    """Values over a hundred decades, of both signs or of one: two results are kept a round, and two before."""
    kept = []
    monkeypatch.setattr(quantiles, "cut", lambda df, cut=quantiles.cut: kept.append(1) or cut(df))
    rng = np.random.default_rng(3)
    xs = rng.choice([-1.0, 1.0] if scale == 1.0 else [1.0], 3000) * 10.0 ** rng.uniform(-50, 50, 3000) * scale
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = quantiles.quantiles(df, [], "x", {"q1": 0.25, "m": 0.5, "q3": 0.75}, 100).first()
    assert list(got) == pytest.approx(list(np.quantile(xs, [0.25, 0.5, 0.75])), rel=1e-9)
    assert (len(kept) - 2) / 2 <= 7


def test_quantiles_with_extreme_values(spark):
    xs = [float("-inf"), -1.7e308, -1.0, 0.0, 5e-324, 1e-323, 2.0, 1.7e308, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    probs = {f"p{i}": i / 8 for i in range(9)}
    got = quantiles.quantiles(df, [], "x", probs, 3).first()
    assert [got[n] for n in probs] == xs[:9]


@pytest.mark.parametrize("limit", [10_000, 10])
def test_box_stats(spark, limit):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 100.0]
    df = spark.createDataFrame([("a", x) for x in xs] + [("a", None), ("b", 5.0)], "g string, x double")
    got = {r.g: r for r in agg.box_stats(df, ["g"], "x", limit).collect()}
    a = got["a"]
    assert (a.n, a.q1, a["median"], a.q3, a.whisker_low, a.whisker_high, a.n_outliers) == (12, 3.5, 6.5, 9.5, 1.0, 11.0, 1)
    assert (got["b"].whisker_low, got["b"].n_outliers) == (5.0, 0)


@pytest.mark.parametrize("limit", [10_000, 2])
def test_hinges(spark, limit):
    """1, 2, 10, 20 and every other number of values up to nine, by halves that share the middle of an odd number."""
    sets = {"four": [1.0, 2.0, 10.0, 20.0], "inf": [1.0, 2.0, float("inf"), float("inf")]}
    sets |= {f"n{n}": [float(i * i) for i in range(n)] for n in range(1, 10)}
    df = spark.createDataFrame([(g, x) for g, xs in sets.items() for x in xs] + [("n3", float("nan")), ("none", None)], "g string, x double")
    got = {r.g: (r.q1, r["median"], r.q3) for r in quantiles.hinges(df, ["g"], "x", limit).collect()}
    assert got["four"] == (1.5, 6.0, 15.0) and got["inf"][2] == float("inf")
    for g, xs in sets.items():
        half = (len(xs) + 1) // 2
        assert got[g] == (statistics.median(xs[:half]), statistics.median(xs), statistics.median(xs[-half:])), g


def test_class_stats(spark, rows):
    df = spark.createDataFrame([(0, 1.0), (0, 0.0), (3, 1.0), (4, 1.0), (None, 1.0)], "c int, y double")
    assert rows(agg.pooled_class_stats(df, "c", "y", {"low": [0, 1, 2], "high": [3, 4]}), "pool", "n", "mean") == [("high", 2, 1.0), ("low", 2, 0.5)]
    assert rows(agg.class_stats(df, "c", "y"), "class", "n") == [(None, 1), (0, 2), (3, 1), (4, 1)]


def test_filters(spark, rows):
    df = spark.createDataFrame([("a", "2011-06-06"), ("a", "2011-06-05"), ("b", "2012-01-01"), ("b", "??")], "s string, d string")
    assert rows(filters.since(df, "d", "2011-06-06"), "d") == [("2011-06-06",), ("2012-01-01",)]
    assert rows(filters.since(df, "d", "2011-06-06", ("s", "b")), "d") == [("2012-01-01",)]
    assert filters.in_months(df, "d", (1,)).count() == 1
    assert filters.in_sites(df, "s", ["a"]).count() == 2


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_partitioning_does_not_matter(spark, wide, rows, parts):
    df = wide.repartition(parts)
    assert rows(agg.interval_survival(reshape.to_intervals(df, ["id"]))) == [("2018-2019", 0.5, 2), ("2019-2020", 0.5, 2)]
