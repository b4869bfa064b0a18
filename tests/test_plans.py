"""The three analyses on small CSV sheets with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from cohortis.plans import census, climate, environment
from cohortis.plans.order_panel import wide_panel
from cohortis.sources import schemas
from cohortis.sources.tables import read_table, write_table

CENSUS = """VW,Point,SdlgNum,Stat20,Stat19,Stat18,Stat17,Stat16,Stat15,Stat14,Stat13,Stat12,Stat11,Lvs20,Lvs19,Lvs18,Lvs12,Damage20,Damage19,LiveBrch20,DeadBrch20,BirthYear
354,C10E_N,1,PD,1,1,NA,NA,NA,NA,NA,NA,NA,NA,4,3,NA,NA,2,NA,NA,2018
354,C10E_N,2,1,1,NA,NA,NA,NA,NA,NA,NA,NA,6,5,NA,NA,1,0,3,1,NA
354,P100W,3,0,0,1,1,nf,1,1,NA,NA,NA,x,NA,2,NA,3,1,0,0,2014
1,C35E_S,4,NF,1,1,NA,NA,NA,NA,NA,NA,NA,NA,2,2,NA,NA,NA,NA,NA,2018
1,C35E_S,5,0,1,1,NA,NA,NA,NA,NA,NA,NA,NA,2,2,NA,NA,NA,NA,NA,2018
1,C35E_S,5,1,1,1,NA,NA,NA,NA,NA,NA,NA,9,2,2,NA,NA,NA,NA,NA,2018
"""


def _full(text, schema):
    """Sheets leave out columns nobody filled; add them as NA."""
    head, *lines = text.strip().splitlines()
    names = head.split(",")
    extra = [f.name for f in schema if f.name not in names]
    return "\n".join([",".join(names + extra), *[",".join([line] + ["NA"] * len(extra)) for line in lines]]) + "\n"


@pytest.fixture(scope="module")
def sheet(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("census") / "census.csv"
    path.write_text("﻿" + _full(CENSUS, schemas.CENSUS_WIDE), encoding="utf-8")
    return read_table(spark, str(path), schemas.CENSUS_WIDE)


def test_read_strips_the_mark_and_types(sheet):
    assert sheet.columns[0] == "VW" and dict(sheet.dtypes)["BirthYear"] == "int"
    assert sheet.filter("Stat20 = 'PD'").count() == 1 and sheet.filter("Stat17 is null").count() == 5


@pytest.mark.parametrize("unique", [False, True])
def test_interval_records(sheet, rows, unique):
    iv = census.census_intervals(sheet, unique_ids=unique)
    got = rows(iv, "seedID", "interval", "survival", "leafNumber", "seedDamage", "brchLvD", "yearsAlive")
    assert got == sorted([
        ("p1-4-E-35", "2018-2019", 1.0, 2.0, None, None, 1.0),
        ("p1-4-E-35", "2019-2020", 0.0, None, None, None, 2.0),
        ("p1-5-E-35", "2018-2019", 1.0, 2.0, None, None, 1.0),
        ("p1-5-E-35", "2019-2020", 1.0, 9.0, None, None, 2.0),
        ("p354-1-E-10", "2018-2019", 1.0, 4.0, 2.0, None, 1.0),
        ("p354-1-E-10", "2019-2020", 0.0, None, None, None, 2.0),
        ("p354-2-E-10", "2019-2020", 1.0, 6.0, 1.0, 0.75, 1.0),
        ("p354-3-W-100", "2014-2015", 1.0, None, None, None, 1.0),
        ("p354-3-W-100", "2015-2016", 0.0, None, None, None, 2.0),
        ("p354-3-W-100", "2017-2018", 1.0, 2.0, None, None, 4.0),
        ("p354-3-W-100", "2018-2019", 0.0, None, 1.0, None, 5.0),
    ], key=lambda t: [(x is not None, str(x)) for x in t])


def test_mirrored_ages(sheet, rows):
    iv = census.census_intervals(sheet, gap_mode="mirrored").filter("seedID = 'p354-3-W-100'")
    # Starts 2014, 2015, 2017, 2018: largest age 5, shrinking by 0, 1, 3, 4 from the newest.
    assert [r[1] for r in rows(iv, "start_int", "yearsAlive")] == [1.0, 2.0, 4.0, 5.0]


def test_round_trip(sheet, tmp_path, spark, rows):
    iv = census.census_intervals(sheet)
    for fmt in ("csv", "parquet"):
        write_table(iv, str(tmp_path / fmt), fmt)
    back = read_table(spark, str(tmp_path / "csv"), iv.schema, fmt="csv")
    assert rows(back) == rows(iv) == rows(read_table(spark, str(tmp_path / "parquet")))
    with pytest.raises(ValueError):
        write_table(iv, str(tmp_path / "x"), "xls")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "csv"), "nothere string", fmt="csv")


def test_year_pair_rates(sheet, rows):
    pair = census.year_pair(sheet, 2018)
    assert rows(census.survival_by(pair)) == [(0.8, 5, 4)]
    assert rows(census.survival_by(pair, ["VW"], {"leaves": "leaves", "age": "age"})) == [("p1", 1.0, 3, 3, 2.0, 1.0), ("p354", 0.5, 2, 1, 2.5, 3.0)]
    assert rows(pair.filter("SdlgNum = '2'"), "alive_start", "outcome") == [(0.0, None)]
    # Over two years: of the five alive in 2018 one is alive in 2020.
    assert rows(census.survival_by(census.year_pair(sheet, 2018, end=2020))) == [(0.2, 5, 1)]


def test_orders_outside_the_years_of_the_panel(spark):
    orders = spark.createDataFrame(
        [(1, "1995-03-01", "1-URGENT", "F"), (1, None, "1-URGENT", "O"), (2, "2001-03-01", "5-LOW", "O")],
        "o_custkey long, o_orderdate string, o_orderpriority string, o_orderstatus string",
    ).withColumn("o_orderdate", F.to_timestamp("o_orderdate"))
    assert wide_panel(orders).count() == 2
    with pytest.raises(Exception, match="outside the years of the panel: 2002"):
        wide_panel(orders.withColumn("o_orderdate", F.col("o_orderdate") + F.expr("interval 1 year"))).collect()


@pytest.fixture(scope="module")
def site(spark):
    cover = spark.createDataFrame(
        [("p354", "C10E_N", 40.0, 10.0, 1.0), ("p354", "C15E_S", 60.0, None, 3.0), ("p354", "P100W", 20.0, 5.0, 5.0), ("p9", "C5E", 1.0, 1.0, 1.0)],
        "PlotTag string, Point string, CanopyCover double, ShrubCover double, Litter double",
    )
    photos = spark.createDataFrame([("354", "C12E", 7.0), ("354", "C14E", 8.0), ("7", "C1E", 9.0)], "Plot string, Point string, PerCnpyOpenTotal double")
    coords = spark.createDataFrame([("p354", 283504.12, 4868995.17), ("p9", 283404.12, 4868995.17)], ["Site", "UTM.Easting", "UTM.Northing"])
    return cover, photos, coords


def test_environment(sheet, site, rows):
    cover, photos, coords = site
    assert rows(environment.cover_bins(cover), "PlotTransBin", "CanCover_mean", "ShrubCover_mean", "Sub_mean") == [
        ("p354_E_1", 50.0, 10.0, 2.0), ("p354_W_6", 20.0, 5.0, 5.0), ("p9_E_1", 1.0, 1.0, 1.0),
    ]
    pair = census.year_pair(sheet, 2018)
    bins = environment.survival_bins(pair)
    assert rows(bins, "PlotTransBin", "rate", "abund_start") == [("p354_E_1", 1.0, 1), ("p354_W_6", 0.0, 1)]
    both = environment.cover_with_survival(cover, bins)
    assert rows(both, "PlotTransBin", "rate") == [("p354_E_1", 1.0), ("p354_W_6", 0.0), ("p9_E_1", None)]
    points = environment.canopy_with_survival(both, photos)
    assert rows(points, "PlotTransBin", "PerCnpyOpenTotal") == [("p354_E_1", 7.0), ("p354_E_1", 8.0), ("p354_W_6", None), ("p9_E_1", None)]
    dist = environment.transects_with_distance(pair, coords)
    assert "PlotTag_x" in dist.columns and "PlotTag_y" in dist.columns
    assert rows(dist, "PlotTrans", "HQdist") == [("p1_E", None), ("p354_E", 50.0), ("p354_W", 150.0)]
    lone = environment.transect_distances(coords, pair.filter("alive_start = 1"))
    assert ("p9", None, 0.0) in rows(lone)
    short = environment.canopy_points(photos.limit(1).withColumn("Point", F.lit("P100W")), whole_distance=False)
    assert rows(short, "PlotTransBin") == [("p354_W_1",)]
    yearly = environment.yearly_cover_comparison(cover.drop("CanopyCover"), census.year_pair(sheet, 2019, "codes_and_missing_dead"))
    assert rows(yearly, "PlotTransBin", "rate") == [("p354_E_1", 0.5), ("p354_W_6", None), ("p9_E_1", None)]


def test_composition(spark, rows):
    litter = spark.createDataFrame([("p1", "C10E", 4.0, *[1.0, 3.0] + [None] * 7), ("p1", "C12E", 6.0, *[2.0] + [0.5] * 8)], schemas.LITTER)
    got = environment.litter_bins(litter).first()
    assert (got.PlotTransBin, got.Plottotal, got.ACRUsum, got.ACRUper, got.FAGRper, got.VIALsum) == ("p1_E_1", 10.0, 3.0, 0.3, 0.35, 0.5)
    prism = spark.createDataFrame([("p1", "C10E", 4.0, *[1.0] * 12), ("p1", "C12E", None, *[2.0] * 12)], schemas.PRISM)
    got = environment.prism_bins(prism).first()
    assert (got.Plottotal, got.POGRsum, got.POGRper) == (None, 3.0, None)
    assert ("TSCA", 3.0) in rows(environment.tree_abundance(prism))


def test_climate(spark, rows, sheet, tmp_path):
    snow = tmp_path / "snow.csv"
    lines = ["Site,WINTER,Date,snow_depth,swe,frost_depth,frost_pct"]
    for w, day in ((2019, "2018-12-30"), (2020, "2020-01-15")):
        for site in ("STAHQ", "STA1", "STA9"):
            for k, (s, f) in enumerate(((100, -99), (200, 50), (300 + w % 10, 49), (-99, 80))):
                lines.append(f"{site},{w},{day},{s if s < 0 else s + len(site)},1,{f},10")
    lines.append("STAHQ,2011,2010-12-01,900,1,900,10")
    snow.write_text("\n".join(lines) + "\n")
    clean = climate.clean_snow(read_table(spark, str(snow), schemas.SNOW_COURSE))
    hq = climate.snow_summary(clean)
    assert rows(hq, "WINTER", "medfrostdepth", "sumfrostdepth", "medsnowdepth", "sumsnowdepth", "n") == [
        (2019, 50.0, 2, 205.0, 2, 4), (2020, 50.0, 2, 205.0, 2, 4),
    ]
    assert rows(climate.snow_overall(hq), "medsnowdepth", "mean_n") == [(205.0, 4.0)]
    agreement = climate.site_agreement(hq, climate.snow_summary(clean, climate.WATERSHED_1), ["meansnowdepth"]).first()
    assert agreement.n == 2 and agreement.r == pytest.approx(1.0)
    joined = climate.intervals_with_climate(census.census_intervals(sheet), hq, "meansnowdepth")
    assert joined.count() == 11 and joined.filter("WINTER = 2019 and scalemeansnowdepth is null").count() == 0
    assert joined.filter("WINTER < 2019 and medsnowdepth is not null").count() == 0


def test_temperature(spark, rows):
    air = spark.createDataFrame(
        [("2018-12-31", "HQ", 0.0, -4.0, -2.0), ("2019-01-01", "HQ", 5.0, -6.0, -1.0), ("2019-03-01", "HQ", 50.0, 1.0, 2.0),
         ("2019-12-01", "HQ", None, -1.0, 0.0), ("2020-01-01", "HQ", 1.0, -1.0, 0.0), ("2019-01-01", "W1", 9.0, 9.0, 9.0)],
        "date string, STA string, MAX double, MIN double, AVE double",
    )
    got = rows(climate.winter_temperature(air), "winter", "below", "meanave", "sdmax", "meanmin")
    assert got == [(2019, 1, -1.5, pytest.approx(5 / 2**0.5), -5.0), (2020, None, 0.0, None, -1.0)]
