"""Declared schemas of the field tables; codes and statuses stay text."""

from __future__ import annotations

from pyspark.sql import types as T


def _years(measure: str, first: int, last: int) -> list[str]:
    return [f"{measure}{y % 100:02d}" for y in range(last, first - 1, -1)]


def _schema(text: list[str], numbers: list[str], ints: list[str] = (), dates: list[str] = ()) -> T.StructType:
    s = T.StructType()
    for names, kind in ((text, T.StringType()), (ints, T.IntegerType()), (dates, T.DateType()), (numbers, T.DoubleType())):
        for n in names:
            s.add(n, kind, True)
    return s


# Column names of the field tables.
LITTER_SPECIES = ["ACRU", "FAGR", "BEAL", "ACSA", "ACPE", "BEPA", "FRAM", "POGR", "VIAL"]
PRISM_SPECIES = ["TSCA", "FAGR", "ACRU", "BEAL", "PIRU", "BEPA", "FRAM", "ACSA", "PIST", "ACSP", "ACPE", "POGR"]
SNOW_MEASURES = ["snow_depth", "swe", "frost_depth", "frost_pct"]

# Census sheet: counts may be dirty, so measures are text until they are cast.
CENSUS_WIDE = _schema(
    ["VW", "Point", "SdlgNum"]
    + _years("Stat", 2011, 2020)
    + _years("Lvs", 2012, 2020)
    + _years("Hgt", 2018, 2018)
    + _years("Damage", 2015, 2020)
    + _years("LiveBrch", 2018, 2020)
    + _years("DeadBrch", 2018, 2020),
    [],
    ["BirthYear"],
)
LITTER = _schema(["PlotTag", "Point"], ["Total"] + LITTER_SPECIES)
COVER_SUBSTRATE = _schema(["PlotTag", "Point"], ["CanopyCover", "ShrubCover", "Litter"])
PRISM = _schema(["PlotTag", "Point"], ["Total"] + PRISM_SPECIES)
CANOPY_PHOTOS = _schema(["Plot", "Point"], ["PerCnpyOpenTotal"])
PLOT_COORDINATES = _schema(["PlotTag"], ["UTM.Easting", "UTM.Northing"])
SNOW_COURSE = _schema(["Site"], SNOW_MEASURES, ["WINTER"], ["Date"])
AIR_TEMPERATURE = _schema(["STA"], ["MAX", "MIN", "AVE"], [], ["date"])
