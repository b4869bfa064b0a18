"""Winter climate per season, beside survival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.season import WINTER_MONTHS, date_parts, season_year, with_end_year
from ..functions.status import null_if
from ..operators import aggregate as agg
from ..operators.filters import in_months, in_sites, since
from ..operators.joins import join_climate, pair_on
from ..sources.schemas import SNOW_MEASURES
from ..stats.linear import corr_tests

# Sentinel, first day of the study, thresholds in millimetres, station groups.
MISSING = -99
FIRST_DAY = "2011-06-06"
FROST_DAYS_FROM, SNOW_DAYS_FROM = 50, 200
HEADQUARTERS = ("STAHQ",)
WATERSHED_1 = ("STA1", "STA2", "STA3")
WATERSHED_6 = ("STA9", "STA10", "STA11")


def clean_snow(snow: DataFrame) -> DataFrame:
    return null_if(snow, SNOW_MEASURES, MISSING)


def snow_summary(snow: DataFrame, sites: tuple[str, ...] = HEADQUARTERS) -> DataFrame:
    """Per winter: median depths, mean and sd of snow, days of deep frost and deep snow."""
    here = since(in_sites(snow, "Site", sites), "Date", FIRST_DAY)
    return agg.climate_summary(
        here,
        ["WINTER"],
        medians={"medfrostdepth": "frost_depth", "medsnowdepth": "snow_depth", "medfrostpct": "frost_pct"},
        means={"meansnowdepth": "snow_depth"},
        sds={"sdsnowdepth": "snow_depth"},
        at_least={"sumfrostdepth": ("frost_depth", FROST_DAYS_FROM), "sumsnowdepth": ("snow_depth", SNOW_DAYS_FROM)},
        count="n",
    )


def snow_overall(summary: DataFrame) -> DataFrame:
    """Medians across winters and the mean number of collection dates."""
    return agg.summary_of_summaries(
        summary,
        {
            "medfrostdepth": "medfrostdepth",
            "medsumfrostdepth": "sumfrostdepth",
            "medsumsnowdepth": "sumsnowdepth",
            "medsnowdepth": "medsnowdepth",
        },
        {"mean_n": "n"},
    )


def site_agreement(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation tests of two sites' winter summaries, paired by winter."""
    both = pair_on(a.select("WINTER", *cols), b.select("WINTER", *cols), "WINTER")
    return corr_tests(both, [(f"{c}_x", f"{c}_y") for c in cols])


def winter_temperature(air: DataFrame, station: str = "HQ") -> DataFrame:
    """Per winter: days that stay at or below freezing, mean and sd of daily average, minimum, maximum."""
    cold = in_months(date_parts(air, "date"), "date", WINTER_MONTHS).withColumn("winter", season_year("date"))
    return agg.temperature_summary(
        cold.filter(F.col("STA") == station), ["winter"], ("MAX", 0), {"ave": "AVE", "min": "MIN", "max": "MAX"}
    )


def intervals_with_climate(intervals: DataFrame, summary: DataFrame, scale: str = "medsnowdepth") -> DataFrame:
    """Interval records with the winter they end in, and one climate column standardised over all records."""
    joined = join_climate(with_end_year(intervals), summary)
    return agg.standardize(joined, scale, f"scale{scale}")
