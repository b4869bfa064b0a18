"""From a raw census sheet to aged interval records and survival rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import TRANSECT_BREAKS, bin_by
from ..functions.codes import composite_key, family, parse_point, prefix_key
from ..functions.status import age_in, mask_where, ratio, recode_by_policy, to_num
from ..operators import aggregate as agg
from ..operators.panel import age_from_start, drop_dead_duplicates, with_age
from ..operators.reshape import family_measure, to_intervals

# Fixed value: leaves were first counted in 2012, so no count belongs to the interval before.
FIRST_LEAF_YEAR = 2013


def locate(df: DataFrame, plot: str, point: str = "Point") -> DataFrame:
    """Add transect, distance bin and their keys to a table keyed by plot and point code."""
    out = parse_point(df, point, "string").withColumn("PlotPoint", composite_key([plot, point], na="literal"))
    out = out.withColumns({
        "DistBin": bin_by("Distance", TRANSECT_BREAKS),
        "PlotTrans": composite_key([plot, "TransDir"], na="literal"),
    })
    return out.withColumn("PlotTransBin", composite_key(["PlotTrans", "DistBin"], na="literal"))


def clean_census(sheet: DataFrame) -> DataFrame:
    """Prefixed plots, parsed points, one id per individual."""
    named = sheet.withColumn("VW", prefix_key("VW", "p"))
    located = locate(named, "VW").withColumn("PlotTag", F.col("VW"))
    return located.withColumn("seedID", composite_key(["VW", "SdlgNum", "TransDir", "Distance"], "-", na="literal"))


def census_measures(panel: DataFrame) -> dict[str, dict[int, Column]]:
    """Leaf number, height, damage and live-branch share by the year an interval ends in."""
    live, dead = ({y: c for c, y in family(panel, m)} for m in ("LiveBrch", "DeadBrch"))
    return {
        "leafNumber": {y: c for y, c in family_measure(panel, "Lvs").items() if y >= FIRST_LEAF_YEAR},
        "seedHeight": family_measure(panel, "Hgt"),
        "seedDamage": family_measure(panel, "Damage"),
        "brchLvD": {y: ratio(to_num(live[y]), to_num(dead[y])) for y in live if y in dead},
    }


def census_intervals(
    sheet: DataFrame, policy: str = "codes_dead_keep_missing", gap_mode: str = "true", unique_ids: bool = False
) -> DataFrame:
    """Aged interval records of a census sheet.

    Duplicates that are dead in the last census go first, on raw codes; then
    codes are recoded, years paired, measures attached and ages assigned.
    ``unique_ids`` says that no duplicate is left after that, which lets the ages
    come out of the reshaping pass without a shuffle.
    """
    census = clean_census(sheet)
    last = max(family(census, "Stat"), key=lambda p: p[1])[0]
    kept = drop_dead_duplicates(census, ["seedID"], last)
    recoded = kept.withColumns({c: recode_by_policy(c, policy) for c, _ in family(kept, "Stat")})
    narrow = unique_ids and gap_mode == "true"
    long = to_intervals(
        recoded, ["seedID"], "Stat", census_measures(recoded), keep=["BirthYear"],
        first_start="_first" if narrow else None,
    )
    if narrow:
        age = age_from_start(F.col("BirthYear"), F.col("start_int"), F.col("_first")).cast("double")
        return long.withColumn("yearsAlive", age).drop("BirthYear", "_first")
    return with_age(long, ["seedID"], "BirthYear", "start_int", gap_mode).drop("BirthYear")


def year_pair(sheet: DataFrame, start: int, policy: str = "missing_is_dead", end: int | None = None) -> DataFrame:
    """The census with ``alive_start``, ``alive_end``, the outcome of survivors-to-be, and ages.

    The pair ends in ``end``, by default the year after ``start``. ``outcome`` is missing for individuals not alive at
    the start.
    """
    census = clean_census(sheet)
    a, b = f"{start % 100:02d}", f"{(start + 1 if end is None else end) % 100:02d}"
    both = census.withColumns({
        "alive_start": recode_by_policy(f"Stat{a}", policy),
        "alive_end": recode_by_policy(f"Stat{b}", policy),
        "age": age_in("BirthYear", start).cast("double"),
        "leaves": to_num(f"Lvs{a}"),
        "height": to_num(f"Hgt{a}") if f"Hgt{a}" in census.columns else F.lit(None).cast("double"),
        "damage": to_num(f"Damage{a}") if f"Damage{a}" in census.columns else F.lit(None).cast("double"),
    })
    return both.withColumn("outcome", mask_where("alive_end", F.col("alive_start") == 0))


def survival_by(pair: DataFrame, by: list[str] = (), means: dict[str, str] | None = None) -> DataFrame:
    """Rates over a :func:`year_pair` table: overall, per bin, transect, plot or class."""
    return agg.survival_rate(pair, "alive_start", "alive_end", list(by), means)

