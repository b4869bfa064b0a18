"""Site covariates per distance bin, joined to survival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_by, distance_to, side_offset
from ..functions.codes import composite_key, plain_names, prefix_key, rename_first, split_at, substr
from ..operators import aggregate as agg
from ..operators.filters import in_sites
from ..operators.joins import fan_out_join, left_join
from ..sources.schemas import LITTER_SPECIES, PRISM_SPECIES
from .census import locate, survival_by

# Valley entrance in UTM metres, transect offsets, plots with site covariates.
ENTRANCE = (283404.12, 4868995.17)
SIDE_OFFSETS = {"E": -50, "W": 50}
COVARIATE_PLOTS = ("p354", "p352", "p351", "p337", "p338", "p317", "p322", "p379", "p378", "p396")

_BIN = ["PlotTag", "PlotTrans", "DistBin"]


def cover_bins(cover: DataFrame) -> DataFrame:
    """Mean canopy cover, shrub cover and substrate per bin; sheets without canopy cover go without it."""
    means = {"CanCover_mean": "CanopyCover", "ShrubCover_mean": "ShrubCover", "Sub_mean": "Litter"}
    means = {n: c for n, c in means.items() if c in cover.columns}
    return agg.mean_by(locate(cover, "PlotTag"), [*_BIN, "PlotTransBin"], means)


def litter_bins(litter: DataFrame) -> DataFrame:
    """Leaf litter composition per bin."""
    return agg.composition(locate(litter, "PlotTag"), [*_BIN, "PlotTransBin"], LITTER_SPECIES, "Total")


def prism_bins(prism: DataFrame) -> DataFrame:
    """Mature tree composition per bin; a missing total makes the bin's total and shares missing."""
    return agg.composition(locate(prism, "PlotTag"), ["PlotTransBin"], PRISM_SPECIES, "Total", na_rm_total=False)


def tree_abundance(prism: DataFrame) -> DataFrame:
    """Total abundance per species, as (Species, Abund)."""
    return agg.sum_columns(prism, PRISM_SPECIES).unpivot([], PRISM_SPECIES, "Species", "Abund")


def canopy_points(photos: DataFrame, whole_distance: bool = True) -> DataFrame:
    """Canopy openness per photo point with its bin key.

    ``whole_distance=False`` reads the distance from the second and third
    character only, which turns 100 m into 10 m.
    """
    named = photos.withColumn("Plot", prefix_key("Plot", "p"))
    if whole_distance:
        out = locate(named, "Plot")
    else:
        out = split_at(named, "Point", ("_head", "TransDir"), -1, remove=False).withColumns({
            "DistBin": bin_by(substr("Point", 2, 2)),
            "PlotPoint": composite_key(["Plot", "Point"], na="literal"),
        })
        out = out.withColumn("PlotTransBin", composite_key(["Plot", "TransDir", "DistBin"], na="literal"))
    return out.select("PlotTransBin", "PerCnpyOpenTotal", "PlotPoint")


def transect_distances(coordinates: DataFrame, transects: DataFrame) -> DataFrame:
    """Distance of every transect (or plot without transects) to the valley entrance.

    ``transects`` holds distinct ``TransDir``, ``PlotTag``, ``PlotTrans``.
    """
    plots = plain_names(rename_first(coordinates, "PlotTag"))
    sides = transects.select("TransDir", "PlotTag", "PlotTrans").distinct()
    both = fan_out_join(plots, sides, ["PlotTag"])
    east = F.col("UTM_Easting") + side_offset("TransDir", SIDE_OFFSETS)
    return both.select("PlotTag", "PlotTrans", distance_to(east, "UTM_Northing", ENTRANCE).alias("HQdist"))


def survival_bins(pair: DataFrame, covariate_plots_only: bool = True) -> DataFrame:
    """Survival per distance bin of a year pair."""
    rows = in_sites(pair, "VW", COVARIATE_PLOTS) if covariate_plots_only else pair
    return survival_by(rows, ["PlotTrans", "DistBin", "PlotTransBin"])


def cover_with_survival(cover: DataFrame, survival: DataFrame) -> DataFrame:
    """Bin covariates with the bin's survival; both have one row per bin."""
    return left_join(cover_bins(cover), survival.drop("PlotTrans", "DistBin"), ["PlotTransBin"])


def canopy_with_survival(cover_survival: DataFrame, photos: DataFrame) -> DataFrame:
    """Every photo point of a bin beside the bin's covariates and survival."""
    return fan_out_join(cover_survival, canopy_points(photos), ["PlotTransBin"])


def transects_with_distance(pair: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Survival per transect with its distance; the plot of both sides is kept (``_x``, ``_y``)."""
    rates = survival_by(pair, ["PlotTag", "PlotTrans", "TransDir"])
    distances = transect_distances(coordinates, pair.filter(F.col("alive_start") == 1))
    return left_join(rates, distances, ["PlotTrans"])


def yearly_cover_comparison(cover: DataFrame, pair: DataFrame) -> DataFrame:
    """Shrub cover of one summer beside all plots' bin survival over one interval."""
    shrub = agg.mean_by(locate(cover, "PlotTag"), [*_BIN, "PlotTransBin"], {"ShrubCover_mean": "ShrubCover"})
    return left_join(shrub, survival_bins(pair, False).drop("PlotTrans", "DistBin"), ["PlotTransBin"])
