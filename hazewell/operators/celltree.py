"""Nearest neighbours on the globe by a tree of cells.

Stations are points of the unit sphere in a cube. A cell with more than ``CELL`` of them is halved along each axis, level by
level, so a dense city ends in many small cells and an empty sea in none. All stations look for their neighbour at once, from the
root down: a station keeps the cells that may hold it, those whose nearest corner is no farther than the farthest
corner of some cell that is sure to hold another station. Cells are few for any station, whether it lies in a crowd or far off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazewell.functions import scalars as S
from hazewell.operators.scalars_on import with_scalar
from hazewell.session import stored

#: Stations of a cell that is not split, and splits at most: cells of the last level are a few metres wide.
CELL = 32
LEVELS = 20
AXES = ("x", "y", "z")


def _cell(level) -> Column:
    """Number of the cell at a level (a number or a column)."""
    level = F.lit(level) if isinstance(level, int) else level
    side = F.pow(F.lit(2.0), level)
    at = [F.least(F.floor((F.col(a) + 1.0) / 2.0 * side), side.cast("long") - 1).cast("long") for a in AXES]
    return at[0] * F.lit(1 << 42) + at[1] * F.lit(1 << 21) + at[2]


def _nearest_corner() -> Column:
    gap = [F.greatest(F.col(f"low_{a}") - F.col(a), F.col(a) - F.col(f"high_{a}"), F.lit(0.0)) for a in AXES]
    return sum((g * g for g in gap), F.lit(0.0))


def _farthest_corner() -> Column:
    gap = [F.greatest(F.abs(F.col(a) - F.col(f"low_{a}")), F.abs(F.col(a) - F.col(f"high_{a}"))) for a in AXES]
    return sum((g * g for g in gap), F.lit(0.0))


def _cells(points: DataFrame, level: int) -> DataFrame:
    """Cells with points at a level: number, number of the cell above, count, and the box of the points."""
    above = _cell(level - 1) if level else F.lit(0).cast("long")
    return points.groupBy(_cell(level).alias("cell"), above.alias("above")).agg(
        F.count("*").alias("n"), *[f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("low", F.min), ("high", F.max))])


def nearest(stations: DataFrame, cell: int = CELL, levels: int = LEVELS) -> DataFrame:
    """station_id, km: distance to the nearest other station; one row for each station that has one.

    Stations at the same place are 0 km apart. Rows without a place or an id are left out; repeated ids are stations of their own only if
    their places differ.
    """
    lat, lon = F.radians("latitude"), F.radians("longitude")
    rows = stations.select("station_id", "latitude", "longitude").dropna().distinct()
    places = rows.groupBy("latitude", "longitude").agg(F.min("station_id").alias("station_id"), F.count("*").alias("here"))
    points = stored(places.select(F.xxhash64("latitude", "longitude").alias("p"), "latitude", "longitude", "here", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")), "places")
    found = stored(_cells(points, 0).withColumn("level", F.lit(0)), "cells")
    # who looks where; a place's own cells are told by their numbers
    look = stored(with_scalar(points, found).select("p", *AXES, "level", "cell", "n", F.lit(0.0).alias("near")), "look")  # one cell: the root
    open_ = points
    for level in range(1, levels + 1):
        split = found.filter(F.col("n") > cell).select(F.col("cell").alias("above"))
        open_ = open_.withColumn("above", _cell(level - 1)).join(split, "above", "left_semi").drop("above")
        found = stored(_cells(open_, level).withColumn("level", F.lit(level)), "cells")
        if found.isEmpty():
            break
        down = look.filter((F.col("level") == level - 1) & (F.col("n") > cell)).select("p", *AXES, F.col("cell").alias("above")).join(found, "above")
        # another place is sure to be there, unless the cell holds this one alone
        sure = F.when((F.col("n") > 1) | (F.col("cell") != _cell(level)), _farthest_corner())
        down = down.select("p", *AXES, "level", "cell", "n", _nearest_corner().alias("near"), sure.alias("far"))
        kept = look.filter((F.col("level") < level - 1) | (F.col("n") <= cell)).withColumn("far", F.lit(None).cast("double"))
        both = stored(kept.unionByName(down), "look-down")
        bound = both.groupBy("p").agg(F.min("far").alias("bound"))
        look = stored(both.join(bound, "p").filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-9) + 1e-18)).drop("far", "bound"), "look")
    # places of a leaf meet those that look into it; every place looks into its own
    home = points.join(look.select("p", "level", "cell"), "p").filter(_cell(F.col("level")) == F.col("cell")).select("level", "cell", F.col("p").alias("q"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    asks = look.select("p", "level", "cell").join(points.select("p", "latitude", "longitude"), "p")
    km = S.haversine(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    near = asks.join(home, ["level", "cell"]).filter(F.col("p") != F.col("q")).groupBy("p").agg(F.min(km).alias("km"))
    by_place = points.join(near, "p", "left").select("latitude", "longitude", F.when(F.col("here") > 1, F.lit(0.0)).otherwise(F.col("km")).alias("km"))
    return rows.join(by_place, ["latitude", "longitude"]).filter(F.col("km").isNotNull()).groupBy("station_id").agg(F.min("km").alias("km"))
