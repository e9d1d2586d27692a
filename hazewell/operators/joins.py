"""Joins on hours, nearest times, ranges and places."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazewell.functions import scalars as S
from hazewell.sources import landing

TIME = "datetime_utc"


#: A little less than a degree of latitude has.
KM_PER_DEGREE = 111.0


def join_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on the rounded hour; no hint, so a small weather table is broadcast by its measured size."""
    r = readings.withColumn("hour", S.round_hour(F.col(TIME)))
    w = weather.withColumn("hour", S.round_hour(F.col(TIME))).drop(TIME)
    return r.join(w, "hour", "left").drop("hour")


def join_rain(df: DataFrame, rain: DataFrame, suffix: str = "_rain") -> DataFrame:
    """Left join to rain; columns of the same name get a suffix."""
    renamed = rain.select(*[F.col(c).alias(c + suffix if c in df.columns and c != TIME else c) for c in rain.columns])
    return df.join(renamed, TIME, "left")


def asof_nearest(a: DataFrame, b: DataFrame, tolerance: int, value: str, keys: Sequence[str] = (), time: str = TIME) -> DataFrame:
    """Value of b nearest in time to each row of a within the tolerance (seconds); the earlier on a tie.

    Both sides are cut into time buckets and b is copied to the buckets its tolerance reaches, so rows are
    ordered per bucket and never matched pairwise.
    """
    width = max(tolerance, 3600) * 1_000_000
    tol = tolerance * 1_000_000
    at = F.unix_micros(time)
    left = a.select("*", at.alias("_t"), F.floor(at / width).alias("_bucket"), F.lit(1).alias("_side"))
    right = b.select(
        *keys, at.alias("_t"), F.explode(F.sequence(F.floor((at - tol) / width), F.floor((at + tol) / width))).alias("_bucket"),
        F.lit(0).alias("_side"), F.struct(at.alias("t"), F.col(value).alias("v")).alias("_b"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side")
    prev = F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_t"), F.desc("_side"))  # a frame that grows; one that shrinks is read anew for each row
    nxt = F.last("_b", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"_p": prev, "_n": nxt}).filter(F.col("_side") == 1)
    dp = F.when(F.col("_t") - F.col("_p.t") <= tol, F.col("_t") - F.col("_p.t"))
    dn = F.when(F.col("_n.t") - F.col("_t") <= tol, F.col("_n.t") - F.col("_t"))
    pick = F.when(dp.isNotNull() & (dn.isNull() | (dp <= dn)), F.col("_p")).when(dn.isNotNull(), F.col("_n"))
    return near.select(*a.columns, pick["v"].alias(f"{value}_near"), ((pick["t"] - F.col("_t")) / 1_000_000).alias("offset_seconds"))


def lookback(points: DataFrame, history: DataFrame, seconds, col: str = "pm25", window: int = 10_800) -> DataFrame:
    """For each (station, time) point: the value nearest to time - seconds (earlier on a tie), and the mean of the
    values within the window around it.  ``seconds`` is a number or a column of ``points``.
    """
    back = F.lit(seconds) if isinstance(seconds, int) else seconds
    at = F.unix_timestamp(TIME)
    q = points.select(*points.columns, (at - back).alias("_t"), F.lit(1).alias("_side"))
    h = history.select("station_id", at.alias("_t"), F.lit(0).alias("_side"), F.struct(at.alias("t"), F.col(col).alias("v")).alias("_h"))
    both = q.unionByName(h, allowMissingColumns=True)
    w = Window.partitionBy("station_id").orderBy("_t", "_side")
    back = Window.partitionBy("station_id").orderBy(F.desc("_t"), F.desc("_side"))
    near = Window.partitionBy("station_id").orderBy("_t").rangeBetween(-window, window)
    marked = both.withColumns({
        "_p": F.last("_h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.last("_h", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        "near_mean": F.avg(F.col("_h.v")).over(near),
    }).filter(F.col("_side") == 1)
    take_prev = F.col("_p").isNotNull() & (F.col("_n").isNull() | (F.col("_t") - F.col("_p.t") <= F.col("_n.t") - F.col("_t")))
    best = F.when(take_prev, F.col("_p")).otherwise(F.col("_n"))
    return marked.select(*points.columns, best["v"].alias("nearest"), F.timestamp_seconds(best["t"]).alias("nearest_ts"), "near_mean")


def weighted_by_time(readings: DataFrame, stations: DataFrame, by: Sequence[str] = ("country",), default: float = 0.0) -> DataFrame:
    """Weighted mean over stations per time and group; the default where no weight is positive."""
    j = readings.join(stations.select("station_id", *by, "weight"), "station_id")
    ok = F.col("weight") > 0
    total = F.sum(F.when(ok, F.col("weight")))
    mean = F.when(total > 0, F.sum(F.when(ok, F.col("pm25") * F.col("weight"))) / total).otherwise(default)
    return j.groupBy(*by, TIME).agg(mean.alias("weighted"))


def transport_join(target: DataFrame, source: DataFrame, lag_hours: int, value: str = "weighted") -> DataFrame:
    """Source value a fixed number of hours earlier, 0 where there is none."""
    shifted = source.select((F.col(TIME) + F.expr(f"INTERVAL {lag_hours} HOURS")).alias(TIME), F.col(value).alias("transport"))
    return target.join(shifted, TIME, "left").fillna(0.0, ["transport"])


def external_stats(target: DataFrame, external: DataFrame) -> DataFrame:
    """Mean, deviation, greatest and least external value of the hour; aggregated first, so rows do not fan out."""
    s = external.groupBy(TIME).agg(
        F.avg("pm25").alias("ext_mean"), F.stddev_samp("pm25").alias("ext_std"), F.max("pm25").alias("ext_max"), F.min("pm25").alias("ext_min")
    )
    return target.join(s, TIME, "left")


def future_hours(df: DataFrame, start_shift: int, hours: int) -> DataFrame:
    """Hours following each station's latest row (shifted by ``start_shift`` hours)."""
    last = df.groupBy("station_id").agg(F.max(TIME).alias("_last"))
    seq = F.sequence(F.lit(1), F.lit(hours))
    return last.select("station_id", "_last", F.explode(seq).alias("step")).select(
        "station_id", "step", F.timestamp_seconds(F.unix_timestamp("_last") + (F.col("step") + start_shift) * 3600).alias(TIME)
    )


def align_future(hours: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of future hours with fixed defaults (2.0 m/s, 20 degrees, 500 m) where it is missing."""
    w = weather.select(TIME, "wind_speed", "t2m_celsius", "blh")
    return hours.join(w, TIME, "left").fillna({"wind_speed": 2.0, "t2m_celsius": 20.0, "blh": 500.0})


def missing_hours(df: DataFrame) -> DataFrame:
    """Hours of the common span without a row, per station.

    Read off the distance between neighbouring rows, so only the missing hours are listed, never the whole grid.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    edges = landing.span_of(df).select(F.array(F.col("start") - hour, F.col("end") + hour).alias("_e"))
    outer = df.select("station_id").distinct().crossJoin(F.broadcast(edges)).select("station_id", F.explode("_e").alias(TIME))
    prev = F.lag(TIME).over(Window.partitionBy("station_id").orderBy(TIME))
    steps = df.select("station_id", TIME).unionByName(outer).withColumn("_prev", prev).filter(F.unix_timestamp(TIME) - F.unix_timestamp("_prev") > 3600)
    return steps.select("station_id", F.explode(F.sequence(F.col("_prev") + hour, F.col(TIME) - hour, hour)).alias("slot"))


def semi_stations(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("station_id"), "station_id", "left_semi")


def _reach(lat, km: float):
    """Degrees of longitude within which all points at most ``km`` from a point of this latitude lie: 180 where that takes in a pole."""
    deg = km / KM_PER_DEGREE
    far = F.degrees(F.asin(F.lit(math.sin(math.radians(min(deg, 90.0)))) / F.cos(F.radians(lat)))) * 1.0001
    return F.when(F.abs(lat) + deg >= 89.9, F.lit(180.0)).otherwise(F.least(far, F.lit(180.0)))


def _band(lat, km: float):
    return F.floor((lat + 90) / (km / KM_PER_DEGREE)).cast("int")


def _slices(band, km: float):
    """Cells of a latitude band: the circle in equal parts, none narrower than the reach at the band's edge nearest to a pole."""
    deg = km / KM_PER_DEGREE
    edge = F.greatest(F.abs(band * deg - 90), F.abs((band + 1) * deg - 90))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / _reach(F.least(edge, F.lit(90.0)), km))).cast("int")


def cell_of(lat, lon, km: float):
    """The cell of a point on a grid for neighbours within ``km``, anywhere on the globe."""
    band = _band(lat, km)
    n = _slices(band, km)
    return F.struct(band.alias("band"), F.pmod(F.floor((lon + 180) / 360 * n).cast("int"), n).alias("slice"))


def cells_around(lat, lon, km: float):
    """All cells that points within ``km`` of a point can lie in: three bands, round the date line and over the poles."""
    reach, own = _reach(lat, km), _band(lat, km)

    def of(step: int):
        band = own + step
        n = _slices(band, km)
        first, last = F.floor((lon - reach + 180) / 360 * n).cast("int"), F.floor((lon + reach + 180) / 360 * n).cast("int")
        return F.transform(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda i: F.pmod(i, n))), lambda i: F.struct(band.alias("band"), i.alias("slice")))

    return F.flatten(F.array(*[of(step) for step in (-1, 0, 1)]))


def station_pairs(stations: DataFrame, km: float) -> DataFrame:
    """Pairs of stations at most ``km`` apart, found through cells of that size.

    Only stations of touching cells meet, so work follows the number of near pairs, not of all pairs.
    """
    s = stations.select("station_id", "latitude", "longitude")
    lat, lon = F.col("latitude"), F.col("longitude")
    left = s.select(F.col("station_id").alias("a_id"), lat.alias("a_lat"), lon.alias("a_lon"), F.explode(cells_around(lat, lon, km)).alias("_cell"))
    right = s.select(F.col("station_id").alias("b_id"), lat.alias("b_lat"), lon.alias("b_lon"), cell_of(lat, lon, km).alias("_cell"))
    dist = S.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return left.join(right, "_cell").filter(F.col("a_id") < F.col("b_id")).select("a_id", "b_id", dist.alias("km")).filter(F.col("km") <= km)


def within_radius(stations: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Stations within a radius, nearest first; a bounding box, in two parts at the date line, reaches the scan before the exact distance."""
    deg = km / KM_PER_DEGREE
    whole = abs(lat) + deg >= 89.9
    reach = 180.0 if whole else min(180.0, 1.0001 * math.degrees(math.asin(min(1.0, math.sin(math.radians(min(deg, 90.0))) / math.cos(math.radians(lat))))))
    box = F.col("latitude").between(lat - deg, lat + deg)
    if reach < 180.0:
        x = F.col("longitude")
        west, east = lon - reach, lon + reach
        inside = x.between(west, east)
        inside = inside | (x >= west + 360) if west < -180 else inside
        box &= inside | (x <= east - 360) if east > 180 else inside
    d = S.haversine(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return stations.filter(box).withColumn("km", d).filter(F.col("km") <= km).orderBy("km", "station_id")


def join_actuals(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts with the value measured at their target time."""
    act = actuals.select("station_id", F.col(TIME).alias("target_ts"), F.col("pm25").alias("actual"))
    return forecasts.join(act, ["station_id", "target_ts"])
