"""Nested JSON and gridded sources, calendars and refresh decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCATION_DDL = (
    "id BIGINT, name STRING, country STRUCT<name: STRING>, coordinates STRUCT<latitude: DOUBLE, longitude: DOUBLE>, "
    "isMobile BOOLEAN, sensors ARRAY<STRUCT<id: BIGINT, name: STRING, parameter: STRUCT<name: STRING, units: STRING>>>"
)
MEASUREMENT_DDL = (
    "value DOUBLE, parameter STRING, unit STRING, sensor BIGINT, datetime STRING, "
    "coordinates STRUCT<latitude: DOUBLE, longitude: DOUBLE>, quality STRING"
)


def parse_locations(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("doc", LOCATION_DDL).alias("l")).select("l.*")


def flatten_sensors(docs: DataFrame) -> DataFrame:
    """One row per sensor with the fields of its location."""
    return parse_locations(docs).select(
        F.col("id").alias("location_id"),
        F.col("country.name").alias("country"),
        "coordinates.latitude",
        "coordinates.longitude",
        F.col("isMobile").alias("is_mobile"),
        F.explode("sensors").alias("s"),
    ).select(
        "location_id", "country", "latitude", "longitude", "is_mobile", F.col("s.id").alias("sensor_id"),
        F.col("s.parameter.name").alias("parameter"), F.col("s.parameter.units").alias("unit"),
    )


def flatten_measurements(docs: DataFrame) -> DataFrame:
    """Raw measurement JSON to typed rows with defaults."""
    m = docs.select(F.from_json("doc", MEASUREMENT_DDL).alias("m")).select("m.*")
    return m.select(
        F.col("sensor").alias("sensor_id"), "parameter", "value", F.coalesce("unit", F.lit("ug/m3")).alias("unit"),
        F.to_timestamp("datetime").alias("datetime_utc"), "coordinates.latitude", "coordinates.longitude",
        F.coalesce("quality", F.lit("valid")).alias("quality_flag"),
    )


def measurement_docs(raw: DataFrame) -> DataFrame:
    """Measurements as JSON texts; the default quality is left out of the text."""
    return raw.select(F.to_json(F.struct(
        "value", "parameter", "unit", F.col("sensor_id").alias("sensor"),
        F.date_format("datetime_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
        F.struct("latitude", "longitude").alias("coordinates"),
        F.when(F.col("quality_flag") != "valid", F.col("quality_flag")).alias("quality"),
    )).alias("doc"))


def enrich_measurements(m: DataFrame, sensors: DataFrame) -> DataFrame:
    """Copy sensor fields to each measurement; the optimizer broadcasts the register while it is small."""
    return m.join(sensors, "sensor_id", "left")


def _in_box(box):
    south, north, west, east = box
    return F.col("latitude").between(south, north) & F.col("longitude").between(west, east)


def grid_bbox_mean(grid: DataFrame, box) -> DataFrame:
    return grid.filter(_in_box(box)).groupBy("time").agg(*[F.avg(c).alias(c) for c in ("u10", "v10", "t2m", "blh")])


def grid_bbox_rain(grid: DataFrame, box) -> DataFrame:
    """Mean of the valid (not negative) cells, 0 where none is valid."""
    ok = F.col("precipitation") >= 0
    return grid.filter(_in_box(box)).groupBy("time").agg(
        F.coalesce(F.avg(F.when(ok, F.col("precipitation"))), F.lit(0.0)).alias("precipitation"),
        F.count_if(ok).alias("valid_pixels"),
        F.count("*").alias("total_pixels"),
    )


def grid_nearest_cell(grid: DataFrame, cities: DataFrame) -> DataFrame:
    """Grid values at the cell nearest to each city, axis by axis.

    The two axes of a regular grid are short lists (one value per grid line), so they travel as two arrays.
    """
    axes = grid.agg(F.array_sort(F.collect_set("latitude")).alias("lats"), F.array_sort(F.collect_set("longitude")).alias("lons"))

    def nearest(axis: str, at: str):
        return F.array_min(F.transform(axis, lambda v: F.struct(F.round(F.abs(v - F.col(at)), 6).alias("d"), v.alias("v"))))["v"]

    placed = cities.select("station_id", "latitude", "longitude").crossJoin(F.broadcast(axes)).select(
        "station_id", nearest("lats", "latitude").alias("latitude"), nearest("lons", "longitude").alias("longitude")
    )
    return placed.join(grid, ["latitude", "longitude"])


def calendar(span: DataFrame, step: str, unit: str) -> DataFrame:
    """Every slot between the two columns ``start`` and ``end`` of a one-row table."""
    seq = F.sequence(F.date_trunc(unit, "start"), F.col("end"), F.expr(f"INTERVAL {step}"))
    return span.select(F.explode(seq).alias("slot"))


def span_of(df: DataFrame, time: str = "datetime_utc") -> DataFrame:
    return df.agg(F.min(time).alias("start"), F.max(time).alias("end"))


def required_partitions(df: DataFrame, unit: str = "day") -> DataFrame:
    """Every (station, slot) between the first and last slot of the whole table."""
    slots = calendar(span_of(df), f"1 {unit.upper()}", unit)
    one = slots.agg(F.array_sort(F.collect_list("slot")).alias("slots"))  # bounded by the length of the calendar
    return df.select("station_id").distinct().crossJoin(F.broadcast(one)).select("station_id", F.explode("slots").alias("slot"))


def present_partitions(df: DataFrame, unit: str = "day") -> DataFrame:
    return df.select("station_id", F.date_trunc(unit, "datetime_utc").alias("slot")).distinct()


def missing_partitions(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.join(present, ["station_id", "slot"], "left_anti")


def missing_slots(df: DataFrame, unit: str = "day") -> DataFrame:
    """(station, slot) without rows between the first and the last slot of the whole table, read off neighbouring slots: no list of the slots required is made."""
    one = F.expr(f"INTERVAL 1 {unit.upper()}")
    have = present_partitions(df, unit)
    span = have.agg(F.min("slot").alias("_first"), F.max("slot").alias("_last"))
    w = Window.partitionBy("station_id").orderBy("slot")  # a row a slot
    steps = have.crossJoin(F.broadcast(span)).withColumns({"_from": F.coalesce(F.lag("slot").over(w) + one, F.col("_first")), "_next": F.lead("slot").over(w)})
    before = F.when(F.col("_from") < F.col("slot"), F.sequence("_from", F.col("slot") - one, one))
    after = F.when(F.col("_next").isNull() & (F.col("slot") < F.col("_last")), F.sequence(F.col("slot") + one, F.col("_last"), one))
    none = F.array().cast("array<timestamp>")
    return steps.select("station_id", F.explode(F.concat(F.coalesce(before, none), F.coalesce(after, none))).alias("slot"))


def next_range(df: DataFrame, start: str) -> DataFrame:
    """Per station: the later of the configured start and one hour after the latest row."""
    return df.groupBy("station_id").agg(
        F.greatest(F.lit(start).cast("timestamp"), F.max("datetime_utc") + F.expr("INTERVAL 1 HOUR")).alias("next_start")
    )


def needs_update(df: DataFrame, now: str, stale_hours: int = 6, gap_days: int = 7) -> DataFrame:
    """Whether each station needs a refresh: stale, or a gap longer than the limit."""
    at = F.unix_timestamp("datetime_utc")
    gap = at - F.lag(at).over(Window.partitionBy("station_id").orderBy("datetime_utc"))
    agg = df.select("station_id", "datetime_utc", gap.alias("gap")).groupBy("station_id").agg(
        F.max("datetime_utc").alias("latest"), (F.max("gap") / 3600).alias("max_gap_hours")
    )
    stale = (F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {stale_hours} HOURS")) > F.col("latest")
    long_gap = F.coalesce(F.col("max_gap_hours") > gap_days * 24, F.lit(False))
    return agg.select("station_id", "latest", "max_gap_hours", stale.alias("stale"), long_gap.alias("long_gap"), (stale | long_gap).alias("needs_update"))
