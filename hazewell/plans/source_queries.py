"""Queries of sources, sinks, nested and gridded data."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from hazewell import schemas
from hazewell.plans.registry import query as q
from hazewell.session import shared_dir
from hazewell.sources import landing as L
from hazewell.sources import readers as R

c = F.col
BOX = (27.5, 27.9, 84.9, 85.4)
BOX_SQL = "latitude BETWEEN 27.5 AND 27.9 AND longitude BETWEEN 84.9 AND 85.4"
NOW = "2024-01-31 03:00:00"


def _round_trip(t, df, write, name):
    path = shared_dir(t.spark, f"{name}-{uuid.uuid4().hex}")
    write(df, path)
    return t.spark.read.parquet(path)


def _stored(t, df, kind, name):
    path = shared_dir(t.spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return R.read_table(t.spark, path, kind)


q("read_readings", "A1", lambda t: _stored(t, t.readings, "readings", "readings"), "SELECT * FROM readings", "pm25")
q("read_weather", "A2", lambda t: _stored(t, t.weather, "weather", "weather").select("datetime_utc", "u10", "t2m_celsius"),
  "SELECT datetime_utc, u10, t2m_celsius FROM weather", "u10 t2m_celsius")


def _optional_rain(t):
    rain = R.read_optional(t.spark, os.path.join(t.folder, "no_such_rain.parquet"), schemas.RAIN)
    return t.readings.join(rain, "datetime_utc", "left").select("station_id", "datetime_utc", "pm25", "precipitation_mm_hourly")


q("read_optional_rain", "A3", _optional_rain,
  "SELECT station_id, datetime_utc, pm25, CAST(NULL AS DOUBLE) AS precipitation_mm_hourly FROM readings", "pm25")
q("write_partitioned", "A4", lambda t: _round_trip(t, t.readings, R.write_partitioned, "parts").groupBy("station_id", "year", "month").agg(
    F.count("*").alias("n"), F.sum("pm25").alias("total")), """
SELECT station_id, year(datetime_utc) AS year, month(datetime_utc) AS month, count(*) AS n, sum(pm25) AS total FROM readings GROUP BY 1, 2, 3""", "total")
q("combine_targets", "A5", lambda t: R.combine_targets(_round_trip(t, t.raw, R.write_partitioned, "targets")).select("station_id", "datetime_utc", "parameter", "value", "event_id"), """
SELECT station_id, datetime_utc, parameter, min_by(value, event_id) AS value, min(event_id) AS event_id FROM raw_meas WHERE value IS NOT NULL GROUP BY 1, 2, 3""", "value")
PQ = """pq AS (SELECT station_id, year(datetime_utc) AS year, month(datetime_utc) AS month, (value IS NULL)::INT + (station_id IS NULL)::INT + (datetime_utc IS NULL)::INT + (parameter IS NULL)::INT AS nulls,
  coalesce(parameter = 'pm25' AND (value < 0 OR value > 1000), false) AS o, row_number() OVER (PARTITION BY station_id, datetime_utc, parameter ORDER BY event_id) AS rn FROM raw_meas)"""
PQC = """count(*) AS total, CAST(sum(nulls) AS BIGINT) AS missing, count(*) FILTER (WHERE rn > 1) AS duplicates, count(*) FILTER (WHERE o) AS outliers, count(*) FILTER (WHERE rn = 1 AND nulls = 0 AND NOT o) AS valid"""
PQS = "least(1.0, greatest(0.0, 0.4 * valid / total + 0.3 * (1 - missing / total) + 0.2 * (1 - duplicates / total) + 0.1 * (1 - outliers / total))) AS score"
q("partition_quality", "A5 score", lambda t: R.targets_quality(_round_trip(t, t.raw, R.write_partitioned, "targets")),
  f"WITH {PQ} SELECT *, {PQS} FROM (SELECT station_id, year, month, {PQC} FROM pq GROUP BY 1, 2, 3)", "score")
q("combined_quality", "A5 score", lambda t: R.targets_quality(_round_trip(t, t.raw, R.write_partitioned, "targets"), ()),
  f"WITH {PQ} SELECT *, {PQS} FROM (SELECT {PQC} FROM pq)", "score")
q("write_compact", "A6", lambda t: _round_trip(t, t.met, lambda d, p: R.write_compact(d, p, keep=("pm25",)), "compact").select(
    "station_id", "datetime_utc", "pm25", "blh", F.typeof("blh").alias("blh_type"), F.typeof("station_id").alias("id_type")), """
SELECT station_id, datetime_utc, pm25, blh, 'float' AS blh_type, 'int' AS id_type FROM met""", "pm25 blh")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NEEDED = {"events.parquet": ["event_id", "ts", "user_id", "event_type", "value", "props"], "orders.parquet": ["o_orderkey", "o_orderdate"], "documents.parquet": ["doc_id", "text", "lang", "source", "n_chars"]}
q("validate_files", "A7", lambda t: R.validate_dataset(t.spark, [t.path(n) for n in TABLES], NEEDED).groupBy("table").agg(
    F.sum("n_rows").alias("n_rows"), F.every("valid").alias("valid")), " UNION ALL ".join(
    f"SELECT '{n}.parquet' AS \"table\", count(*) AS n_rows, count(*) > 0 AS valid FROM {n}" for n in TABLES))
q("scan_inventory", "A8", lambda t: R.scan_inventory(t.spark, t.folder, "*.parquet"))
q("file_inventory", "A8 files", lambda t: R.file_inventory(t.spark, t.folder))
q("file_hash", "A9", lambda t: R.file_hash(t.spark, t.folder))
q("match_schema", "A10", lambda t: R.match_schema(
    t.locations.select(F.from_json("doc", "id BIGINT").getField("id").alias("id"), F.json_object_keys("doc").alias("keys")), "keys").drop("keys"), """
SELECT DISTINCT id, 'locations' AS dataset, 1.0 AS share FROM locations""", "share")
q("flatten_sensors", "A11", lambda t: L.flatten_sensors(t.locations), """
SELECT id AS location_id, 'C' || (id % 4) AS country, round(CAST(26.5 AS DOUBLE) + (id % 300) / 100, 4) AS latitude,
  round(CAST(80 AS DOUBLE) + (id % 800) / 100, 4) AS longitude, id % 3 = 0 AS is_mobile, id AS sensor_id, parameter, 'ug/m3' AS unit FROM locations""",
  "latitude longitude")
q("flatten_measurements", "A12", lambda t: L.flatten_measurements(L.measurement_docs(t.raw)), """
SELECT sensor_id, parameter, value, unit, datetime_utc, latitude, longitude, quality_flag FROM raw_meas""", "value latitude longitude")


def _enrich(t):
    sensors = L.flatten_sensors(t.locations).groupBy("sensor_id").agg(F.min("country").alias("country"), F.count("*").alias("n_parameters"))
    return L.enrich_measurements(t.raw.select("event_id", "sensor_id", "value"), sensors)


q("enrich_measurements", "A13", _enrich, """
SELECT event_id, sensor_id, value, 'C' || (sensor_id % 4) AS country, n_parameters FROM raw_meas
LEFT JOIN (SELECT id, count(*) AS n_parameters FROM locations GROUP BY 1) ON id = sensor_id""", "value")
q("grid_box_mean", "A14", lambda t: L.grid_bbox_mean(t.grid, BOX), f"""
SELECT "time", avg(u10) AS u10, avg(v10) AS v10, avg(t2m) AS t2m, avg(blh) AS blh FROM grid WHERE {BOX_SQL} GROUP BY 1""", "u10 v10 t2m blh")
q("grid_box_rain", "A15", lambda t: L.grid_bbox_rain(t.grid, BOX), f"""
SELECT "time", coalesce(avg(precipitation) FILTER (WHERE precipitation >= 0), 0) AS precipitation, count(*) FILTER (WHERE precipitation >= 0) AS valid_pixels,
  count(*) AS total_pixels FROM grid WHERE {BOX_SQL} GROUP BY 1""", "precipitation")
q("grid_nearest_cell", "A16", lambda t: L.grid_nearest_cell(t.grid, t.stations).select("station_id", "latitude", "longitude", "time", "u10"), """
WITH la AS (SELECT DISTINCT latitude AS v FROM grid), lo AS (SELECT DISTINCT longitude AS v FROM grid),
p AS (SELECT station_id, (SELECT v FROM la ORDER BY round(abs(v - s.latitude), 6), v LIMIT 1) AS latitude,
        (SELECT v FROM lo ORDER BY round(abs(v - s.longitude), 6), v LIMIT 1) AS longitude FROM stations s)
SELECT station_id, latitude, longitude, "time", u10 FROM p JOIN grid USING (latitude, longitude)""", "latitude longitude u10")


def _calendars(t):
    span = L.span_of(t.readings)
    out = None
    for unit, step in (("month", "1 MONTH"), ("day", "1 DAY"), ("half_hour", "30 MINUTES")):
        one = L.calendar(span, step, "hour" if unit == "half_hour" else unit).select(F.lit(unit).alias("unit"), "slot")
        out = one if out is None else out.unionByName(one)
    return out


q("calendar_slots", "A17", _calendars, """
WITH s AS (SELECT min(datetime_utc) AS a, max(datetime_utc) AS z FROM readings)
SELECT 'month' AS unit, unnest(generate_series(date_trunc('month', a), z, INTERVAL 1 MONTH)) AS slot FROM s
UNION ALL SELECT 'day', unnest(generate_series(date_trunc('day', a), z, INTERVAL 1 DAY)) FROM s
UNION ALL SELECT 'half_hour', unnest(generate_series(a, z, INTERVAL 30 MINUTE)) FROM s""")
q("missing_partitions", "A18", lambda t: L.missing_slots(t.sparse), """
SELECT station_id, slot FROM (SELECT DISTINCT station_id FROM sparse),
  (SELECT unnest(generate_series(date_trunc('day', min(datetime_utc)), max(datetime_utc), INTERVAL 1 DAY)) AS slot FROM sparse)
EXCEPT SELECT station_id, date_trunc('day', datetime_utc) FROM sparse""")
q("next_range", "A19", lambda t: L.next_range(t.sparse, "2024-01-30 12:00:00"), """
SELECT station_id, greatest(TIMESTAMP '2024-01-30 12:00:00', max(datetime_utc) + INTERVAL 1 HOUR) AS next_start FROM sparse GROUP BY 1""")
q("needs_update", "A20", lambda t: L.needs_update(t.sparse, NOW, 6, 2), f"""
SELECT *, stale OR long_gap AS needs_update FROM (
  SELECT station_id, max(datetime_utc) AS latest, max(g) AS max_gap_hours, max(datetime_utc) < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AS stale,
    coalesce(max(g) > 48, false) AS long_gap
  FROM (SELECT *, date_diff('hour', lag(datetime_utc) OVER (PARTITION BY station_id ORDER BY datetime_utc), datetime_utc) AS g FROM sparse) GROUP BY 1)""",
  "max_gap_hours")
