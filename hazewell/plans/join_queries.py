"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.operators import joins as J
from hazewell.operators import sets
from hazewell.operators.scalars_on import with_scalar
from hazewell.plans.registry import query as q
from hazewell.plans.scalar_queries import HAV

c = F.col

q("join_weather", "C1", lambda t: J.join_weather(t.readings, t.weather), """
SELECT r.*, w.* EXCLUDE (datetime_utc) FROM readings r LEFT JOIN weather w ON r.datetime_utc = w.datetime_utc""",
  "pm25 u10 v10 t2m_celsius blh wind_speed wind_direction")
q("join_rain", "C2", lambda t: J.join_rain(t.readings.withColumn("valid_pixels", F.lit(1)), t.rain), """
SELECT r.*, 1 AS valid_pixels, p.precipitation_mm_hourly, p.valid_pixels AS valid_pixels_rain, p.total_pixels FROM readings r
LEFT JOIN rain p ON r.datetime_utc = p.datetime_utc""",
  "pm25 precipitation_mm_hourly valid_pixels_rain total_pixels")
q("nearest_within_tolerance", "C3", lambda t: J.asof_nearest(
    t.events.select("event_id", c("ts").alias("datetime_utc")), t.rain_half, 900, "precipitation_mm_30min"), """
WITH b AS (SELECT datetime_utc AS bt, precipitation_mm_30min AS v FROM rain_half),
n AS (SELECT e.event_id, e.ts, b.v, epoch_us(bt) - epoch_us(ts) AS off, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(bt) - epoch_us(ts)), bt) AS rn
      FROM ev e LEFT JOIN b ON bt BETWEEN ts - INTERVAL 15 MINUTE AND ts + INTERVAL 15 MINUTE)
SELECT event_id, ts AS datetime_utc, v AS precipitation_mm_30min_near, off / 1000000 AS offset_seconds FROM n WHERE rn = 1""",
  "precipitation_mm_30min_near offset_seconds")
NEAR = """
WITH p AS (SELECT station_id, datetime_utc, datetime_utc - INTERVAL 24 HOUR AS lt FROM {pts}),
n AS (SELECT p.station_id, p.datetime_utc, h.pm25 AS nearest, h.datetime_utc AS nearest_ts,
        row_number() OVER (PARTITION BY p.station_id, p.datetime_utc ORDER BY abs(epoch(h.datetime_utc) - epoch(lt)), h.datetime_utc) AS rn
      FROM p JOIN {hist} h ON h.station_id = p.station_id),
w AS (SELECT p.station_id, p.datetime_utc, avg(h.pm25) AS near_mean FROM p LEFT JOIN {hist} h ON h.station_id = p.station_id
        AND h.datetime_utc BETWEEN lt - INTERVAL 3 HOUR AND lt + INTERVAL 3 HOUR GROUP BY 1, 2)"""
q("nearest_lag", "C4", lambda t: J.lookback(t.sparse.select("station_id", "datetime_utc"), t.sparse, 86400).drop("near_mean"),
  NEAR.format(pts="sparse", hist="sparse") + "SELECT station_id, datetime_utc, nearest, nearest_ts FROM n WHERE rn = 1", "nearest")
q("mean_of_near_hours", "C5", lambda t: J.lookback(t.holed.select("station_id", "datetime_utc"), t.holed, 86400).drop("nearest", "nearest_ts"),
  NEAR.format(pts="holed", hist="holed") + "SELECT * FROM w", "near_mean")
SRC = """(SELECT datetime_utc, CASE WHEN sum(weight) FILTER (WHERE weight > 0) > 0 THEN sum(pm25 * weight) FILTER (WHERE weight > 0) / sum(weight) FILTER (WHERE weight > 0) ELSE 0 END AS weighted
  FROM sparse JOIN stations USING (station_id) GROUP BY 1)"""
q("transport_lagged_join", "C6", lambda t: J.transport_join(t.readings, J.weighted_by_time(t.sparse, t.stations, ()), 48), f"""
SELECT r.*, coalesce(s.weighted, 0) AS transport FROM readings r LEFT JOIN {SRC} s ON r.datetime_utc = s.datetime_utc + INTERVAL 48 HOUR""", "pm25 transport")
q("external_station_stats", "C7", lambda t: J.external_stats(t.readings, t.sparse), """
SELECT r.*, ext_mean, ext_std, ext_max, ext_min FROM readings r LEFT JOIN (SELECT datetime_utc, avg(pm25) AS ext_mean, stddev_samp(pm25) AS ext_std,
  max(pm25) AS ext_max, min(pm25) AS ext_min FROM sparse GROUP BY 1) e USING (datetime_utc)""", "pm25 ext_mean ext_std ext_max ext_min")
q("align_future_weather", "C8", lambda t: J.align_future(J.future_hours(t.sparse, -24, 48), t.weather), """
WITH f AS (SELECT station_id, step, z + (step - 24) * INTERVAL 1 HOUR AS datetime_utc FROM (SELECT station_id, max(datetime_utc) AS z FROM sparse GROUP BY 1), range(1, 49) r(step))
SELECT f.*, coalesce(wind_speed, 2) AS wind_speed, coalesce(t2m_celsius, 20) AS t2m_celsius, coalesce(blh, 500) AS blh FROM f LEFT JOIN weather USING (datetime_utc)""",
  "wind_speed t2m_celsius blh")
q("missing_hours", "C9", lambda t: J.missing_hours(t.readings), """
SELECT station_id, slot FROM (SELECT DISTINCT station_id FROM readings),
  (SELECT unnest(generate_series(min(datetime_utc), max(datetime_utc), INTERVAL 1 HOUR)) AS slot FROM readings)
EXCEPT SELECT station_id, datetime_utc FROM readings""")
q("chosen_stations", "C10", lambda t: J.semi_stations(t.sparse, t.stations.filter("weight > 0.5")), """
SELECT * FROM sparse WHERE station_id IN (SELECT station_id FROM stations WHERE weight > 0.5)""", "pm25")
PAIR = HAV.format(a1="a.latitude", a2="a.longitude", b1="b.latitude", b2="b.longitude")
q("near_station_pairs", "C11", lambda t: J.station_pairs(t.stations, 80.0), f"""
SELECT * FROM (SELECT a.station_id AS a_id, b.station_id AS b_id, {PAIR} AS km FROM stations a JOIN stations b ON a.station_id < b.station_id) WHERE km <= 80""", "km")
q("scalar_means", "C12", lambda t: with_scalar(t.readings, t.readings.agg(F.avg("pm25").alias("overall"), F.min("datetime_utc").alias("first_ts"))), """
SELECT * FROM readings, (SELECT avg(pm25) AS overall, min(datetime_utc) AS first_ts FROM readings)""", "pm25 overall")
q("within_radius", "C13", lambda t: J.within_radius(t.stations, 27.7172, 85.324, 250.0).select("station_id", "km"), f"""
SELECT station_id, km FROM (SELECT station_id, {HAV.format(a1='27.7172', a2='85.324', b1='latitude', b2='longitude')} AS km FROM stations) WHERE km <= 250""", "km")
q("join_actuals", "C14", lambda t: J.join_actuals(t.forecasts.drop("y"), t.holed), """
SELECT f.* EXCLUDE (y), h.pm25 AS actual FROM forecasts f JOIN holed h ON h.station_id = f.station_id AND h.datetime_utc = f.target_ts""", "yhat actual")

q("union_sources", "G1", lambda t: sets.union_sources(t.readings.withColumn("src", F.lit("dense")), t.sparse), """
SELECT station_id, datetime_utc, pm25, 'dense' AS src FROM readings UNION ALL SELECT station_id, datetime_utc, pm25, NULL FROM sparse""", "pm25")


def _parts(t, table, cond=None):
    df = getattr(t, table)
    return sets.distinct_partitions(df.filter(cond) if cond else df)


q("except_partitions", "G2", lambda t: sets.except_partitions(_parts(t, "artifacts"), _parts(t, "artifacts", "stage = 'F'")), """
SELECT DISTINCT station_id, partition FROM artifacts EXCEPT SELECT station_id, partition FROM artifacts WHERE stage = 'F'""")
q("distinct_partitions", "G3", lambda t: _parts(t, "artifacts"), "SELECT DISTINCT station_id, partition FROM artifacts")
q("jaccard_top_features", "G4", lambda t: sets.jaccard(t.scores, 5), """
WITH r AS (SELECT method, feature FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rn FROM scores) WHERE rn <= 5),
i AS (SELECT a.method AS a_method, b.method AS b_method, count(*) AS n FROM r a JOIN r b ON a.feature = b.feature AND a.method < b.method GROUP BY 1, 2),
m AS (SELECT DISTINCT method FROM r)
SELECT x.method AS a_method, y.method AS b_method, coalesce(n, 0) / (10 - coalesce(n, 0)) AS jaccard FROM m x JOIN m y ON x.method < y.method
LEFT JOIN i ON i.a_method = x.method AND i.b_method = y.method""", "jaccard")
q("intersect_stations", "G5", lambda t: sets.intersect_stations(t.sparse, t.stations), """
SELECT station_id FROM sparse INTERSECT SELECT station_id FROM stations""")
