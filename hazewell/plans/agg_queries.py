"""Queries of the grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.operators import agg as A
from hazewell.plans.registry import query as q
from hazewell.sources import landing as L

c = F.col
ASOF = "2024-01-31 00:00:00"
METHODS = ["click", "error", "purchase", "signup", "view"]


q("resample_hourly", "D1", lambda t: A.resample_hourly(t.rain_half), """
WITH h AS (SELECT * FROM rain_half),
s AS (SELECT date_trunc('hour', datetime_utc) AS hr, sum(precipitation_mm_30min) AS p, avg(valid_pixels) AS v, avg(total_pixels) AS t FROM h GROUP BY 1),
g AS (SELECT unnest(generate_series(date_trunc('hour', min(datetime_utc)), max(datetime_utc), INTERVAL 1 HOUR)) AS datetime_utc FROM h)
SELECT datetime_utc, coalesce(p, 0) AS precipitation_mm_hourly, v AS valid_pixels, t AS total_pixels FROM g LEFT JOIN s ON hr = datetime_utc""",
  "precipitation_mm_hourly valid_pixels total_pixels")
q("first_per_hour", "D2", lambda t: A.first_per_hour(t.sparse), """
SELECT datetime_utc, min(station_id) AS station_id, min_by(pm25, station_id) AS pm25 FROM sparse GROUP BY 1""", "pm25")
q("station_profile", "D3", lambda t: A.station_profile(t.raw), """
SELECT station_id, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, count(*) AS n,
  avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS null_share, min_by(latitude, event_id) AS latitude, min_by(longitude, event_id) AS longitude FROM raw_meas GROUP BY 1""",
  "mean std min max null_share latitude longitude")
q("distinct_counts", "D4", lambda t: A.distinct_counts(t.raw, ["station_id", "sensor_id", "parameter"]), """
SELECT count(DISTINCT station_id) AS n_station_id, count(DISTINCT sensor_id) AS n_sensor_id, count(DISTINCT parameter) AS n_parameter FROM raw_meas""")
q("parameter_shares", "D5", lambda t: A.value_counts(t.raw, "parameter", 2), """
SELECT parameter, count(*) AS n, count(*) * 100 / (SELECT count(*) FROM raw_meas) AS percent FROM raw_meas GROUP BY 1 ORDER BY n DESC, parameter LIMIT 2""", "percent")
q("parameter_summary", "D6", lambda t: A.param_summary(L.flatten_sensors(t.locations)), """
SELECT parameter, 'ug/m3' AS unit, count(*) AS sensors, 'C' || (min(id) % 4) AS first_country FROM locations GROUP BY 1""")
q("location_summary", "D7", lambda t: A.location_summary(L.parse_locations(t.locations)), """
SELECT country, count(*) AS locations, min(la) AS lat_min, max(la) AS lat_max, min(lo) AS lon_min, max(lo) AS lon_max, count(*) FILTER (WHERE m) AS mobile, count(*) FILTER (WHERE NOT m) AS fixed
FROM (SELECT DISTINCT 'C' || (id % 4) AS country, id, round(CAST(26.5 AS DOUBLE) + (id % 300) / 100, 4) AS la, round(CAST(80 AS DOUBLE) + (id % 800) / 100, 4) AS lo, id % 3 = 0 AS m FROM locations) GROUP BY 1""",
  "lat_min lat_max lon_min lon_max")


def _spelled(t):
    return t.raw.select(F.when(c("sensor_id") % 2 == 0, F.upper("parameter")).otherwise(c("parameter")).alias("parameter"))


q("parameter_readiness", "D8", lambda t: A.readiness(_spelled(t)), """
WITH k AS (SELECT unnest(['pm25', 'pm10', 'no2', 'o3', 'so2', 'co', 'temperature', 'humidity', 'pressure']) AS parameter),
n AS (SELECT k.parameter, count(r.event_id) AS sensors FROM k LEFT JOIN raw_meas r USING (parameter) GROUP BY 1)
SELECT *, (SELECT count(*) FROM n WHERE sensors > 0) * 100 / 9 AS completeness FROM n""", "completeness")
q("artifact_rollup", "D9", lambda t: A.artifact_rollup(t.artifacts), """
SELECT source, stage, count(*) AS n, sum(size_bytes) / 1048576 AS size_mb, CAST(sum(records) AS BIGINT) AS records FROM artifacts GROUP BY GROUPING SETS ((source), (stage), ())""", "size_mb")
q("alert_rollup", "D10", lambda t: A.alert_rollup(t.alerts), """
SELECT severity, category, station_id, count(*) AS n, count(*) FILTER (WHERE NOT resolved) AS active, count(*) FILTER (WHERE resolved) AS resolved
FROM alerts GROUP BY GROUPING SETS ((severity), (category), (station_id), ())""")
q("lineage_rollup", "D11", lambda t: A.lineage_rollup(t.lineage), """
SELECT kind, station_id, count(*) AS n, CAST(sum(record_count) AS BIGINT) AS records, avg(record_count) AS mean_records FROM lineage GROUP BY GROUPING SETS ((kind), (station_id), ())""", "mean_records")
SEASON = """CASE WHEN month(target_ts) IN (12, 1, 2) THEN 'winter' WHEN month(target_ts) IN (3, 4, 5) THEN 'spring' WHEN month(target_ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""
q("error_cube", "D12", lambda t: A.error_cube(t.errors), f"""
SELECT model, season, hour, avg(abs(err)) AS mae, count(*) AS n FROM (SELECT model, {SEASON} AS season, hour(target_ts) AS hour, err FROM errors) GROUP BY CUBE (model, season, hour)""", "mae")
q("error_rollup_levels", "D12", lambda t: A.error_rollup_sets(t.errors), """
SELECT model, station_id, horizon, avg(abs(err)) AS mae, count(*) AS n FROM errors GROUP BY ROLLUP (model, station_id, horizon)""", "mae")
q("seasonal_profile", "D13", lambda t: A.seasonal_profile(t.readings), """
WITH m AS (SELECT station_id, avg(pm25) AS m FROM readings GROUP BY 1),
s AS (SELECT station_id, 'hour' AS kind, hour(datetime_utc) AS slot, avg(pm25) AS a FROM readings GROUP BY 1, 2, 3
  UNION ALL SELECT station_id, 'dow', isodow(datetime_utc) - 1, avg(pm25) FROM readings GROUP BY 1, 2, 3)
SELECT station_id, kind, slot, a - m AS deviation FROM s JOIN m USING (station_id)""", "deviation")
q("seasonal_strength", "D14", lambda t: A.seasonal_strength(t.readings, 24), """
WITH r AS (SELECT station_id, pm25, (row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc) - 1) % 24 AS ph FROM readings),
p AS (SELECT station_id, ph, avg(pm25) AS pm FROM r GROUP BY 1, 2), t AS (SELECT station_id, avg(pm25) AS m, var_samp(pm25) AS v FROM r GROUP BY 1)
SELECT station_id, least(1.0, avg(pow(pm - m, 2)) / max(v)) AS strength FROM p JOIN t USING (station_id) GROUP BY 1""", "strength")
q("mean_absolute_deviation", "D15", lambda t: A.mad(t.sparse), """
SELECT station_id, avg(abs(pm25 - m)) AS mad FROM sparse JOIN (SELECT station_id, avg(pm25) AS m FROM sparse GROUP BY 1) USING (station_id) GROUP BY 1""", "mad")


def _weighted(t):
    from hazewell.operators import joins as J
    return J.weighted_by_time(t.sparse, t.stations)


q("weighted_mean_by_country", "D16", _weighted, """
SELECT country, datetime_utc, CASE WHEN sum(weight) FILTER (WHERE weight > 0) > 0 THEN sum(pm25 * weight) FILTER (WHERE weight > 0) / sum(weight) FILTER (WHERE weight > 0) ELSE 0 END AS weighted
FROM sparse JOIN stations USING (station_id) GROUP BY 1, 2""", "weighted")
CH = ["missing", "stale", "outlier"]
q("notification_rollup", "D17", lambda t: A.notification_rollup(t.alerts), f"""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE resolved) AS sent, count(*) FILTER (WHERE NOT resolved) AS failed, avg(CASE WHEN resolved THEN 1 ELSE 0 END) AS success_share,
  max(ts) AS last_ts, {', '.join(f"count(*) FILTER (WHERE category = '{x}') AS ch_{x}" for x in CH)} FROM alerts GROUP BY 1""", "success_share")
q("channel_pivot", "D17", lambda t: A.channel_pivot(t.alerts), f"""
SELECT user_id, {', '.join(f"nullif(count(*) FILTER (WHERE category = '{x}'), 0) AS {x}" for x in CH)} FROM alerts GROUP BY 1""")
q("quality_rollup", "D18", lambda t: A.quality_rollup(t.alerts, ASOF, 72), f"""
SELECT station_id, count(*) AS n, avg(value) AS mean_value, {', '.join(f"count(*) FILTER (WHERE severity = '{x}') AS n_{x}" for x in ('low', 'medium', 'high', 'critical'))}, max(ts) AS last_ts
FROM alerts WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 72 HOUR GROUP BY 1""", "mean_value")
q("performance_rollup", "D19", lambda t: A.performance_rollup(t.errors, ASOF, 7), f"""
SELECT *, CASE WHEN mae < 10 THEN 'excellent' WHEN mae < 20 THEN 'good' ELSE 'retrain' END AS rating FROM (
  SELECT model, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, count(*) AS samples FROM errors WHERE target_ts >= TIMESTAMP '{ASOF}' - INTERVAL 7 DAY GROUP BY 1)""", "mae rmse")
q("throughput_rollup", "D20", lambda t: A.throughput_rollup(t.runs), """
SELECT job, count(*) AS operations, avg(seconds) AS mean_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds,
  avg(CASE WHEN seconds > 0 THEN records / seconds END) AS mean_rate, CAST(sum(records) AS BIGINT) AS records FROM runs GROUP BY 1""", "mean_seconds min_seconds max_seconds mean_rate")
q("importance_pivot", "D21", lambda t: A.importance_pivot(t.scores, METHODS), f"""
SELECT feature, {', '.join(f"max(score) FILTER (WHERE method = '{m}') AS {m}" for m in METHODS)} FROM scores GROUP BY 1""", " ".join(METHODS))


def _file_scores(t):
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n_rows"), (F.avg("k") / 97).alias("score"),
        F.array_sort(F.collect_set(F.when(c("k") < 30, F.concat(F.lit("issue "), c("k") % 10)))).alias("issues"))


q("file_quality_rollup", "D22", lambda t: A.file_quality_rollup(_file_scores(t)), """
SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS total_rows, avg(CASE WHEN s > 0 THEN s END) AS mean_score, count(*) FILTER (WHERE s >= 0.8) AS excellent,
  count(*) FILTER (WHERE s >= 0.6 AND s < 0.8) AS good, count(*) FILTER (WHERE s >= 0.4 AND s < 0.6) AS fair, count(*) FILTER (WHERE s < 0.4) AS poor
FROM (SELECT user_id, count(*) AS n, avg(k) / 97 AS s FROM ev GROUP BY 1)""", "mean_score")
q("frequent_file_issues", "D22", lambda t: A.most_frequent(_file_scores(t), "issues", 5), """
SELECT item, count(*) AS n FROM (SELECT DISTINCT user_id, 'issue ' || (k % 10) AS item FROM ev WHERE k < 30) GROUP BY 1 ORDER BY n DESC, item LIMIT 5""")


def _days(t):
    return t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        (F.avg((c("k") % 4 != 0).cast("int")) >= 0.75).alias("ok"), F.avg("value").alias("response"),
        F.array_sort(F.collect_set(F.when(c("k") % 4 == 0, F.concat(F.lit("e"), c("k"))))).alias("errors"))


q("availability_summary", "D23", lambda t: A.availability(_days(t)), """
SELECT count(*) AS days_checked, count(*) FILTER (WHERE ok) AS days_ok, round(avg(CASE WHEN ok THEN 1 ELSE 0 END) * 100, 1) AS percent, avg(r) AS mean_response
FROM (SELECT date_trunc('day', ts) AS d, avg(CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END) >= 0.75 AS ok, avg(value) AS r FROM ev GROUP BY 1)""", "percent mean_response")
q("availability_errors", "D23", lambda t: A.most_frequent(_days(t), "errors", 3, "error"), """
SELECT error, count(*) AS n FROM (SELECT DISTINCT date_trunc('day', ts) AS d, 'e' || k AS error FROM ev WHERE k % 4 = 0) GROUP BY 1 ORDER BY n DESC, error LIMIT 3""")


def _perturbed(t):
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("f"), c("k") % 40))).alias("features"))


q("perturbed_features", "D24", lambda t: A.most_frequent(_perturbed(t), "features", 10, "feature"), """
SELECT feature, count(*) AS n FROM (SELECT DISTINCT user_id, 'f' || (k % 40) AS feature FROM ev) GROUP BY 1 ORDER BY n DESC, feature LIMIT 10""")
