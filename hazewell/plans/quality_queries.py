"""Queries of completeness, gaps, validity, alerts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.operators import quality as Q
from hazewell.plans.registry import query as q
from hazewell.plans.scalar_queries import HAV

c = F.col
S, E = "2024-01-01 00:00:00", "2024-01-30 23:00:00"
ASOF = "2024-01-31 00:00:00"
TS, TE, TA = f"TIMESTAMP '{S}'", f"TIMESTAMP '{E}'", f"TIMESTAMP '{ASOF}'"

GAPS = f"""
grid AS (SELECT station_id, slot FROM (SELECT DISTINCT station_id FROM sparse), (SELECT unnest(generate_series({TS}, {TE}, INTERVAL 1 HOUR)) AS slot)),
miss AS (SELECT g.station_id, g.slot FROM grid g LEFT JOIN sparse s ON s.station_id = g.station_id AND s.datetime_utc = g.slot WHERE s.station_id IS NULL),
isl AS (SELECT station_id, slot, slot - row_number() OVER (PARTITION BY station_id ORDER BY slot) * INTERVAL 1 HOUR AS k FROM miss),
gap AS (SELECT station_id, min(slot) AS gap_start, max(slot) AS gap_end, count(*) AS slots, CAST(count(*) AS DOUBLE) AS hours FROM isl GROUP BY station_id, k)"""
COMP = f"""comp AS (SELECT station_id, actual, 720 AS expected, actual * 100 / 720 AS percent FROM (SELECT station_id, count(*) FILTER (WHERE datetime_utc BETWEEN {TS} AND {TE}) AS actual FROM sparse GROUP BY 1))"""
IMPACT = "CASE WHEN hours <= 3 THEN '{a}' WHEN hours <= 12 THEN '{b}' WHEN hours <= 48 THEN 'high' ELSE 'critical' END"


def _gaps(t):
    return Q.gaps(t.sparse, S, E)


q("completeness", "J1", lambda t: Q.completeness(t.sparse, S, E), f"WITH {COMP} SELECT station_id, expected, actual, percent FROM comp", "percent")
q("gap_islands", "J2", _gaps, f"WITH {GAPS} SELECT * FROM gap", "hours")
q("gap_classes", "J3", lambda t: Q.classify_gaps(_gaps(t), ["t2m_celsius"]), f"""
WITH {GAPS} SELECT *, CASE WHEN hours <= 6 THEN 'short' WHEN hours <= 24 THEN 'medium' WHEN hours <= 72 THEN 'long' ELSE 'critical' END AS gap_class,
  {IMPACT.format(a='medium', b='high')} AS impact FROM gap""", "hours")
q("completeness_grade", "J4", lambda t: Q.grade(Q.completeness(t.readings, S, E), Q.classify_gaps(Q.gaps(t.readings, S, E))), f"""
WITH {GAPS.replace('sparse', 'readings')}, {COMP.replace('sparse', 'readings')},
n AS (SELECT station_id, count(*) FILTER (WHERE hours > 48) AS n_critical, count(*) FILTER (WHERE hours > 12 AND hours <= 48) AS n_high FROM gap GROUP BY 1)
SELECT station_id, percent, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high,
  CASE WHEN n_critical > 0 THEN CASE WHEN percent >= 95 THEN 'C' WHEN percent >= 90 THEN 'D' ELSE 'F' END
    WHEN n_high > 2 THEN CASE WHEN percent >= 98 THEN 'B' WHEN percent >= 95 THEN 'C' WHEN percent >= 90 THEN 'D' ELSE 'F' END
    ELSE CASE WHEN percent >= 98 THEN 'A' WHEN percent >= 95 THEN 'B' WHEN percent >= 90 THEN 'C' WHEN percent >= 80 THEN 'D' ELSE 'F' END END AS grade
FROM comp LEFT JOIN n USING (station_id)""", "percent")
q("gap_fill_strategy", "J5", lambda t: Q.fill_strategy(_gaps(t)), f"""
WITH {GAPS} SELECT 'gap_' || strftime(gap_start, '%Y%m%d_%H%M') AS gap_id, station_id, hours, CASE WHEN hours <= 3 THEN 'linear_interpolation'
  WHEN hours <= 12 THEN 'seasonal_interpolation' WHEN hours <= 48 THEN 'historical_averaging' ELSE 'external_data_source' END AS strategy FROM gap""", "hours")
q("step_gaps", "J6", lambda t: Q.diff_gaps(t.readings, 1), """
SELECT station_id, p AS gap_from, datetime_utc AS gap_to, date_diff('hour', p, datetime_utc) AS hours
FROM (SELECT *, lag(datetime_utc) OVER (PARTITION BY station_id ORDER BY datetime_utc) AS p FROM readings) WHERE date_diff('hour', p, datetime_utc) > 1""", "hours")
EXPECTED = {"event_id": T.LongType(), "value": T.DoubleType(), "unit": T.StringType(), "datetime_utc": T.TimestampType(), "parameter": T.LongType(), "altitude": T.DoubleType()}
CHECKED = [("event_id", "'int'", "'int'", "ok"), ("value", "'float'", "'float'", "ok"), ("unit", "'text'", "'text'", "ok"), ("datetime_utc", "'time'", "'time'", "ok"),
           ("parameter", "'int'", "'text'", "wrong type"), ("altitude", "'float'", "NULL", "missing")] + [
    (x, "NULL", k, "extra") for x, k in (("station_id", "'int'"), ("sensor_id", "'int'"), ("latitude", "'float'"), ("longitude", "'float'"), ("quality_flag", "'text'"), ("data_source", "'text'"))]
q("schema_check", "J7", lambda t: Q.check_schema(t.raw, EXPECTED), " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", {w} AS expected, {g} AS found, '{st}' AS status, {'count(' + x + ')' if g != 'NULL' else 'count(*) * 0'} AS n_values FROM raw_meas" for x, w, g, st in CHECKED))
RQ = """rq AS (SELECT count(*) AS total, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE rn > 1) AS duplicates, count(*) FILTER (WHERE o) AS outliers,
  count(*) FILTER (WHERE value IS NOT NULL AND rn = 1 AND NOT o) AS valid
FROM (SELECT *, row_number() OVER (PARTITION BY station_id, datetime_utc, parameter ORDER BY event_id) AS rn, coalesce(parameter = 'pm25' AND (value < 0 OR value > 1000), false) AS o FROM raw_meas))"""
q("record_quality", "J8", lambda t: Q.record_quality(t.raw), f"WITH {RQ} SELECT * FROM rq")
q("record_quality_score", "J9", lambda t: Q.quality_score(Q.record_quality(t.raw)), f"""
WITH {RQ} SELECT *, least(1.0, greatest(0.0, 0.4 * valid / total + 0.3 * (1 - missing / total) + 0.2 * (1 - duplicates / total) + 0.1 * (1 - outliers / total))) AS score FROM rq""", "score")
q("temporal_consistency", "J10", lambda t: Q.temporal_consistency(t.readings), """
SELECT station_id, avg(CASE WHEN h = 1 THEN 1 WHEN h IS NOT NULL THEN 0 END) AS temporal, count(*) FILTER (WHERE h > 1) AS gaps
FROM (SELECT station_id, date_diff('hour', lag(datetime_utc) OVER (PARTITION BY station_id ORDER BY datetime_utc), datetime_utc) AS h FROM readings) GROUP BY 1""", "temporal")
HS = """hs AS (SELECT count(*) FILTER (WHERE h = 1) / count(h) AS temporal, count(*) FILTER (WHERE h > 1) AS gaps FROM (SELECT date_diff('hour', lag(datetime_utc) OVER (ORDER BY datetime_utc), datetime_utc) AS h FROM weather))"""
BOUND = {"u10": (-50, 50), "v10": (-50, 50), "wind_speed": (0, 50), "wind_direction": (0, 360), "t2m_celsius": (-60, 60), "blh": (10, 5000)}
PB = "pb AS (SELECT (" + " + ".join(f"count(*) FILTER (WHERE {k} BETWEEN {a} AND {b})" for k, (a, b) in BOUND.items()) + ") / (" + " + ".join(f"count({k})" for k in BOUND) + ") AS physical FROM weather)"
WC = "wc AS (SELECT avg(CASE WHEN abs(sqrt(u10 * u10 + v10 * v10) - wind_speed) <= 0.01 * wind_speed THEN 1 ELSE 0 END) AS spatial FROM weather)"
q("hourly_steps", "J10", lambda t: Q.hourly_steps(t.weather), f"WITH {HS} SELECT * FROM hs", "temporal")
q("physical_bounds", "J11", lambda t: Q.physical_bounds(t.weather), f"WITH {PB} SELECT * FROM pb", "physical")
q("wind_component_check", "J12", lambda t: Q.wind_consistency_check(t.weather), f"WITH {WC} SELECT * FROM wc", "spatial")
q("rain_plausibility", "J13", lambda t: Q.rain_physics(t.rain), """
SELECT avg(CASE WHEN precipitation_mm_hourly BETWEEN 0 AND 100 THEN 1 ELSE 0 END) * CASE WHEN avg(CASE WHEN precipitation_mm_hourly <= 5 THEN 1 ELSE 0 END) >= 0.8 THEN 1 ELSE 0.8 END AS physical FROM rain""", "physical")
IV = ["wind_speed", "blh", "t2m_celsius"]
q("iqr_outlier_counts", "J14", lambda t: Q.iqr_outliers(t.weather, IV), " UNION ALL ".join(f"""
SELECT '{v}' AS variable, count(*) FILTER (WHERE {v} < a - 1.5 * (b - a) OR {v} > b + 1.5 * (b - a)) AS outliers, count(*) AS n
FROM weather, (SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b FROM weather)""" for v in IV))
q("weather_quality", "J15", lambda t: Q.met_quality(t.weather), f"WITH {HS}, {PB}, {WC} SELECT *, (temporal + physical + spatial) / 3 AS overall FROM hs, pb, wc", "temporal physical spatial overall")


def _alerts(t):
    prev = t.raw.groupBy("station_id").agg((F.avg("event_id") / F.max("event_id")).alias("previous_score"), (F.avg((c("quality_flag") == "valid").cast("int")) - 0.7).alias("current_score"))
    return Q.data_alerts(t.raw.withColumn("station_id", c("sensor_id")), ASOF, prev.withColumnRenamed("station_id", "station_id"), t.stations)


q("data_alerts", "J16", _alerts, f"""
WITH a AS (SELECT sensor_id AS station_id, count(*) AS n, max(datetime_utc) AS latest, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS ns,
    count(*) FILTER (WHERE value < 0 OR value > 500) / greatest(count(value), 1) AS os FROM raw_meas GROUP BY 1),
p AS (SELECT station_id, avg(event_id) / max(event_id) - (avg(CASE WHEN quality_flag = 'valid' THEN 1 ELSE 0 END) - 0.7) AS drp FROM raw_meas GROUP BY 1),
j AS (SELECT s.station_id, n, ns, os, drp, date_diff('second', latest, {TA}) / 3600 AS h FROM (SELECT DISTINCT station_id FROM stations) s LEFT JOIN a USING (station_id) LEFT JOIN p USING (station_id))
SELECT station_id, 'no_data' AS rule, 'missing_data' AS category, 'high' AS severity, 0 AS value FROM j WHERE n IS NULL
UNION ALL SELECT station_id, 'stale', 'freshness', CASE WHEN h < 24 THEN 'medium' ELSE 'high' END, h FROM j WHERE h > 2
UNION ALL SELECT station_id, 'missing_values', 'missing_data', CASE WHEN ns < 0.5 THEN 'medium' ELSE 'high' END, ns FROM j WHERE ns > 0.2
UNION ALL SELECT station_id, 'outliers', 'outliers', 'medium', os FROM j WHERE os > 0.05
UNION ALL SELECT station_id, 'score_drop', 'poor_quality', 'medium', drp FROM j WHERE drp > 0.2
UNION ALL SELECT station_id, 'low_volume', 'missing_data', 'low', n FROM j WHERE n < 20""", "value")
q("active_alerts", "J17", lambda t: Q.active_alerts(t.alerts, ASOF, 7, severity="high"), f"""
SELECT * FROM alerts WHERE NOT resolved AND severity = 'high' AND ts >= {TA} - INTERVAL 7 DAY""", "value")


def _dim_input(t):
    return t.holed.join(t.weather.select("datetime_utc", c("t2m_celsius").alias("temperature")), "datetime_utc")


def _dims(t):
    return Q.quality_dimensions(_dim_input(t), ASOF)


DIMS = f"""
d AS (SELECT h.*, t2m_celsius AS temperature FROM holed h JOIN weather USING (datetime_utc)),
qq AS (SELECT station_id, quantile_cont(pm25, 0.25) AS pa, quantile_cont(pm25, 0.75) AS pb, quantile_cont(temperature, 0.25) AS ta, quantile_cont(temperature, 0.75) AS tb FROM d GROUP BY 1),
g AS (SELECT station_id, count(*) AS n, count(*) FILTER (WHERE pm25 IS NULL) AS nulls, count(*) FILTER (WHERE pm25 < 0) AS neg,
   count(*) FILTER (WHERE pm25 < pa - 1.5 * (pb - pa) OR pm25 > pb + 1.5 * (pb - pa)) + count(*) FILTER (WHERE temperature < ta - 1.5 * (tb - ta) OR temperature > tb + 1.5 * (tb - ta))
   + count(*) FILTER (WHERE pm25 < 0 OR pm25 > 1000) + count(*) FILTER (WHERE temperature < -50 OR temperature > 60) AS odd,
   avg(CASE WHEN date_diff('second', datetime_utc, {TA}) / 3600 <= 24 THEN 1 ELSE 0 END) AS fresh, CASE WHEN corr(pm25, temperature) < -0.8 THEN 1 ELSE 0 END AS ng FROM d JOIN qq USING (station_id) GROUP BY 1),
l AS (SELECT station_id, 'completeness' AS metric, 1 - nulls / (n * 4) AS value, 0.95 AS good, 0.8 AS warn FROM g UNION ALL SELECT station_id, 'consistency', 1 - ng / (n + 1), 0.9, 0.7 FROM g
   UNION ALL SELECT station_id, 'accuracy', 1 - odd / (n * 4), 0.85, 0.7 FROM g UNION ALL SELECT station_id, 'validity', 1 - neg / (n + 2), 0.95, 0.8 FROM g UNION ALL SELECT station_id, 'timeliness', fresh, 0.9, 0.7 FROM g),
dims AS (SELECT station_id, metric, value, CASE WHEN value >= good THEN 'good' WHEN value >= warn THEN 'warning' ELSE 'critical' END AS status FROM l)"""
OVER = """o AS (SELECT station_id, overall, CASE WHEN nc > 0 THEN 'critical' WHEN nw > 0 AND overall < 0.8 THEN 'warning' WHEN overall >= 0.9 THEN 'good' WHEN overall >= 0.7 THEN 'warning' ELSE 'critical' END AS status FROM (
  SELECT station_id, sum(value * CASE metric WHEN 'completeness' THEN 0.25 WHEN 'consistency' THEN 0.2 WHEN 'accuracy' THEN 0.25 ELSE 0.15 END) AS overall,
    count(*) FILTER (WHERE status = 'critical') AS nc, count(*) FILTER (WHERE status = 'warning') AS nw FROM dims GROUP BY 1))"""
q("quality_dimensions", "J18", _dims, f"WITH {DIMS} SELECT * FROM dims", "value")
q("overall_quality", "J19", lambda t: Q.overall_quality(_dims(t)), f"WITH {DIMS}, {OVER} SELECT * FROM o", "overall")
q("quality_advice", "J20", lambda t: Q.quality_advice(_dims(t), Q.overall_quality(_dims(t))), f"""
WITH {DIMS}, {OVER} SELECT station_id, metric, metric || '-' || status AS advice FROM dims WHERE status <> 'good'
UNION ALL SELECT station_id, 'overall', CASE WHEN overall < 0.7 THEN 'overall-low' WHEN overall < 0.9 THEN 'overall-fair' ELSE 'overall-high' END FROM o""")


def _file_quality(t):
    rows = t.raw.select(c("sensor_id").alias("file_id"), "datetime_utc", "parameter", c("value").alias("pm25"))
    return Q.file_quality(rows, "file_id", ["datetime_utc"])


FQ = """
r AS (SELECT sensor_id AS file_id, datetime_utc, parameter, value AS pm25 FROM raw_meas),
dup AS (SELECT file_id, CAST(sum(k - 1) AS BIGINT) AS dup FROM (SELECT file_id, datetime_utc, parameter, pm25, count(*) AS k FROM r GROUP BY ALL) GROUP BY 1),
qt AS (SELECT file_id, quantile_cont(pm25, 0.25) AS a, quantile_cont(pm25, 0.75) AS b FROM r GROUP BY 1),
hg AS (SELECT file_id, count(*) FILTER (WHERE h > 2) AS gaps FROM (SELECT file_id, date_diff('hour', lag(datetime_utc) OVER (PARTITION BY file_id ORDER BY datetime_utc), datetime_utc) AS h
   FROM (SELECT DISTINCT file_id, datetime_utc FROM r)) GROUP BY 1),
bs AS (SELECT file_id, count(*) AS n_rows, count(*) FILTER (WHERE pm25 IS NULL) * 100 / (count(*) * 3) AS null_pct, date_diff('day', min(datetime_utc), max(datetime_utc)) AS span_days,
   count(*) FILTER (WHERE pm25 < 0) AS negatives, CASE WHEN max(b - a) > 0 THEN count(*) FILTER (WHERE pm25 < a - 1.5 * (b - a) OR pm25 > b + 1.5 * (b - a)) * 100 / count(pm25) ELSE 0 END AS outlier_pct
   FROM r JOIN qt USING (file_id) GROUP BY 1),
mq AS (SELECT file_id, n_rows, null_pct, dup * 100 / n_rows AS dup_pct, span_days, gaps, negatives, outlier_pct FROM bs JOIN dup USING (file_id) JOIN hg USING (file_id)),
fq AS (SELECT *, 0.4 * greatest(0, 1 - null_pct / 100) + 0.3 * greatest(0, 1 - dup_pct / 100 - least(1, outlier_pct / 20))
   + 0.3 * CASE WHEN span_days > 0 THEN greatest(0, least(1, span_days / 30) - least(1, gaps / 100)) ELSE 0 END AS score FROM mq)"""
q("file_quality", "J21", _file_quality, f"WITH {FQ} SELECT * FROM fq", "null_pct dup_pct outlier_pct score")
q("sensor_coverage", "J22", lambda t: Q.sensor_coverage(t.raw, S, ASOF), f"""
SELECT sensor_id, 720 AS expected, n AS actual, greatest(0, 720 - n) * 100 / 720 AS missing_pct, 1 - greatest(0, 720 - n) / 720 AS score
FROM (SELECT sensor_id, count(value) FILTER (WHERE datetime_utc >= {TS} AND datetime_utc < {TA}) AS n FROM raw_meas GROUP BY 1)""", "missing_pct score")
VARS = ["u10", "v10", "t2m_celsius", "blh"]


def _days(t):
    return Q.day_check(t.weather.withColumn("blh", F.when(c("blh") > 700, c("blh"))), VARS)


DAYS = """dd AS (SELECT date_trunc('day', datetime_utc) AS day, count(DISTINCT hour(datetime_utc)) AS hours, count(CASE WHEN blh > 700 THEN 1 END) AS nb FROM weather GROUP BY 1),
dc AS (SELECT day, hours, CASE WHEN nb = 0 THEN 'blh' ELSE '' END AS missing, hours = 24 AS ok_hours, hours = 24 AND nb > 0 AS ok FROM dd)"""


def _rain_days(t):
    return t.rain.groupBy(F.date_trunc("day", "datetime_utc").alias("day")).agg((F.count("*") >= 24).alias("ok"))


KM = HAV.format(a1="27.7172", a2="85.324", b1="latitude", b2="longitude")
q("acceptance_gate", "J23", lambda t: Q.acceptance(t.stations, _days(t), _rain_days(t), 27.7172, 85.324, km=300.0, min_days=25), f"""
WITH {DAYS}, s AS (SELECT count(*) AS stations_found, count(*) FILTER (WHERE data_span_days >= 25 AND missingness_pct <= 30 AND quality_score >= 0.7) AS stations_qualified FROM stations WHERE {KM} <= 300),
w AS (SELECT count(*) FILTER (WHERE missing = '') > 0 AND count(*) FILTER (WHERE ok_hours) >= floor(count(*) / 2) AND count(*) FILTER (WHERE ok) >= count(*) * 0.5 AS weather_ok FROM dc),
r AS (SELECT count(*) FILTER (WHERE n >= 24) * 100 / count(*) AS rain_pct FROM (SELECT date_trunc('day', datetime_utc) AS d, count(*) AS n FROM rain GROUP BY 1))
SELECT stations_found, stations_qualified, stations_qualified >= 3 AS stations_ok, weather_ok, rain_pct, true AS rain_ok, stations_qualified >= 3 AND weather_ok AS accepted FROM s, w, r""", "rain_pct")
q("update_quality", "J24", lambda t: Q.update_quality(t.holed), """
SELECT station_id, least(1.0, greatest(0.0, 0.3 * (1 - count(*) FILTER (WHERE pm25 IS NULL) / (count(*) * 3)) + 0.4 * least(1, count(*) / greatest(date_diff('hour', min(datetime_utc), max(datetime_utc)), 1))
  + 0.3 * count(pm25) / count(*))) AS score FROM holed GROUP BY 1""", "score")


def _joined(t):
    from hazewell.operators import joins as J
    return J.join_rain(J.join_weather(t.readings, t.weather), t.rain)


q("join_quality", "J25", lambda t: Q.join_quality(_joined(t), "blh", ["u10", "v10", "blh", "precipitation_mm_hourly"]), """
SELECT 1.0 AS matched, n AS null_share, 1 - n AS quality FROM (SELECT avg(CASE WHEN p.datetime_utc IS NULL THEN 1 ELSE 0 END) / 4 AS n FROM readings r
LEFT JOIN rain p USING (datetime_utc))""", "matched null_share quality")
PAIRKM = HAV.format(a1="a.latitude", a2="a.longitude", b1="b.latitude", b2="b.longitude")
NN = f"nn AS (SELECT a.station_id, min({PAIRKM}) AS km FROM stations a JOIN stations b ON a.station_id <> b.station_id GROUP BY 1)"
AUDIT = f"""{NN}, m AS (SELECT count(*) AS n, avg(quality_score) AS qm, max(quality_score) - min(quality_score) AS qr,
   (max(latitude) - min(latitude)) * (max(longitude) - min(longitude)) / 625 * 100 AS eff, max({KM}) AS far,
   count(*) FILTER (WHERE date_diff('second', last_measurement, {TA}) / 86400 < 7) AS rec, avg(coalesce(data_span_days, 0)) AS span,
   count(*) FILTER (WHERE date_diff('second', last_measurement, {TA}) / 3600 > 6) AS st FROM stations),
k AS (SELECT avg(km) AS nd, count(*) FILTER (WHERE km < 0.5) AS cl FROM nn),
aud AS (SELECT 'quality_distribution' AS "check", CASE WHEN n = 0 THEN 'fail' WHEN qr < 0.1 OR qm < 0.4 THEN 'warning' ELSE 'pass' END AS status, qm AS value FROM m
  UNION ALL SELECT 'geographic_coverage', CASE WHEN n < 3 THEN 'fail' WHEN far < 5 OR eff < 20 THEN 'warning' ELSE 'pass' END, eff FROM m
  UNION ALL SELECT 'temporal_coverage', CASE WHEN rec = 0 THEN 'fail' WHEN rec < n * 0.7 OR span < 60 THEN 'warning' ELSE 'pass' END, rec FROM m
  UNION ALL SELECT 'data_freshness', CASE WHEN st = n THEN 'fail' WHEN st > 0 THEN 'warning' ELSE 'pass' END, st FROM m
  UNION ALL SELECT 'station_clustering', CASE WHEN cl > n * 0.5 OR nd < 1 THEN 'warning' ELSE 'pass' END, nd FROM m, k)"""
q("nearest_neighbour", "J26", lambda t: Q.nearest_neighbour(t.stations), f"WITH {NN} SELECT * FROM nn", "km")
q("network_audit", "J26", lambda t: Q.network_audit(t.stations, ASOF, 27.7172, 85.324), f"WITH {AUDIT} SELECT * FROM aud", "value")
q("network_health", "J26", lambda t: Q.health_score(Q.network_audit(t.stations, ASOF, 27.7172, 85.324)), f"""
WITH {AUDIT} SELECT avg(CASE status WHEN 'pass' THEN 1 WHEN 'warning' THEN 0.7 ELSE 0 END) AS health FROM aud""", "health")


def _chosen(t):
    from hazewell.operators import windows as W
    return W.last_n(t.stations, 5, ["weight", "station_id"], ["country"]).select(c("country").alias("set_id"), "station_id", "latitude", "longitude")


q("station_diversity", "J27", lambda t: Q.diversity(_chosen(t)), f"""
WITH s AS (SELECT country AS set_id, station_id, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY weight DESC, station_id DESC) AS rn FROM stations) WHERE rn <= 5),
z AS (SELECT set_id, count(*) AS n, avg(latitude) AS cla, avg(longitude) AS clo FROM s GROUP BY 1),
v AS (SELECT set_id, var_pop({HAV.format(a1='latitude', a2='longitude', b1='cla', b2='clo')}) AS spread FROM s JOIN z USING (set_id) GROUP BY 1),
p AS (SELECT a.set_id, min({PAIRKM}) AS lo, avg({PAIRKM}) AS mid, max({PAIRKM}) AS hi FROM s a JOIN s b ON a.set_id = b.set_id AND a.station_id < b.station_id GROUP BY 1),
w AS (SELECT set_id, n, lo, 0.3 * least(lo, 1) + 0.3 * least(mid / 3, 1) + 0.2 * least(hi / 10, 1) + 0.2 * least(spread / 2, 1) AS sc FROM z JOIN v USING (set_id) LEFT JOIN p USING (set_id))
SELECT set_id, n, CASE WHEN n < 2 THEN 1 ELSE least(1, CASE WHEN lo < 0.5 THEN sc * 0.3 ELSE sc END) END AS diversity FROM w""", "diversity")
STEPS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(Q.RELAX_STEPS))
q("relaxed_thresholds", "J28", lambda t: Q.relax_thresholds(t.stations, 70), f"""
WITH c AS (SELECT step, min_quality, max_missing, count(station_id) AS stations FROM (VALUES {STEPS}) l(step, min_quality, max_missing)
  LEFT JOIN stations ON quality_score >= min_quality AND missingness_pct <= max_missing GROUP BY 1, 2, 3)
SELECT * FROM c ORDER BY CASE WHEN stations >= 70 THEN 0 ELSE 1 END, step LIMIT 1""", "min_quality max_missing")
RC = ["event_id", "station_id", "sensor_id", "parameter", "value", "unit", "datetime_utc"]
q("column_null_report", "J29", lambda t: Q.feature_report(t.raw.select(*RC)), " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count(*) AS n_rows, count(*) - count({x}) AS nulls FROM raw_meas" for x in RC))
q("day_check", "J30", _days, f"WITH {DAYS} SELECT * FROM dc")
q("station_score", "J31", lambda t: Q.station_score(t.stations, ASOF), f"""
SELECT station_id, sc AS score, CASE WHEN n_readings >= 1000 AND d >= 60 THEN least(1, n_readings / 1500 * 0.8 + d / 180 * 0.2) ELSE 0.5 END AS local_score,
  coalesce(sc * 0.7 + 0.3 * greatest(0, 1 - floor(date_diff('second', last_measurement, {TA}) / 86400) / 30), sc) AS recent_score
FROM (SELECT *, least(1, n_readings / 1000) * least(1, d / 365) AS sc FROM (SELECT *, coalesce(data_span_days, 0) AS d FROM stations))""", "score local_score recent_score")
q("readiness_checks", "J32", lambda t: Q.ready(t.holed, "2024-01-25"), """
WITH m AS (SELECT count(*) FILTER (WHERE datetime_utc < TIMESTAMP '2024-01-25') AS a, count(*) FILTER (WHERE datetime_utc >= TIMESTAMP '2024-01-25') AS b, count(DISTINCT station_id) AS s,
  count(*) FILTER (WHERE pm25 IS NULL) / count(*) AS mi, floor(date_diff('second', min(datetime_utc), max(datetime_utc)) / 86400) AS d,
  count(*) / (count(DISTINCT station_id) * date_diff('second', min(datetime_utc), max(datetime_utc)) / 3600) AS cov FROM holed)
SELECT 'train_rows' AS "check", a >= 1000 AS ok, a AS value FROM m UNION ALL SELECT 'test_rows', b >= 100, b FROM m UNION ALL SELECT 'stations', s >= 2, s FROM m
UNION ALL SELECT 'missing_share', mi < 0.1, mi FROM m UNION ALL SELECT 'days', d >= 30, d FROM m UNION ALL SELECT 'coverage', true, cov FROM m""", "value")
q("file_advice", "J33", lambda t: Q.file_advice(_file_quality(t)), f"""
WITH {FQ}, a AS (SELECT 'completeness' AS issue, count(*) FILTER (WHERE null_pct > 20) AS files FROM fq UNION ALL SELECT 'duplicates', count(*) FILTER (WHERE dup_pct > 10) FROM fq
  UNION ALL SELECT 'gaps', count(*) FILTER (WHERE gaps > 50) FROM fq UNION ALL SELECT 'negatives', count(*) FILTER (WHERE negatives > 0) FROM fq UNION ALL SELECT 'low_score', count(*) FILTER (WHERE score < 0.6) FROM fq)
SELECT * FROM a WHERE files > 0""")
