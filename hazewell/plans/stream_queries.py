"""Queries of the streaming operators, checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.plans.registry import query as q
from hazewell.sources.adapters import GAIN, station_code
from hazewell.streaming import streams as X

c = F.col


def _events(t):
    return X.event_stream(t.spark, t.folder).withColumn("station_id", station_code(c("event_type")))


def _scaled(t):
    return _events(t).withColumn("value", c("value") / GAIN)


WM = "(SELECT max(ts) - INTERVAL 1 HOUR FROM ev)"
q("stream_hourly", "ST1", lambda t: X.run_to_table(X.stream_hourly(_scaled(t)), "hourly"), f"""
SELECT station AS station_id, hour_ts AS datetime_utc, avg(value / CAST(1.0007 AS DOUBLE)) AS pm25, count(*) AS n FROM ev WHERE hour_ts + INTERVAL 1 HOUR <= {WM} GROUP BY 1, 2""", "pm25")
q("stream_rolling", "ST2", lambda t: X.run_to_table(X.stream_rolling(_scaled(t)), "rolling"), f"""
SELECT station AS station_id, hour_ts - i * INTERVAL 1 HOUR AS window_start, avg(value / CAST(1.0007 AS DOUBLE)) AS mean_24 FROM ev, range(0, 24) r(i) WHERE hour_ts + (24 - i) * INTERVAL 1 HOUR <= {WM} GROUP BY 1, 2""", "mean_24")
q("stream_sessions", "ST3", lambda t: X.run_to_table(X.stream_sessions(_events(t)), "sessions"), f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM ev),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= {WM}""")
q("stream_enrich", "ST4", lambda t: X.run_to_table(X.stream_enrich(_events(t), t.weather), "enrich"), """
SELECT event_id, station AS station_id, ts, value, t2m_celsius, blh FROM ev LEFT JOIN weather ON datetime_utc = hour_ts""", "value t2m_celsius blh")
q("stream_verify", "ST5", lambda t: X.run_to_table(X.stream_verify(_events(t).filter("event_type = 'signup'"), _events(t).filter("event_type = 'view'"), 12), "verify"), """
SELECT f.event_id AS forecast_id, o.event_id, o.user_id, f.value AS yhat, o.value AS y, o.value - f.value AS err FROM ev f JOIN ev o ON f.user_id = o.user_id AND f.event_type = 'signup' AND o.event_type = 'view'
 AND o.ts >= f.ts AND o.ts <= f.ts + INTERVAL 12 HOUR""", "yhat y err")
q("stream_dedupe", "ST6", lambda t: X.run_to_table(X.stream_dedupe(
    _events(t).withColumn("hour", F.date_trunc("hour", "ts")), ["station_id", "hour"]), "dedupe").select("station_id", "hour"), """
SELECT DISTINCT station AS station_id, hour_ts AS hour FROM ev""")
q("stream_alerts", "ST7", lambda t: X.run_to_end(lambda e: X.stream_alerts(e, cooldown_minutes=720), _events(t), "alerts"), """
WITH RECURSIVE a AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev WHERE value >= 55),
r AS (SELECT user_id, i, event_id, ts, value, ts AS last, true AS sent FROM a WHERE i = 1
  UNION ALL SELECT a.user_id, a.i, a.event_id, a.ts, a.value, CASE WHEN a.ts - r.last >= INTERVAL 12 HOUR THEN a.ts ELSE r.last END, a.ts - r.last >= INTERVAL 12 HOUR FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1)
SELECT user_id, event_id, ts, value FROM r WHERE sent""", "value")
q("stream_stale", "ST8", lambda t: X.run_to_end(X.stream_stale, _events(t), "stale"), f"""
SELECT user_id, ts AS stale_since FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM ev)
WHERE nx - ts > INTERVAL 2 HOUR OR (nx IS NULL AND ts + INTERVAL 2 HOUR < {WM})""")
q("stream_bias", "ST9", lambda t: X.last_rows(X.run_to_end(X.stream_bias, _events(t), "bias"), ["station_id", "hour"]), """
WITH RECURSIVE a AS (SELECT station, hour(ts) AS hour, value, row_number() OVER (PARTITION BY station, hour(ts) ORDER BY ts, event_id) AS i FROM ev),
e AS (SELECT station, hour, i - 1 AS i, avg(d) OVER (PARTITION BY station, hour ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m
  FROM (SELECT *, value - lag(value) OVER (PARTITION BY station, hour ORDER BY i) AS d FROM a) WHERE i > 1),
k AS (SELECT station, hour, count(*) - 1 AS n FROM a GROUP BY 1, 2),
r AS (SELECT station, hour, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS bias FROM k
  UNION ALL SELECT r.station, r.hour, e.i, CASE WHEN e.i >= 24 THEN least(10, greatest(-10, bias + least(0.8, greatest(-0.8, 0.1 * (m - bias))))) ELSE bias END
  FROM r JOIN e ON e.station = r.station AND e.hour = r.hour AND e.i = r.i + 1)
SELECT r.station AS station_id, r.hour, n, bias FROM r JOIN k ON k.station = r.station AND k.hour = r.hour AND k.n = r.i""", "bias")
q("stream_conformal", "ST10", lambda t: X.last_rows(X.run_to_end(X.stream_conformal, _events(t), "conformal"), ["station_id"]), """
WITH RECURSIVE a AS (SELECT station, abs(value - 50) AS s, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS i FROM ev), k AS (SELECT station, max(i) AS n FROM a GROUP BY 1),
r AS (SELECT station, i, s AS thr, CAST(0 AS BIGINT) AS inside FROM a WHERE i = 1
  UNION ALL SELECT r.station, a.i, CASE WHEN s > thr THEN thr + 0.45 ELSE thr - 0.05 END, inside + CASE WHEN s <= thr THEN 1 ELSE 0 END FROM r JOIN a ON a.station = r.station AND a.i = r.i + 1)
SELECT r.station AS station_id, n, thr AS threshold, inside / (n - 1) AS coverage FROM r JOIN k ON k.station = r.station AND k.n = r.i""", "threshold coverage")


q("stream_refresh", "ST11", lambda t: X.stream_refresh(_scaled(t)).select("station_id", "datetime_utc", "pm25"), "SELECT station AS station_id, hour_ts AS datetime_utc, avg(value / CAST(1.0007 AS DOUBLE)) AS pm25 FROM ev GROUP BY 1, 2", "pm25")
