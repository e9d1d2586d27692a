"""The derived tables of ``sources.adapters`` as SQL common table expressions."""

CTES = {
    "ev": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                    WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 6 END AS BIGINT) AS station,
               date_trunc('hour', ts) AS hour_ts
        FROM events""",
    "readings": """
        SELECT station AS station_id, hour_ts AS datetime_utc, avg(value) / CAST(1.0007 AS DOUBLE) AS pm25 FROM ev GROUP BY 1, 2""",
    "sparse": """
        SELECT user_id AS station_id, hour_ts AS datetime_utc, avg(value) / CAST(1.0007 AS DOUBLE) AS pm25 FROM ev GROUP BY 1, 2""",
    "holed": """
        SELECT station_id, datetime_utc, CASE WHEN pm25 >= 25 THEN pm25 END AS pm25 FROM readings""",
    "weather": """
        SELECT *, sqrt(u10 * u10 + v10 * v10) AS wind_speed,
               CASE WHEN degrees(atan2(v10, u10)) < 0 THEN degrees(atan2(v10, u10)) + 360
                     ELSE degrees(atan2(v10, u10)) END AS wind_direction
        FROM (SELECT hour_ts AS datetime_utc, avg(user_id % 100) / CAST(9.7 AS DOUBLE) - 5 AS u10,
                     avg(value) / CAST(9.7 AS DOUBLE) - 5 AS v10,
                     CAST(5 + (count(*) * 7) % 30 AS DOUBLE) AS t2m_celsius,
                     CAST(100 + 40 * count(*) AS DOUBLE) AS blh
              FROM ev GROUP BY 1)""",
    "met": """
        SELECT * FROM readings JOIN weather USING (datetime_utc)""",
    "rain_half": """
        SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS datetime_utc, avg(value) / CAST(49.3 AS DOUBLE) AS precipitation_mm_30min,
               count(*) AS valid_pixels, count(*) + 3 AS total_pixels
        FROM ev GROUP BY 1""",
    "rain": """
        SELECT date_trunc('hour', datetime_utc) AS datetime_utc, sum(precipitation_mm_30min) AS precipitation_mm_hourly,
               avg(valid_pixels) AS valid_pixels, avg(total_pixels) AS total_pixels
        FROM rain_half GROUP BY 1""",
    "raw_meas": """
        SELECT event_id, station AS station_id, user_id AS sensor_id,
               CASE k % 3 WHEN 0 THEN 'pm25' WHEN 1 THEN 'pm10' ELSE 'no2' END AS parameter,
               CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN -value WHEN k = 2 THEN value + 1000 ELSE value END AS value,
               'ug/m3' AS unit, hour_ts AS datetime_utc,
               round(CAST(27.7 AS DOUBLE) + station * CAST(0.01 AS DOUBLE), 4) AS latitude,
               round(CAST(85.3 AS DOUBLE) + station * CAST(0.01 AS DOUBLE), 4) AS longitude,
               CASE WHEN k % 10 = 0 THEN 'suspect' ELSE 'valid' END AS quality_flag,
               CASE WHEN k % 4 = 0 THEN 'synthetic' ELSE 'real' END AS data_source
        FROM ev""",
    "grid": """
        SELECT hour_ts AS "time", round(CAST(27.4 AS DOUBLE) + (user_id % 7) * CAST(0.1 AS DOUBLE), 4) AS latitude,
               round(CAST(84.8 AS DOUBLE) + (user_id % 9) * CAST(0.1 AS DOUBLE), 4) AS longitude,
               avg(value) / CAST(9.7 AS DOUBLE) - 5 AS u10, avg(k) / CAST(19.3 AS DOUBLE) - 2.5 AS v10,
               avg(value) / CAST(4.9 AS DOUBLE) + 280 AS t2m, avg(k) * CAST(9.7 AS DOUBLE) + 100 AS blh,
               CASE WHEN max(k) % 5 = 0 THEN CAST(-9999.9 AS DOUBLE) ELSE avg(value) / CAST(49.3 AS DOUBLE) END AS precipitation
        FROM ev GROUP BY 1, 2, 3""",
    "stations": """
        SELECT s_suppkey AS station_id, s_name AS name, n_name AS country,
               round(CAST(26.5 AS DOUBLE) + ((s_suppkey * 37) % 300) / 100, 4) AS latitude,
               round(CAST(80 AS DOUBLE) + ((s_suppkey * 53) % 800) / 100, 4) AS longitude,
               abs(s_acctbal) / 9973 AS weight,
               first_measurement, last_measurement, coalesce(n_readings, 0) AS n_readings,
               date_diff('day', first_measurement, last_measurement) AS data_span_days,
               100 * (1 - least(CAST(1 AS DOUBLE), coalesce(n_readings, 0) / 80)) AS missingness_pct,
               least(CAST(1 AS DOUBLE), coalesce(n_readings, 0) / 75) AS quality_score
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN (SELECT station_id AS sid, min(datetime_utc) AS first_measurement, max(datetime_utc) AS last_measurement,
                          count(*) AS n_readings FROM sparse GROUP BY 1) ON sid = s_suppkey""",
    "forecasts": """
        SELECT model, station_id, datetime_utc - horizon * INTERVAL 1 HOUR AS origin, horizon, datetime_utc AS target_ts,
               yhat, y
        FROM (SELECT *, CAST(CASE hour(datetime_utc) % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 24 END AS BIGINT) AS horizon FROM (
            SELECT 'persist' AS model, station_id, datetime_utc, pm25 AS y,
                   lag(pm25, 1) OVER (PARTITION BY station_id ORDER BY datetime_utc) AS yhat FROM readings
            UNION ALL
            SELECT 'daily', station_id, datetime_utc, pm25,
                   lag(pm25, 24) OVER (PARTITION BY station_id ORDER BY datetime_utc) FROM readings
            UNION ALL
            SELECT 'profile', station_id, datetime_utc, pm25, p
            FROM readings JOIN (SELECT station_id AS ps, hour(datetime_utc) AS ph, avg(pm25) AS p FROM readings GROUP BY 1, 2)
                 ON ps = station_id AND ph = hour(datetime_utc)))
        WHERE yhat IS NOT NULL""",
    "errors": """
        SELECT *, y - yhat AS err FROM forecasts""",
    "runs": """
        SELECT event_type AS job, event_id AS run_id, ts, k % 4 <> 0 AS ok, value AS seconds, k AS records FROM ev""",
    "alerts": """
        SELECT event_id AS alert_id, ts, station AS station_id, user_id,
               CASE WHEN value > 150 THEN 'critical' WHEN value > 55 THEN 'high' WHEN value > 35 THEN 'medium' ELSE 'low' END AS severity,
               CASE k % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'outlier' END AS category,
               k % 2 = 0 AS resolved, value
        FROM ev""",
    "lineage": """
        SELECT event_id, ts, CASE k % 4 WHEN 0 THEN 'extract' WHEN 1 THEN 'transform' WHEN 2 THEN 'validate' ELSE 'load' END AS kind,
               event_type AS source, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_event_id,
               station AS station_id, k AS record_count, value / 500 AS quality
        FROM ev""",
    "artifacts": """
        SELECT o_orderkey AS artifact_id, 'store/' || o_custkey AS path, o_orderstatus AS stage, o_orderpriority AS source,
               o_custkey % 50 AS station_id, o_totalprice AS size_bytes, o_orderkey % 1000 AS records,
               strftime(o_orderdate, '%Y-%m') AS partition, o_orderdate AS created
        FROM orders""",
    "locations": """
        SELECT user_id AS id, event_type AS parameter FROM (SELECT DISTINCT user_id, event_type FROM ev)""",
    "scores": """
        SELECT event_type AS method, 'f' || user_id AS feature, avg(value) / CAST(497 AS DOUBLE) AS score FROM ev GROUP BY 1, 2""",
    "users": """
        SELECT c_custkey AS user_id, c_custkey % 5 + 1 AS station_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'child' WHEN 'HOUSEHOLD' THEN 'elderly' ELSE 'adult' END AS age_group,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'asthma' WHEN 'MACHINERY' THEN 'heart_disease' ELSE 'none' END AS condition,
               CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'normal' END AS sensitivity,
               CASE WHEN c_acctbal < 2000 THEN 'active' ELSE 'calm' END AS activity,
               c_nationkey % 24 AS quiet_start, c_nationkey * 7 % 24 AS quiet_end,
               c_custkey % 2 = 0 AS email, c_custkey % 3 = 0 AS sms, c_custkey % 5 = 0 AS push
        FROM customer""",
    "outlook": """
        SELECT station_id, day, p[1] AS current, p[2:] AS path
        FROM (SELECT station_id, date_trunc('day', datetime_utc) AS day, list(pm25 ORDER BY datetime_utc) AS p FROM readings GROUP BY 1, 2)
        WHERE len(p) > 1""",
}
