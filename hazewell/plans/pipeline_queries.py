"""Queries of the composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.plans import pipeline as B
from hazewell.plans.registry import query as q
from hazewell.plans.scalar_queries import AQI_SQL
from hazewell.plans.window_queries import OVER, need, tail

c = F.col
SHOWN = ["lag_pm25_1", "mean_24_pm25", "slope_6", "cal_dow", "hour_sin", "lag_blh_3", "std_6_wind_speed", "shear_1", "consistency_12", "range_24", "wind_class", "heat_index",
         "ventilation", "aqi_index", "aqi_category", "topo_cold_pool", "precipitation_mm_hourly"]

q("category_hours", "A1 D3 E2 H16 I7", lambda t: B.category_hours(t.readings), f"""
SELECT station_id, CASE WHEN a IS NULL OR a <= 0 THEN 'nan' WHEN a <= 50 THEN 'Good' WHEN a <= 100 THEN 'Moderate' WHEN a <= 150 THEN 'USG' WHEN a <= 200 THEN 'Unhealthy'
  WHEN a <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS category, count(*) AS hours
FROM (SELECT station_id, CASE WHEN x IS NOT NULL THEN {AQI_SQL.format(p4=50)} END AS a FROM (SELECT station_id, {need('pm25', 24, 12, f'avg(pm25) {tail(24)}', 'x')} FROM readings)) GROUP BY 1, 2""")
q("feature_table", "E1 E2 E3 H4 I1 I7 C1 C2", lambda t: B.build_features(t.readings, t.weather, t.rain).select("station_id", "datetime_utc", *SHOWN), f"""
SELECT station_id, datetime_utc, lag(pm25) OVER {OVER} AS lag_pm25_1, {need('pm25', 24, 12, f'avg(pm25) {tail(24)}', 'mean_24_pm25')},
  {need('pm25', 6, 3, f'regr_slope(pm25, rn) {tail(6)}', 'slope_6')}, isodow(datetime_utc) - 1 AS cal_dow, sin(2 * pi() * hour(datetime_utc) / 24) AS hour_sin, lag(blh, 3) OVER {OVER} AS lag_blh_3,
  {need('wind_speed', 6, 3, f'stddev_samp(wind_speed) {tail(6)}', 'std_6_wind_speed')}, wind_speed - lag(wind_speed) OVER {OVER} AS shear_1,
  {need('wind_direction', 12, 6, f'sqrt(pow(avg(sin(radians(wind_direction))) {tail(12)}, 2) + pow(avg(cos(radians(wind_direction))) {tail(12)}, 2))', 'consistency_12')},
  {need('t2m_celsius', 24, 6, f'max(t2m_celsius) {tail(24)} - min(t2m_celsius) {tail(24)}', 'range_24')},
  CASE WHEN wind_speed <= 1 THEN 'calm' WHEN wind_speed <= 3 THEN 'light' WHEN wind_speed <= 5 THEN 'gentle' WHEN wind_speed <= 8 THEN 'moderate' WHEN wind_speed <= 12 THEN 'fresh' ELSE 'strong' END AS wind_class,
  CASE WHEN t2m_celsius > 20 THEN t2m_celsius + 0.1 * (t2m_celsius - 20) * (t2m_celsius - 20) ELSE t2m_celsius END AS heat_index, wind_speed * blh AS ventilation, a AS aqi_index,
  CASE WHEN a <= 0 THEN 'nan' WHEN a <= 50 THEN 'Good' WHEN a <= 100 THEN 'Moderate' WHEN a <= 150 THEN 'USG' WHEN a <= 200 THEN 'Unhealthy' WHEN a <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS aqi_category,
  CASE WHEN blh < 300 AND t2m_celsius < 15 THEN 1 ELSE 0 END AS topo_cold_pool, precipitation_mm_hourly
FROM (SELECT *, {AQI_SQL.format(p4=50)} AS a FROM (SELECT met.*, pm25 AS x, precipitation_mm_hourly, row_number() OVER {OVER.replace('datetime_utc', 'met.datetime_utc')} AS rn FROM met LEFT JOIN rain ON rain.datetime_utc = met.datetime_utc))""",
  "lag_pm25_1 mean_24_pm25 slope_6 hour_sin lag_blh_3 std_6_wind_speed shear_1 consistency_12 range_24 heat_index ventilation aqi_index precipitation_mm_hourly")
q("selected_features", "K2 K3 K5 K6 K7", lambda t: B.select_features(
    B.build_features(t.readings, t.weather, t.rain, domain=False), ["wind_speed", "t2m_celsius", "heat_index", "lag_pm25_1", "mean_6_pm25", "mean_12_pm25", "cal_year", "is_monsoon"]
).select("station_id", "datetime_utc", "wind_speed", "lag_pm25_1", "mean_6_pm25", "mean_12_pm25"), f"""
SELECT station_id, datetime_utc, wind_speed, lag(pm25) OVER {OVER} AS lag_pm25_1, {need('pm25', 6, 3, f'avg(pm25) {tail(6)}', 'mean_6_pm25')}, {need('pm25', 12, 6, f'avg(pm25) {tail(12)}', 'mean_12_pm25')} FROM met""",
  "wind_speed lag_pm25_1 mean_6_pm25 mean_12_pm25")
