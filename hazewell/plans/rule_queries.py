"""Queries of the domain rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.functions import rules as R
from hazewell.functions import scalars as S
from hazewell.operators import windows as W
from hazewell.plans.registry import query as q
from hazewell.plans.scalar_queries import AQI_SQL, KEY, pick


def ts():
    return F.col("datetime_utc")

c = F.col


def b(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {name}"


def flags_sql(src: str, pairs: list[tuple[str, str]], keys: str = "station_id, datetime_utc") -> str:
    return f"SELECT {keys}, " + ", ".join(b(cond, n) for n, cond in pairs) + f" FROM {src}"


LOCAL = """(SELECT *, hour(datetime_utc + INTERVAL 345 MINUTE) AS h, isodow(datetime_utc + INTERVAL 345 MINUTE) - 1 AS d,
  month(datetime_utc + INTERVAL 345 MINUTE) AS m FROM {src})"""

q("wind_speed_class", "I1", lambda t: t.met.select(*KEY, R.wind_class(c("wind_speed")).alias("cls")), """
SELECT station_id, datetime_utc, CASE WHEN wind_speed < 0 OR wind_speed IS NULL THEN 'nan' WHEN wind_speed <= 1 THEN 'calm' WHEN wind_speed <= 3 THEN 'light'
  WHEN wind_speed <= 5 THEN 'gentle' WHEN wind_speed <= 8 THEN 'moderate' WHEN wind_speed <= 12 THEN 'fresh' ELSE 'strong' END cls FROM met""")
q("wind_sector", "I2", lambda t: t.met.select(*KEY, R.wind_sector(c("wind_direction")).alias("sector")), """
SELECT station_id, datetime_utc, CAST(floor((wind_direction + 11.25) / 22.5) AS BIGINT) % 16 sector FROM met""")
q("temperature_class", "I3", lambda t: t.met.select(*KEY, R.temp_class(c("t2m_celsius")).alias("cls")), """
SELECT station_id, datetime_utc, CASE WHEN t2m_celsius <= 5 THEN 'cold' WHEN t2m_celsius <= 15 THEN 'cool' WHEN t2m_celsius <= 25 THEN 'mild'
  WHEN t2m_celsius <= 35 THEN 'warm' ELSE 'hot' END cls FROM met""")
q("stability_class", "I4", lambda t: t.met.select(*KEY, R.stability_class(c("wind_speed"), ts()).alias("cls")), """
SELECT station_id, datetime_utc, CASE WHEN wind_speed < 2 THEN CASE WHEN hour(datetime_utc) BETWEEN 6 AND 18 THEN 'unstable' ELSE 'stable' END
  WHEN wind_speed <= 5 THEN CASE WHEN hour(datetime_utc) BETWEEN 6 AND 18 THEN 'neutral_unstable' ELSE 'neutral_stable' END ELSE 'neutral' END cls FROM met""")
q("boundary_layer_class", "I5", lambda t: t.met.select(*KEY, R.bl_class(c("blh")).alias("cls")), """
SELECT station_id, datetime_utc, CASE WHEN blh <= 0 THEN 'nan' WHEN blh <= 200 THEN 'very_low' WHEN blh <= 500 THEN 'low' WHEN blh <= 1000 THEN 'moderate'
  WHEN blh <= 2000 THEN 'high' ELSE 'very_high' END cls FROM met""")
q("weather_patterns", "I6", lambda t: pick(
    W.diffs(t.met, "t2m_celsius", [6], "warming"), R.weather_patterns(c("t2m_celsius"), c("wind_speed"), c("warming_6"), ts())),
  flags_sql("(SELECT *, t2m_celsius - lag(t2m_celsius, 6) OVER (PARTITION BY station_id ORDER BY datetime_utc) AS w6 FROM met)", [
      ("hot_calm", "t2m_celsius > 25 AND wind_speed < 2"), ("cold_windy", "t2m_celsius < 15 AND wind_speed > 5"),
      ("inversion", "w6 > 0 AND wind_speed < 1.5 AND hour(datetime_utc) < 10")]))
q("aqi_category", "I7", lambda t: pick(t.readings, R.aqi_category(S.aqi(c("pm25")), c("pm25"))), f"""
SELECT station_id, datetime_utc, CASE WHEN a <= 0 THEN 'nan' WHEN a <= 50 THEN 'Good' WHEN a <= 100 THEN 'Moderate' WHEN a <= 150 THEN 'USG'
   WHEN a <= 200 THEN 'Unhealthy' WHEN a <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END category,
   {b('a <= 50', 'risk_low')}, {b('a > 50 AND a <= 100', 'risk_moderate')}, {b('a > 150', 'risk_high')}, {b('x > 15', 'over_daily')}, {b('x > 5', 'over_annual')}
FROM (SELECT *, {AQI_SQL.format(p4=50)} AS a FROM (SELECT *, pm25 AS x FROM readings))""")
q("emission_proxies", "I8", lambda t: pick(t.readings, R.emission_flags(ts())), flags_sql(LOCAL.format(src="readings"), [
    ("traffic_morning", "h BETWEEN 7 AND 10 AND d < 5"), ("traffic_evening", "h BETWEEN 17 AND 20 AND d < 5"),
    ("traffic_weekend", "h BETWEEN 10 AND 18 AND d >= 5"), ("industrial", "h BETWEEN 8 AND 18 AND d < 5"),
    ("cooking_morning", "h BETWEEN 6 AND 9"), ("cooking_evening", "h BETWEEN 18 AND 21"),
    ("heating_winter", "m IN (11, 12, 1, 2) AND (h >= 18 OR h <= 7)"), ("crop_burning", "m IN (3, 4, 5) AND h BETWEEN 10 AND 15")]))
q("pasquill_class", "I9", lambda t: t.met.select(*KEY, R.pasquill_class(c("wind_speed"), ts()).alias("cls")), """
SELECT station_id, datetime_utc, CASE WHEN s > 5 THEN 4 WHEN s BETWEEN 3 AND 5 THEN 4 WHEN s BETWEEN 2 AND 3 AND h NOT BETWEEN 6 AND 18 THEN 5
  WHEN s BETWEEN 2 AND 3 THEN 2 WHEN s < 2 AND h NOT BETWEEN 6 AND 18 THEN 6 WHEN s < 2 AND h BETWEEN 10 AND 16 THEN 1 ELSE 4 END cls
FROM (SELECT *, wind_speed AS s, hour(datetime_utc) AS h FROM met)""")
q("regional_seasons", "I10", lambda t: pick(t.readings, R.regional_seasons(ts())), flags_sql(LOCAL.format(src="readings"), [
    ("pre_monsoon", "m IN (3, 4, 5)"), ("monsoon", "m IN (6, 7, 8, 9)"), ("post_monsoon", "m IN (10, 11)"), ("winter", "m IN (12, 1, 2)"),
    ("festival", "m IN (9, 10, 11)"), ("planting", "m IN (5, 6, 7)"), ("harvest", "m IN (10, 11, 12)"), ("burning", "m IN (3, 4, 5, 10, 11)")]))
q("topographic_effects", "I11", lambda t: pick(t.met, R.topo_flags(c("wind_direction"), c("wind_speed"), c("blh"), c("t2m_celsius"), ts())),
  flags_sql(LOCAL.format(src="met"), [
    ("valley_breeze", "h BETWEEN 8 AND 16 AND wind_direction BETWEEN 135 AND 225"),
    ("mountain_breeze", "(h >= 18 OR h <= 6) AND (wind_direction >= 315 OR wind_direction <= 45)"),
    ("cold_pool", "blh < 300 AND t2m_celsius < 15"),
    ("channelling", "wind_speed > 2 AND (wind_direction >= 315 OR wind_direction <= 45 OR wind_direction BETWEEN 135 AND 225)")]))
q("daily_patterns", "I12", lambda t: pick(t.readings, R.daily_patterns(ts())), flags_sql(LOCAL.format(src="readings"), [
    ("morning_peak", "h IN (7, 8, 9, 10)"), ("evening_peak", "h IN (18, 19, 20, 21)"), ("quiet_night", "h <= 6"), ("weekday_pattern", "d < 5"),
    ("weekend_pattern", "d >= 5"), ("school_hours", "d < 5 AND (h BETWEEN 6 AND 8 OR h BETWEEN 15 AND 17 OR h BETWEEN 10 AND 15)")]))
q("threshold_flags", "I13", lambda t: pick(t.met, R.threshold_flags(c("pm25"), c("wind_speed"), c("blh"), c("t2m_celsius"))), flags_sql("met", [
    ("pm_daily", "pm25 > 15"), ("pm_annual", "pm25 > 5"), ("pm_unhealthy", "pm25 > 55.4"), ("pm_very_unhealthy", "pm25 > 150.4"),
    ("pm_hazardous", "pm25 > 250.4"), ("wind_low", "wind_speed < 1.5"), ("wind_very_low", "wind_speed < 0.5"), ("blh_low", "blh < 200"),
    ("blh_very_low", "blh < 100"), ("hot", "t2m_celsius > 30"), ("cold", "t2m_celsius < 10"), ("stagnant", "wind_speed < 1.5 AND blh < 300")]))
q("urban_heat_class", "I14", lambda t: t.met.select(*KEY, R.uhi_class(F.greatest(F.lit(0.0), c("t2m_celsius") - 22)).alias("cls")), """
SELECT station_id, datetime_utc, CASE WHEN t2m_celsius <= 22 THEN 'nan' WHEN t2m_celsius <= 24 THEN 'None' WHEN t2m_celsius <= 27 THEN 'Weak'
  WHEN t2m_celsius <= 30 THEN 'Moderate' ELSE 'Strong' END cls FROM met""")
q("regressor_dummies", "I15", lambda t: pick(t.met, R.regressor_dummies(c("wind_speed"), c("t2m_celsius"), ts())), flags_sql(
  "(SELECT *, isodow(datetime_utc) - 1 AS d, hour(datetime_utc) AS h, month(datetime_utc) AS m FROM met)",
  [("wind_calm", "wind_speed < 2"), ("wind_light", "wind_speed >= 2 AND wind_speed < 5"), ("wind_moderate", "wind_speed >= 5 AND wind_speed < 10"),
   ("wind_strong", "wind_speed >= 10"), ("temp_cold", "t2m_celsius < 10"), ("temp_mild", "t2m_celsius >= 10 AND t2m_celsius < 25"),
   ("temp_warm", "t2m_celsius >= 25"), ("weekend", "d >= 5"), ("in_winter", "m IN (12, 1, 2)"), ("in_spring", "m IN (3, 4, 5)"),
   ("in_summer", "m IN (6, 7, 8)"), ("in_autumn", "m IN (9, 10, 11)")]
  + [(f"dow_{i}", f"d = {i}") for i in range(7)] + [(f"hour_{i}", f"h = {i}") for i in (6, 7, 8, 9, 17, 18, 19, 20)]
  + [(f"month_{i}", f"m = {i}") for i in range(1, 13)]))
q("holiday_flags", "I16", lambda t: t.table("orders").select(c("o_orderkey"), *[v.alias(k) for k, v in R.holiday_cols(c("o_orderdate")).items()]), """
SELECT *, holiday_dashain + holiday_tihar + holiday_new_year + holiday_republic_day + holiday_constitution_day + holiday_independence_day AS is_holiday FROM (""" +
  flags_sql("(SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)", [
    ("holiday_dashain", "m = 9 AND d BETWEEN 15 AND 24"), ("holiday_tihar", "m = 10 AND d BETWEEN 8 AND 12"), ("holiday_new_year", "m = 1 AND d = 1"),
    ("holiday_republic_day", "m = 5 AND d = 29"), ("holiday_constitution_day", "m = 9 AND d = 20"), ("holiday_independence_day", "m = 8 AND d = 15")],
    "o_orderkey") + ")")
q("cross_border_index", "I17", lambda t: W.border_table(t.readings).select("datetime_utc", *[
    v.alias(k) for k, v in R.cross_border(c("south"), c("north"), c("south_lag"), c("north_lag"), ts()).items()]), """
SELECT datetime_utc, w AS season_weight, south * w AS south_seasonal, north * w AS north_seasonal, 0.6 * south + 0.4 * north AS border_index,
  0.7 * south_lag + 0.3 * north_lag AS transport_potential, south - north AS gradient
FROM (SELECT a.datetime_utc, CASE WHEN month(a.datetime_utc) IN (12, 1, 2) THEN 0.8 WHEN month(a.datetime_utc) IN (3, 4, 5) THEN 0.6
        WHEN month(a.datetime_utc) IN (6, 7, 8) THEN 0.4 ELSE 0.7 END w, a.pm25 AS south, b.pm25 AS north,
        coalesce(sa.pm25, 0) AS south_lag, coalesce(sb.pm25, 0) AS north_lag
      FROM readings a JOIN readings b ON a.station_id = 1 AND b.station_id = 2 AND a.datetime_utc = b.datetime_utc
      LEFT JOIN readings sa ON sa.station_id = 1 AND sa.datetime_utc = a.datetime_utc - INTERVAL 24 HOUR
      LEFT JOIN readings sb ON sb.station_id = 2 AND sb.datetime_utc = a.datetime_utc - INTERVAL 24 HOUR)""",
  "season_weight south_seasonal north_seasonal border_index transport_potential gradient")
q("feature_families", "I18", lambda t: t.table("part").select(F.concat(
    F.element_at(F.array(*map(F.lit, ["lag_", "met_rolling_", "calendar_", "seasonal_", "bl_", "trend_", "raw_"])), (c("p_partkey") % 7 + 1).cast("int")),
    c("p_partkey").cast("string")).alias("name")).groupBy(R.feature_family(c("name")).alias("family")).agg(F.count("*").alias("n")), """
SELECT CASE p_partkey % 7 WHEN 0 THEN 'lag' WHEN 1 THEN 'rolling' WHEN 2 THEN 'calendar' WHEN 3 THEN 'cyclical' WHEN 4 THEN 'meteorological'
  WHEN 5 THEN 'temporal' ELSE 'other' END family, count(*) n FROM part GROUP BY 1""")
