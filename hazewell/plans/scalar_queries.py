"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.functions import scalars as S
from hazewell.operators import scalars_on as on
from hazewell.plans.registry import query as q


def ts():
    return F.col("datetime_utc")

c = F.col
KEY = ("station_id", "datetime_utc")


def pick(df, cols, keys=KEY):
    return df.select(*keys, *[v.alias(k) for k, v in cols.items()])


q("calendar_parts", "H1", lambda t: pick(t.readings, S.calendar_cols(ts())), """
SELECT station_id, datetime_utc, hour(datetime_utc) cal_hour, isodow(datetime_utc) - 1 cal_dow, day(datetime_utc) cal_day,
  dayofyear(datetime_utc) cal_doy, week(datetime_utc) cal_week, month(datetime_utc) cal_month,
  quarter(datetime_utc) cal_quarter, year(datetime_utc) cal_year FROM readings""")

q("calendar_flags", "H2", lambda t: pick(t.readings, S.calendar_flags(ts())), """
SELECT station_id, datetime_utc, CASE WHEN isodow(datetime_utc) >= 6 THEN 1 ELSE 0 END is_weekend,
  CASE WHEN day(datetime_utc) = 1 THEN 1 ELSE 0 END is_month_start,
  CASE WHEN day(datetime_utc + INTERVAL 1 DAY) = 1 THEN 1 ELSE 0 END is_month_end,
  CASE WHEN day(datetime_utc) = 1 AND month(datetime_utc) IN (1, 4, 7, 10) THEN 1 ELSE 0 END is_quarter_start,
  CASE WHEN day(datetime_utc + INTERVAL 1 DAY) = 1 AND month(datetime_utc) IN (3, 6, 9, 12) THEN 1 ELSE 0 END is_quarter_end
FROM readings""")

q("season_codes", "H3", lambda t: pick(t.readings, S.season_cols(ts())), """
SELECT station_id, datetime_utc,
  CASE WHEN month(datetime_utc) IN (12, 1, 2) THEN 0 WHEN month(datetime_utc) IN (3, 4, 5) THEN 1
       WHEN month(datetime_utc) IN (6, 7, 8) THEN 2 ELSE 3 END season,
  CASE WHEN month(datetime_utc) IN (6, 7, 8) THEN 1 ELSE 0 END is_monsoon,
  CASE WHEN month(datetime_utc) >= 10 OR month(datetime_utc) <= 5 THEN 1 ELSE 0 END is_dry FROM readings""")

q("cyclical_encoding", "H4", lambda t: pick(t.readings, S.cyclical_cols(ts())), """
SELECT station_id, datetime_utc, sin(2 * pi() * hour(datetime_utc) / 24) hour_sin, cos(2 * pi() * hour(datetime_utc) / 24) hour_cos,
  sin(2 * pi() * (isodow(datetime_utc) - 1) / 7) dow_sin, cos(2 * pi() * (isodow(datetime_utc) - 1) / 7) dow_cos,
  sin(2 * pi() * dayofyear(datetime_utc) / 365.25) doy_sin, cos(2 * pi() * dayofyear(datetime_utc) / 365.25) doy_cos,
  sin(2 * pi() * month(datetime_utc) / 12) month_sin, cos(2 * pi() * month(datetime_utc) / 12) month_cos FROM readings""",
  "hour_sin hour_cos dow_sin dow_cos doy_sin doy_cos month_sin month_cos")

q("seasonal_phase", "H5", lambda t: pick(on.with_start(t.readings), S.phase_cols(ts(), c("series_start"))), """
SELECT station_id, datetime_utc, sin(2 * pi() * (h % 24) / 24) phase_24_sin, cos(2 * pi() * (h % 24) / 24) phase_24_cos,
  sin(2 * pi() * (h % 168) / 168) phase_168_sin, cos(2 * pi() * (h % 168) / 168) phase_168_cos
FROM (SELECT *, date_diff('hour', (SELECT min(datetime_utc) FROM readings), datetime_utc) h FROM readings)""",
  "phase_24_sin phase_24_cos phase_168_sin phase_168_cos")

q("time_since_period", "H6", lambda t: pick(t.events, S.time_since_cols(c("ts")), ("event_id",)), """
SELECT event_id, (epoch_us(ts) // 1000000 - epoch(date_trunc('day', ts))) / 3600 since_day,
  (epoch_us(ts) // 1000000 - epoch(date_trunc('week', ts))) / 3600 since_week,
  (epoch_us(ts) // 1000000 - epoch(date_trunc('month', ts))) / 3600 since_month FROM ev""", "since_day since_week since_month")

q("local_time", "H7", lambda t: pick(t.readings, {"local_ts": S.to_local(ts()), "local_hour": F.hour(S.to_local(ts()))}), """
SELECT station_id, datetime_utc, datetime_utc + INTERVAL 345 MINUTE local_ts, hour(datetime_utc + INTERVAL 345 MINUTE) local_hour FROM readings""")

q("hour_rounding", "H8", lambda t: t.rain_half.select(c("datetime_utc"), S.round_hour(ts()).alias("rounded")).unionByName(
    t.events.select(c("ts").alias("datetime_utc"), S.round_hour(c("ts")).alias("rounded"))), """
SELECT ts AS datetime_utc, CASE WHEN ts - date_trunc('hour', ts) > INTERVAL 30 MINUTE
    OR (ts - date_trunc('hour', ts) = INTERVAL 30 MINUTE AND hour(ts) % 2 = 1)
  THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END rounded
FROM (SELECT ts FROM ev UNION ALL SELECT datetime_utc FROM rain_half)""")

q("wind_from_components", "H9", lambda t: t.grid.select("time", "latitude", "longitude", S.wind_speed(c("u10"), c("v10")).alias("speed"),
  S.wind_direction(c("u10"), c("v10")).alias("direction"), S.celsius(c("t2m")).alias("temp")), """
SELECT "time", latitude, longitude, sqrt(u10 * u10 + v10 * v10) speed,
  CASE WHEN atan2(v10, u10) < 0 THEN degrees(atan2(v10, u10)) + 360 ELSE degrees(atan2(v10, u10)) END direction, t2m - 273.15 temp FROM grid""",
  "latitude longitude speed direction temp")

q("weather_derived", "H10", lambda t: t.weather.select("datetime_utc", S.wind_direction(c("u10"), c("v10"), wrap=False).alias("direction"),
  (c("blh") * 100 / 100.0).alias("pressure_hpa"), S.relative_humidity(c("t2m_celsius"), c("t2m_celsius") - c("wind_speed")).alias("humidity")), """
SELECT datetime_utc, degrees(atan2(v10, u10)) direction, blh * 100 / 100 pressure_hpa,
  least(100.0, greatest(0.0, 100 * exp(17.67 * (t2m_celsius - wind_speed) / (t2m_celsius - wind_speed + 243.5))
        / exp(17.67 * t2m_celsius / (t2m_celsius + 243.5)))) humidity FROM weather""", "direction pressure_hpa humidity")

q("weather_indices", "H11", lambda t: pick(t.weather, S.weather_indices(c("t2m_celsius"), c("blh"), c("wind_speed"), ts()), ("datetime_utc",)), """
SELECT datetime_utc, t2m_celsius / (blh / 1000) temp_gradient, blh / (t2m_celsius + 273.15) stability_index,
  wind_speed * blh ventilation_index, 1 / (wind_speed * blh + 1) pollution_potential,
  CASE WHEN hour(datetime_utc) < 6 OR hour(datetime_utc) > 18 THEN 1 ELSE 0 END is_night,
  CASE WHEN hour(datetime_utc) >= 6 AND hour(datetime_utc) < 12 THEN 1 ELSE 0 END is_morning,
  CASE WHEN hour(datetime_utc) >= 12 AND hour(datetime_utc) < 18 THEN 1 ELSE 0 END is_afternoon FROM weather""",
  "temp_gradient stability_index ventilation_index pollution_potential")

q("comfort_indices", "H12", lambda t: pick(t.met, S.comfort(c("t2m_celsius"), c("wind_speed"))), """
SELECT station_id, datetime_utc, CASE WHEN t2m_celsius < 10 THEN 13.12 + 0.6215 * t2m_celsius - 11.37 * pow(3.6 * wind_speed, 0.16)
    + 0.3965 * t2m_celsius * pow(3.6 * wind_speed, 0.16) ELSE t2m_celsius END wind_chill,
  CASE WHEN t2m_celsius > 20 THEN t2m_celsius + 0.1 * (t2m_celsius - 20) * (t2m_celsius - 20) ELSE t2m_celsius END heat_index,
  t2m_celsius - 0.4 * (t2m_celsius - 10) * pow(3.6 * wind_speed / 10, 0.16) effective_temp FROM met""", "wind_chill heat_index effective_temp")

q("stability_indices", "H13", lambda t: pick(t.met, S.stability_cols(c("wind_speed"), c("blh"), c("v10"), ts())), """
SELECT station_id, datetime_utc, CASE WHEN wind_speed > 0 THEN v10 / (wind_speed * wind_speed + 0.1) ELSE 0 END richardson,
  wind_speed * ln(blh + 1) mixing_potential, wind_speed * blh ventilation,
  least(1.0, greatest(0.0, wind_speed / 10 + CASE WHEN hour(datetime_utc) BETWEEN 6 AND 18 THEN 0.3 ELSE -0.3 END + ln(blh + 1) / 10)) stability_indicator
FROM met""", "richardson mixing_potential ventilation stability_indicator")

q("pollution_potential", "H14", lambda t: pick(t.met, S.pollution_potential(c("wind_speed"), c("blh"), ts())), """
SELECT station_id, datetime_utc, ln(wind_speed + 0.1) * ln(blh + 1) / 10 dispersion_score,
  1 / (ln(wind_speed + 0.1) * ln(blh + 1) / 10 + 0.1) accumulation_score,
  CASE WHEN wind_speed < 2 AND blh < 500 THEN 1 ELSE 0 END stagnation,
  CASE WHEN hour(datetime_utc) IN (7, 8, 9, 17, 18, 19, 20) AND wind_speed < 3 THEN 1 ELSE 0 END traffic_alignment FROM met""",
  "dispersion_score accumulation_score")

q("dispersion_proxies", "H15", lambda t: pick(t.met, S.dispersion_cols(c("wind_speed"), c("blh"), c("t2m_celsius"), F.lit(4))), """
SELECT station_id, datetime_utc, 0.1 * sqrt(wind_speed + 0.1) * (4 / 4.0) sigma_y, 0.05 * sqrt(blh / 1000) * (6.0 / 4) sigma_z,
  least(blh * 0.8, 200) effective_height, greatest(0, 25 - t2m_celsius) * 2.0 plume_rise,
  wind_speed * ln(blh + 1) * (1.0 / 5) dispersion_potential FROM met""",
  "sigma_y sigma_z effective_height plume_rise dispersion_potential")

AQI_SQL = """CASE WHEN x <= 12 THEN x * 50 / 12 WHEN x <= 35.4 THEN 50 + (x - 12) * 50 / 23.4
  WHEN x <= 55.4 THEN 100 + (x - 35.4) * 50 / 20 WHEN x <= 150.4 THEN 150 + (x - 55.4) * {p4} / 95
  WHEN x <= 250.4 THEN 200 + (x - 150.4) * 100 / 100 ELSE 300 + (x - 250.4) * 100 / 100 END"""
q("aqi_index", "H16", lambda t: t.readings.select(*KEY, S.aqi(c("pm25")).alias("aqi"), S.aqi(c("pm25"), legacy=True).alias("aqi_legacy")), f"""
SELECT station_id, datetime_utc, {AQI_SQL.format(p4=50)} aqi, {AQI_SQL.format(p4=100)} aqi_legacy FROM (SELECT *, pm25 AS x FROM readings)""", "aqi aqi_legacy")

q("haversine_to_point", "H17", lambda t: t.stations.select("station_id", S.haversine(c("latitude"), c("longitude"), F.lit(27.7172), F.lit(85.324)).alias("km")), """
SELECT station_id, 2 * 6371 * asin(sqrt(pow(sin(radians(27.7172 - latitude) / 2), 2)
  + cos(radians(latitude)) * cos(radians(27.7172)) * pow(sin(radians(85.324 - longitude) / 2), 2))) km FROM stations""", "km")

HAV = """2 * 6371 * asin(sqrt(pow(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b2} - {a2}) / 2), 2)))"""
KM = HAV.format(a1="latitude", a2="longitude", b1="27.7172", b2="85.324")
q("distance_weights", "H18", lambda t: on.distance_weights(t.stations, 27.7172, 85.324), f"""
SELECT station_id, country, w / sum(w) OVER (PARTITION BY country) AS share FROM (
  SELECT station_id, country, CASE WHEN {KM} <= 2000 THEN weight / (1 + {KM} / 100) ELSE 0 END w FROM stations)""", "share")

q("pair_interactions", "H19", lambda t: on.interactions(t.met, "u10", "blh", KEY), """
SELECT station_id, datetime_utc, u10 * blh multiplicative, u10 / (blh + 1e-8) ratio, u10 - blh difference, u10 * u10 + blh * blh polynomial,
  coalesce(lr, (SELECT quantile_cont(lr, 0.5) FROM (SELECT CASE WHEN u10 > 0 AND blh > 0 THEN ln(u10 + 1) - ln(blh + 1) END lr FROM met)), 0) log_ratio
FROM (SELECT *, CASE WHEN u10 > 0 AND blh > 0 THEN ln(u10 + 1) - ln(blh + 1) END lr FROM met)""",
  "multiplicative ratio difference polynomial log_ratio")

q("urban_effects", "H20", lambda t: pick(t.met, S.urban_cols(c("t2m_celsius"), c("wind_speed"), ts())), """
SELECT station_id, datetime_utc, greatest(0.0, t2m_celsius - 22) heat_excess, CASE WHEN hour(datetime_utc) IN (8, 9, 10) THEN 1 ELSE 0 END peak_heating,
  CASE WHEN hour(datetime_utc) BETWEEN 13 AND 18 THEN 1 ELSE 0 END night_cooling, exp(-wind_speed / 3.0) wind_reduction,
  CASE WHEN wind_speed < 2 AND t2m_celsius > 25 THEN 1 ELSE 0 END canyon FROM met""", "heat_excess wind_reduction")

q("text_keys", "H21", lambda t: t.readings.select(*KEY, S.partition_key(ts()).alias("part"), S.gap_key(c("station_id"), ts()).alias("gap_id"),
  S.quantile_key(F.hour(ts()) / 100).alias("qkey"), F.split(S.partition_key(ts()), "-")[0].cast("bigint").alias("part_year"),
  F.lit(S.feature_name("lag", 3, "pm25")).alias("feature")), """
SELECT station_id, datetime_utc, strftime(datetime_utc, '%Y-%m') part, 'gap_' || station_id || '_' || strftime(datetime_utc, '%Y%m%d%H') gap_id,
  printf('q%.2f', hour(datetime_utc) / 100) qkey, CAST(split_part(strftime(datetime_utc, '%Y-%m'), '-', 1) AS BIGINT) part_year, 'lag_3h_pm25' feature FROM readings""")

q("forecast_path_stats", "H22", lambda t: pick(on.daily_paths(t.readings), S.array_stats(c("path")), ("station_id", "day")), """
SELECT station_id, day, path[1] first_value, path[-1] last_value, list_max(path) max_value, list_position(path, list_max(path)) - 1 peak_step, len(path) steps
FROM (SELECT station_id, date_trunc('day', datetime_utc) AS day, list(pm25 ORDER BY datetime_utc) path FROM readings GROUP BY 1, 2)""",
  "first_value last_value max_value")

q("array_weighted_sum", "H23", lambda t: t.met.select(*KEY, S.array_dot(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)),
  F.array("pm25", "t2m_celsius", "wind_speed")).alias("blend")), """
SELECT station_id, datetime_utc, 0.5 * pm25 + 0.3 * t2m_celsius + 0.2 * wind_speed blend FROM met""", "blend")

q("nested_access", "H24", lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k_path"),
  F.from_json("props", "k BIGINT")["k"].alias("k_struct"), F.from_json("props", "MAP<STRING, BIGINT>")["k"].alias("k_map")), """
SELECT event_id, k AS k_path, k AS k_struct, k AS k_map FROM ev""")

q("clip_values", "H25", lambda t: t.met.select(*KEY, S.clip(c("pm25"), 20.0, 60.0).alias("clipped"), S.clip(c("u10"), low=0.0).alias("floored")), """
SELECT station_id, datetime_utc, CASE WHEN pm25 < 20 THEN 20 WHEN pm25 > 60 THEN 60 ELSE pm25 END clipped, CASE WHEN u10 < 0 THEN 0 ELSE u10 END floored FROM met""",
  "clipped floored")

q("aqi_back_to_pm25", "H26", lambda t: t.readings.select(*KEY, S.aqi_to_pm25(c("pm25")).alias("conc")), """
SELECT station_id, datetime_utc, CASE WHEN pm25 <= 50 THEN pm25 * 0.5 WHEN pm25 <= 100 THEN 25 + (pm25 - 50) * 0.5
  WHEN pm25 <= 150 THEN 50 + (pm25 - 100) * 0.5 ELSE 75 + (pm25 - 150) * 0.5 END conc FROM readings""", "conc")

q("station_one_hot", "H27", lambda t: on.one_hot(t.readings, "station_id", [1, 2, 3, 4, 5], KEY), """
SELECT station_id, datetime_utc, CASE station_id WHEN 1 THEN 1 ELSE 0 END station_id_1, CASE station_id WHEN 2 THEN 1 ELSE 0 END station_id_2,
  CASE station_id WHEN 3 THEN 1 ELSE 0 END station_id_3, CASE station_id WHEN 4 THEN 1 ELSE 0 END station_id_4, CASE station_id WHEN 5 THEN 1 ELSE 0 END station_id_5 FROM readings""")
