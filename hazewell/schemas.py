"""Declared schemas (DDL) of the tables the library reads."""

from __future__ import annotations

READINGS = (
    "station_id BIGINT, datetime_utc TIMESTAMP, pm25 DOUBLE, latitude DOUBLE, longitude DOUBLE, quality STRING"
)
RAW = (
    "station_id BIGINT, sensor_id BIGINT, parameter STRING, value DOUBLE, unit STRING, datetime_utc TIMESTAMP, "
    "latitude DOUBLE, longitude DOUBLE, quality_flag STRING, data_source STRING"
)
WEATHER = (
    "datetime_utc TIMESTAMP, u10 DOUBLE, v10 DOUBLE, t2m_celsius DOUBLE, blh DOUBLE, wind_speed DOUBLE, wind_direction DOUBLE"
)
RAIN = ("datetime_utc TIMESTAMP, precipitation_mm_hourly DOUBLE, valid_pixels DOUBLE, total_pixels DOUBLE")
EVENTS_LOG = (
    "event_id STRING, ts TIMESTAMP, event_type STRING, source STRING, target STRING, operation STRING, "
    "parent_event_id STRING, station_id BIGINT, record_count BIGINT, quality DOUBLE"
)

REQUIRED = {
    "readings": ["datetime_utc", "station_id", "pm25"],
    "weather": ["datetime_utc", "u10", "v10", "t2m_celsius", "blh"],
    "rain": ["datetime_utc", "precipitation_mm_hourly"],
}
