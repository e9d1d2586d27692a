"""Queries of filters, de-duplication, filling, splitting and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.operators import clean as C
from hazewell.operators import windows as W
from hazewell.plans.registry import query as q

c = F.col
MEAS = "event_id, station_id, parameter, datetime_utc, value, data_source"
MCOLS = [x.strip() for x in MEAS.split(",")]

q("drop_incomplete", "B1", lambda t: C.drop_incomplete(t.raw).select(*MCOLS), f"SELECT {MEAS} FROM raw_meas WHERE value IS NOT NULL AND datetime_utc IS NOT NULL", "value")
q("valid_range", "B2", lambda t: C.valid_range(t.raw, "value").select(*MCOLS), f"SELECT {MEAS} FROM raw_meas WHERE value BETWEEN 0 AND 1000", "value")
q("dedupe_readings", "B3", lambda t: C.dedupe(t.raw.select(*MCOLS), ["station_id", "datetime_utc", "parameter"], ["event_id"]), f"""
SELECT {MEAS} FROM (SELECT *, row_number() OVER (PARTITION BY station_id, datetime_utc, parameter ORDER BY event_id) AS rn FROM raw_meas) WHERE rn = 1""", "value")
q("dedupe_by_source", "B4", lambda t: C.dedupe_priority(t.raw.select(*MCOLS), ["station_id", "datetime_utc", "parameter"], "data_source", ["real", "synthetic"], ["event_id"]), f"""
SELECT {MEAS} FROM (SELECT *, row_number() OVER (PARTITION BY station_id, datetime_utc, parameter
  ORDER BY CASE data_source WHEN 'real' THEN 1 ELSE 2 END, event_id) AS rn FROM raw_meas) WHERE rn = 1""", "value")
q("recent_only", "B5", lambda t: C.recent_only(t.readings, "2024-01-30 12:00:00", 96), """
SELECT * FROM readings WHERE datetime_utc >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 96 HOUR""", "pm25")
q("iqr_filter", "B6", lambda t: C.iqr_filter(t.readings, k=1.5), """
SELECT r.* FROM readings r, (SELECT quantile_cont(pm25, 0.25) AS a, quantile_cont(pm25, 0.75) AS b FROM readings)
WHERE pm25 BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""", "pm25")
q("outliers_iqr", "B7", lambda t: C.outlier_flags(t.sparse, "iqr"), """
SELECT s.*, pm25 < a - 1.5 * (b - a) OR pm25 > b + 1.5 * (b - a) AS outlier FROM sparse s
JOIN (SELECT station_id AS k, quantile_cont(pm25, 0.25) AS a, quantile_cont(pm25, 0.75) AS b FROM sparse GROUP BY 1) ON k = station_id""", "pm25")
q("outliers_zscore", "B7", lambda t: C.outlier_flags(t.sparse, "zscore"), """
SELECT s.*, abs((pm25 - a) / b) > 3 AS outlier FROM sparse s
JOIN (SELECT station_id AS k, avg(pm25) AS a, stddev_samp(pm25) AS b FROM sparse GROUP BY 1) ON k = station_id""", "pm25")
for method, fn in (("forward", "last_value(pm25 IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
                   ("backward", "first_value(pm25 IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
                   ("mean", "pm25")):
    q(f"fill_{method}", "B8", lambda t, m=method: C.fill(t.holed, m), f"""
SELECT *, coalesce({fn}, avg(pm25) OVER (PARTITION BY station_id)) AS pm25_filled FROM holed""", "pm25 pm25_filled")
q("forward_fill_limit", "B9", lambda t: C.ffill_limit(t.holed, 1), """
SELECT *, coalesce(pm25, lag(pm25) OVER (PARTITION BY station_id ORDER BY datetime_utc)) AS pm25_filled FROM holed""", "pm25 pm25_filled")
q("interpolate_limit", "B10", lambda t: C.interpolate_limit(t.holed, 1, ["pm25"]), """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc) AS i FROM holed),
k AS (SELECT *, CASE WHEN pm25 IS NOT NULL THEN i END AS ki FROM n),
e AS (SELECT *, max(ki) OVER (PARTITION BY station_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
        min(ki) OVER (PARTITION BY station_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM k)
SELECT e.station_id, e.datetime_utc, e.pm25, coalesce(e.pm25, CASE WHEN e.i - e.pi <= 1 THEN
    coalesce(p.pm25 + (x.pm25 - p.pm25) * (e.i - e.pi) / (e.ni - e.pi), p.pm25) END) AS pm25_filled
FROM e LEFT JOIN n p ON p.station_id = e.station_id AND p.i = e.pi LEFT JOIN n x ON x.station_id = e.station_id AND x.i = e.ni""", "pm25 pm25_filled")


def _gappy(t):
    return t.raw.select("event_id", "value", F.when(c("quality_flag") == "valid", c("parameter")).alias("parameter"))


q("final_fill", "B11", lambda t: C.finalize(_gappy(t), ["value"], ["parameter"]), """
WITH g AS (SELECT event_id, value, CASE WHEN quality_flag = 'valid' THEN parameter END AS parameter FROM raw_meas)
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)) AS value,
  coalesce(parameter, (SELECT parameter FROM g WHERE parameter IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, parameter LIMIT 1)) AS parameter FROM g""", "value")
q("split_by_date", "B12", lambda t: C.split_by_date(t.readings, "2024-01-20", "2024-01-25"), """
SELECT *, CASE WHEN datetime_utc < TIMESTAMP '2024-01-20' THEN 'train' WHEN datetime_utc < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS part FROM readings""", "pm25")
q("split_by_share", "B13", lambda t: C.split_by_share(t.sparse), """
SELECT * EXCLUDE (p, n), CASE WHEN p < floor(n * 0.6) THEN 'train' WHEN p < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part
FROM (SELECT *, row_number() OVER (ORDER BY datetime_utc, station_id) - 1 AS p, count(*) OVER () AS n FROM sparse)""", "pm25")
q("match_moments", "B14", lambda t: C.match_moments(t.holed, t.readings), """
SELECT h.*, (pm25 - ma) / sa * sb + mb AS matched FROM holed h
JOIN (SELECT station_id, avg(pm25) AS ma, stddev_samp(pm25) AS sa FROM holed GROUP BY 1) USING (station_id)
JOIN (SELECT station_id, avg(pm25) AS mb, stddev_samp(pm25) AS sb FROM readings GROUP BY 1) USING (station_id)""", "pm25 matched")
SC = ["pm25", "blh"]
CENTRE = {"standard": ("avg({x})", "stddev_pop({x})"), "minmax": ("min({x})", "max({x}) - min({x})"),
          "robust": ("quantile_cont({x}, 0.5)", "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)")}
for kind, (a, b) in CENTRE.items():
    q(f"scale_{kind}", "B15", lambda t, k=kind: C.apply_scaler(t.met, C.fit_scaler(t.met, SC, k), SC).select("station_id", "datetime_utc", "pm25_scaled", "blh_scaled"), f"""
SELECT station_id, datetime_utc, (pm25 - ca) / sa AS pm25_scaled, (blh - cb) / sb AS blh_scaled FROM met,
  (SELECT {a.format(x='pm25')} AS ca, {b.format(x='pm25')} AS sa, {a.format(x='blh')} AS cb, {b.format(x='blh')} AS sb FROM met)""", "pm25_scaled blh_scaled")
PLACE = "event_id, latitude, longitude, datetime_utc, value, data_source"
q("dedupe_by_place", "B16", lambda t: C.dedupe_priority(t.raw.select(*[x.strip() for x in PLACE.split(",")]), ["datetime_utc", "latitude", "longitude"],
    "data_source", ["real", "synthetic"], ["event_id"]), f"""
SELECT {PLACE} FROM (SELECT *, row_number() OVER (PARTITION BY datetime_utc, latitude, longitude
  ORDER BY CASE data_source WHEN 'real' THEN 1 ELSE 2 END, event_id) AS rn FROM raw_meas) WHERE rn = 1""", "latitude longitude value")
q("recent_rows", "B17", lambda t: W.last_n(t.readings, 500, ["datetime_utc"]), """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc DESC) AS rn FROM readings) WHERE rn <= 500""", "pm25")
q("recent_days", "B17", lambda t: C.recent_days(t.sparse, 10), """
SELECT s.* FROM sparse s JOIN (SELECT station_id AS k, max(datetime_utc) AS z FROM sparse GROUP BY 1) ON k = station_id
WHERE datetime_utc >= z - INTERVAL 10 DAY""", "pm25")
