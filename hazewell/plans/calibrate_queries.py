"""Queries of interval calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.operators import calibrate as N
from hazewell.plans.registry import query as q

c = F.col
TARGETS = ["pm25", "pm10", "no2"]
CF = "cf AS (SELECT model, quantile_cont(abs(err), 0.9) AS threshold FROM errors GROUP BY 1)"


def _fit(t):
    return N.conformal_fit(t.errors)


def _bands(t):
    return N.conformal_apply(t.forecasts, _fit(t))


BANDS = f"{CF}, bd AS (SELECT f.*, yhat - threshold AS lower, yhat + threshold AS upper FROM forecasts f JOIN cf USING (model))"
q("conformal_threshold", "N1", _fit, f"WITH {CF} SELECT * FROM cf", "threshold")
q("conformal_finite_sample", "N1", lambda t: N.conformal_fit(t.errors, finite_sample=True), """
SELECT model, score AS threshold FROM (SELECT model, abs(err) AS score, row_number() OVER (PARTITION BY model ORDER BY abs(err), station_id, target_ts) AS rn, count(*) OVER (PARTITION BY model) AS n FROM errors)
WHERE rn = least(ceil((n + 1) * 0.9), n)""", "threshold")
q("conformal_intervals", "N1", _bands, f"WITH {BANDS} SELECT * FROM bd", "yhat y lower upper")
q("normalised_conformal", "N2", lambda t: N.conformal_norm(t.errors), """
WITH s AS (SELECT model, station_id, stddev_pop(err) AS sigma FROM errors GROUP BY 1, 2), k AS (SELECT model, quantile_cont(abs(err) / sigma, 0.9) AS threshold FROM errors JOIN s USING (model, station_id) GROUP BY 1)
SELECT model, station_id, sigma, threshold, threshold * sigma AS half_width FROM s JOIN k USING (model)""", "sigma threshold half_width")
CUT = "2024-01-28"
old, new = f"target_ts < TIMESTAMP '{CUT}'", f"target_ts >= TIMESTAMP '{CUT}'"
q("conformal_update_append", "N3", lambda t: N.conformal_update(t.errors.filter(old), t.errors.filter(new)), f"WITH {CF} SELECT * FROM cf", "threshold")
q("conformal_update_window", "N3", lambda t: N.conformal_update(t.errors.filter(old), t.errors.filter(new), window=1000), f"""
SELECT model, quantile_cont(s, 0.9) AS threshold FROM (SELECT model, abs(err) AS s FROM errors WHERE {new} UNION ALL SELECT model, s FROM (
  SELECT model, abs(err) AS s, row_number() OVER (PARTITION BY model ORDER BY target_ts DESC, station_id DESC) AS rn FROM errors WHERE {old}) WHERE rn <= 1000) GROUP BY 1""", "threshold")
q("jackknife_threshold", "N4", lambda t: N.jackknife_fit(t.errors), """
SELECT model, quantile_cont(s - (t - s) / (n - 1), 0.9) AS threshold FROM (SELECT model, abs(err) AS s, sum(abs(err)) OVER (PARTITION BY model) AS t, count(*) OVER (PARTITION BY model) AS n FROM errors) GROUP BY 1""", "threshold")
LV = [0.05, 0.25, 0.5, 0.75, 0.95]
OFF = "ofs AS (" + " UNION ALL ".join(f"SELECT model, {v} AS level, quantile_cont(err, {v}) AS \"offset\" FROM errors GROUP BY 1" for v in LV) + ")"
q("quantile_offsets", "N5", lambda t: N.quantile_calibrate(t.errors, LV), f"WITH {OFF} SELECT * FROM ofs", 'level "offset"')
q("quantile_bands", "N5", lambda t: N.quantile_apply(t.forecasts, N.quantile_calibrate(t.errors, LV)).select("model", "station_id", "target_ts", "median", "lower", "upper"), """
SELECT model, station_id, target_ts, yhat + m AS median, yhat + a AS lower, yhat + b AS upper FROM forecasts
JOIN (SELECT model, quantile_cont(err, 0.05) AS a, quantile_cont(err, 0.5) AS m, quantile_cont(err, 0.95) AS b FROM errors GROUP BY 1) USING (model)""", "median lower upper")
q("quantile_quality", "N6", lambda t: N.quantile_quality(t.errors, N.quantile_calibrate(t.errors.filter(old), LV)), f"""
WITH {OFF.replace('FROM errors', f'FROM errors WHERE {old}')} SELECT model, level, avg(CASE WHEN err <= "offset" THEN 1 ELSE 0 END) AS coverage, abs(avg(CASE WHEN err <= "offset" THEN 1 ELSE 0 END) - level) AS coverage_error
FROM errors JOIN ofs USING (model) GROUP BY 1, 2""", "level coverage coverage_error")
SER = """s AS (SELECT model, station_id, row_number() OVER (PARTITION BY model, station_id ORDER BY target_ts) AS i, abs(err) AS e FROM errors),
n AS (SELECT model, station_id, max(i) AS n FROM s GROUP BY 1, 2)"""
JN = "FROM r JOIN s ON s.model = r.model AND s.station_id = r.station_id AND s.i = r.i + 1"
END = "FROM r JOIN n ON n.model = r.model AND n.station_id = r.station_id WHERE i = n"
q("online_quantile", "N7", lambda t: N.online_quantile(t.errors, rate=0.5), f"""
WITH RECURSIVE {SER}, r AS (SELECT model, station_id, i, e AS a FROM s WHERE i = 1 UNION ALL SELECT r.model, r.station_id, s.i, CASE WHEN e > a THEN a + 0.5 * 0.9 ELSE a - 0.5 * 0.1 END {JN})
SELECT r.model, r.station_id, a AS threshold {END}""", "threshold")
q("online_moments", "N8", lambda t: N.online_moments(t.errors), f"""
WITH RECURSIVE {SER}, r AS (SELECT model, station_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS m, CAST(1 AS DOUBLE) AS v FROM n UNION ALL SELECT r.model, r.station_id, s.i, 0.99 * m + 0.01 * e,
  CASE WHEN s.i > 1 THEN 0.99 * v + 0.01 * pow(e - (0.99 * m + 0.01 * e), 2) ELSE v END {JN}) SELECT r.model, r.station_id, m AS mean, v AS variance {END}""", "mean variance")
q("batch_adaptation", "N9", lambda t: N.batch_adapt(t.errors, 20.0), f"""
WITH RECURSIVE {SER}, b AS (SELECT model, station_id, (i - 1) // 50 + 1 AS i, quantile_cont(e, 0.9) AS q FROM s GROUP BY 1, 2, 3 HAVING count(*) = 50),
k AS (SELECT model, station_id, max(i) AS n FROM b GROUP BY 1, 2), r AS (SELECT model, station_id, CAST(0 AS BIGINT) AS i, CAST(20 AS DOUBLE) AS a FROM k
  UNION ALL SELECT r.model, r.station_id, b.i, 0.9 * a + 0.1 * q FROM r JOIN b ON b.model = r.model AND b.station_id = r.station_id AND b.i = r.i + 1)
SELECT r.model, r.station_id, a AS threshold, n AS batches FROM r JOIN k ON k.model = r.model AND k.station_id = r.station_id WHERE i = n""", "threshold")
q("sliding_threshold", "N10", lambda t: N.sliding_threshold(t.errors, rows=200, least=50), """
SELECT model, station_id, target_ts, CASE WHEN count(*) OVER w >= 50 THEN quantile_cont(abs(err), 0.9) OVER w END AS threshold FROM errors
WINDOW w AS (PARTITION BY model, station_id ORDER BY target_ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""", "threshold")
MON = f"""{CF}, b AS (SELECT model, station_id, target_ts, abs(err) AS e, (row_number() OVER (PARTITION BY model, station_id ORDER BY target_ts) - 1) // 50 AS batch FROM errors),
mo AS (SELECT model, station_id, batch, avg(CASE WHEN e <= threshold THEN 1 ELSE 0 END) AS coverage, max(target_ts) AS until FROM b JOIN cf USING (model) GROUP BY 1, 2, 3)"""
q("coverage_monitor", "N11", lambda t: N.coverage_monitor(t.errors, _fit(t)), f"WITH {MON} SELECT *, abs(coverage - 0.9) AS coverage_error, abs(coverage - 0.9) > 0.05 AS \"off\" FROM mo", "coverage coverage_error")
TC = " UNION ALL ".join(f"SELECT '{k}' AS kind, {e} AS slot, avg(abs(err)) AS mean, stddev_pop(abs(err)) AS std, count(*) AS n FROM errors GROUP BY 2" for k, e in (
    ("bin", "hour(target_ts) // 4"), ("hour", "hour(target_ts)"), ("dow", "isodow(target_ts) - 1")))
q("temporal_calibration", "N12", lambda t: N.temporal_calibration(t.errors), TC, "mean std")
FAC = "(1 + {w} * ((SELECT mean FROM tc WHERE kind = '{k}' AND slot = {e}) - 1))"
HALF = "threshold * " + " * ".join(FAC.format(w=w, k=k, e=e) for k, w, e in (
    ("hour", 0.1, "hour(target_ts)"), ("dow", 0.1, "isodow(target_ts) - 1"), ("bin", 0.05, "hour(target_ts) // 4"), ("dow", 0.05, "isodow(target_ts) - 1")))
q("temporal_intervals", "N13", lambda t: N.temporal_apply(t.forecasts.select("model", "station_id", "target_ts", "yhat"), _fit(t), N.temporal_calibration(t.errors)), f"""
WITH {CF}, tc AS ({TC}), h AS (SELECT model, station_id, target_ts, yhat, {HALF} AS half_width FROM forecasts JOIN cf USING (model))
SELECT *, yhat - half_width AS lower, yhat + half_width AS upper FROM h""", "yhat half_width lower upper")
q("decay_weights", "N14", lambda t: N.decay_weights(t.errors), """
SELECT model, station_id, target_ts, w / sum(w) OVER (PARTITION BY model, station_id) AS weight FROM (
  SELECT model, station_id, target_ts, pow(0.99, row_number() OVER (PARTITION BY model, station_id ORDER BY target_ts DESC) - 1) AS w FROM errors)""", "weight")
TE = """te AS (SELECT *, abs(y - yhat) AS score FROM (SELECT *, lag(y) OVER (PARTITION BY station_id, target ORDER BY datetime_utc) AS yhat FROM (
  SELECT station_id, datetime_utc, parameter AS target, avg(value) AS y FROM raw_meas WHERE value BETWEEN 0 AND 1000 GROUP BY 1, 2, 3)) WHERE yhat IS NOT NULL)"""
q("multi_target_thresholds", "N15", lambda t: N.multi_target(N.target_errors(t.raw), TARGETS), f"""
WITH {TE}, o AS (SELECT target, quantile_cont(score, 0.9) AS threshold FROM te GROUP BY 1),
j AS (SELECT quantile_cont(s, 0.9) AS joint_threshold FROM (SELECT avg(score) AS s FROM te GROUP BY station_id, datetime_utc HAVING count(*) = 3))
SELECT target, threshold, (1 / threshold) / sum(1 / threshold) OVER () AS weight, joint_threshold FROM o, j""", "threshold weight joint_threshold")
q("target_correlations", "N16", lambda t: N.target_corr(N.target_errors(t.raw), TARGETS), f"""
WITH {TE}, w AS (SELECT max(y) FILTER (WHERE target = 'pm25') AS pm25, max(y) FILTER (WHERE target = 'pm10') AS pm10, max(y) FILTER (WHERE target = 'no2') AS no2 FROM te GROUP BY station_id, datetime_utc)
SELECT 'pm25' AS a, 'pm10' AS b, corr(pm25, pm10) AS r FROM w UNION ALL SELECT 'pm25', 'no2', corr(pm25, no2) FROM w UNION ALL SELECT 'pm10', 'no2', corr(pm10, no2) FROM w""", "r")
EN = """me AS (SELECT *, abs(y - mean) / (sigma + 1e-8) AS score FROM (SELECT station_id, target_ts, max(y) AS y, avg(yhat) AS mean, quantile_cont(yhat, 0.5) AS median, stddev_pop(yhat) AS sigma,
   quantile_cont(yhat, 0.75) - quantile_cont(yhat, 0.25) AS iqr FROM forecasts WHERE model <> 'none' GROUP BY 1, 2)),
k AS (SELECT quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi, quantile_cont(score, 0.9) AS cc, count(*) FILTER (WHERE score <= 1) + 1 AS a, count(*) FILTER (WHERE score > 1) + 1 AS b FROM me),
ec AS (SELECT station_id, target_ts, y, mean, median, sigma, iqr, mean - sigma * lo AS q_lower, mean + sigma * hi AS q_upper, mean - sigma * cc AS c_lower, mean + sigma * cc AS c_upper,
   mean - 1.96 * sigma * (1 + sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))) AS b_lower, mean + 1.96 * sigma * (1 + sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))) AS b_upper, a / (a + b) AS b_mean FROM me, k)"""


def _members(t):
    return N.ensemble_members(t.forecasts)


q("ensemble_bands", "N17", lambda t: N.ensemble_calibrate(_members(t)), f"WITH {EN} SELECT * FROM ec", "y mean median sigma iqr q_lower q_upper c_lower c_upper b_lower b_upper b_mean")
q("ensemble_evaluation", "N18", lambda t: N.ensemble_eval(N.ensemble_calibrate(_members(t))), f"""
WITH {EN}, v AS (SELECT avg(abs(y - mean)) AS mae, sqrt(avg(pow(y - mean, 2))) AS rmse, avg(CASE WHEN y >= q_lower THEN 1 ELSE 0 END) AS q_lower_coverage, avg(CASE WHEN y <= q_upper THEN 1 ELSE 0 END) AS q_upper_coverage,
  avg(CASE WHEN y BETWEEN c_lower AND c_upper THEN 1 ELSE 0 END) AS c_coverage, avg(CASE WHEN y BETWEEN b_lower AND b_upper THEN 1 ELSE 0 END) AS b_coverage FROM ec)
SELECT *, abs(c_coverage - 0.9) AS c_error, abs(b_coverage - 0.95) AS b_error FROM v""", "mae rmse q_lower_coverage q_upper_coverage c_coverage b_coverage c_error b_error")
q("calibration_metrics", "N19", lambda t: N.calibration_metrics(_bands(t)), f"""
WITH {BANDS}, m AS (SELECT model, avg(CASE WHEN y BETWEEN lower AND upper THEN 1 ELSE 0 END) AS coverage, avg(upper - lower) AS width, stddev_pop(y) AS s,
  avg(upper - lower + 20 * greatest(0, lower - y) + 20 * greatest(0, y - upper)) AS winkler FROM bd GROUP BY 1)
SELECT model, coverage, abs(coverage - 0.9) AS coverage_error, width, 1 / width AS sharpness, winkler, abs(coverage - 0.9) + width / s AS interval_score FROM m""",
  "coverage coverage_error width sharpness winkler interval_score")
q("bootstrap_calibration", "N20", lambda t: N.bootstrap_metrics(_bands(t), coverage_error=True))
q("calibration_input_check", "N21", lambda t: N.calibration_check(_bands(t).withColumn("upper", F.when(c("yhat") < 10, float("inf")).when(c("yhat") > 200, None).otherwise(c("upper")))), f"""
WITH {BANDS}, x AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE yhat > 200) AS null_rows, count(*) FILTER (WHERE yhat < 10) AS infinite_rows, 0 AS crossed_rows FROM bd)
SELECT *, null_rows = 0 AND infinite_rows = 0 AS valid FROM x""")
q("calibration_drift", "N22", lambda t: N.calibration_drift(N.coverage_monitor(t.errors, _fit(t), size=20)), f"""
WITH {MON.replace('// 50', '// 20')}, d AS (SELECT model, station_id, batch, avg(coverage) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent,
   CASE WHEN count(*) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) = 5 THEN avg(coverage) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END AS before FROM mo WINDOW w AS (PARTITION BY model, station_id ORDER BY batch))
SELECT *, abs(recent - before) AS drift, CASE WHEN abs(recent - before) > 0.2 THEN 'critical' WHEN abs(recent - before) > 0.1 THEN 'warning' ELSE 'none' END AS severity FROM d WHERE before IS NOT NULL""", "recent before drift")
q("wrapped_intervals", "N23", lambda t: N.wrap_intervals(t.forecasts, _fit(t)), f"""
WITH {CF} SELECT model, station_id, target_ts, k AS quantile, yhat + threshold * d AS value FROM forecasts JOIN cf USING (model), (VALUES (0.1, -1), (0.5, 0), (0.9, 1)) z(k, d)""", "quantile value")
