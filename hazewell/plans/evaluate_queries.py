"""Queries of forecast evaluation and back-tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.operators import evaluate as M
from hazewell.operators import regress as G
from hazewell.operators import forecast as L
from hazewell.plans.forecast_queries import TWO, blend_sql
from hazewell.plans.registry import query as q

c = F.col
SMAPE = "avg(CASE WHEN (abs(y) + abs(yhat)) / 2 > 1e-8 THEN abs(err) / ((abs(y) + abs(yhat)) / 2) END) * 100"
PM = f"avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, {SMAPE} AS smape, count(err) AS n"


def _metrics(t):
    return M.point_metrics(t.errors, ["model", "horizon"])


MT = f"mt AS (SELECT model, horizon, {PM} FROM errors GROUP BY 1, 2)"
q("point_metrics", "M1 M2", lambda t: M.point_metrics(t.errors, ["model"]), f"SELECT model, {PM} FROM errors GROUP BY 1", "mae rmse smape")
q("scaled_error", "M3", lambda t: M.mase(t.errors, t.readings), """
SELECT model, station_id, mae, mae / b AS mase FROM (SELECT model, station_id, avg(abs(err)) AS mae FROM errors GROUP BY 1, 2)
JOIN (SELECT station_id, avg(abs(d)) AS b FROM (SELECT station_id, pm25 - lag(pm25, 24) OVER (PARTITION BY station_id ORDER BY datetime_utc) AS d FROM readings) GROUP BY 1) USING (station_id)""", "mae mase")


def _quantile_rows(t):
    r = L.quantile_rows(t.forecasts)
    act = t.readings.select("station_id", c("datetime_utc").alias("target_ts"), c("pm25").alias("actual"))
    return r.join(act, ["station_id", "target_ts"])


q("pinball_loss", "M4", lambda t: M.pinball(_quantile_rows(t)), """
SELECT model, k AS quantile, avg(CASE WHEN y - (yhat + d) >= 0 THEN k * (y - (yhat + d)) ELSE (k - 1) * (y - (yhat + d)) END) AS loss
FROM forecasts, (VALUES (0.1, -8), (0.5, 0), (0.9, 8)) z(k, d) GROUP BY 1, 2""", "quantile loss")


def _bands(t):
    return t.forecasts.select("*", (c("yhat") - 20).alias("lower"), (c("yhat") + 20).alias("upper"))


q("interval_coverage", "M5", lambda t: M.coverage(_bands(t), 0.8), """
SELECT model, cov AS coverage, 40 AS width, abs(cov - 0.8) AS coverage_error FROM (SELECT model, avg(CASE WHEN y BETWEEN yhat - 20 AND yhat + 20 THEN 1 ELSE 0 END) AS cov FROM forecasts GROUP BY 1)""", "coverage width coverage_error")
q("metrics_by_horizon", "M6", _metrics, f"WITH {MT} SELECT * FROM mt", "mae rmse smape")
q("relative_improvement", "M7", lambda t: M.improvement(_metrics(t), "daily"), f"""
WITH {MT} SELECT m.model, m.horizon, m.mae, (b.mae - m.mae) / b.mae AS gain FROM mt m JOIN mt b ON b.model = 'daily' AND b.horizon = m.horizon""", "mae gain")
q("champion_model", "M8", lambda t: M.champion(_metrics(t)), f"WITH {MT} SELECT model, avg(mae) AS average_mae FROM mt GROUP BY 1 ORDER BY 2 LIMIT 1", "average_mae")
q("evaluation_summary", "M9", lambda t: M.summary(_metrics(t), "daily"), f"""
WITH {MT}, g AS (SELECT m.horizon, max((b.mae - m.mae) / b.mae) AS best_gain FROM mt m JOIN mt b ON b.model = 'daily' AND b.horizon = m.horizon WHERE m.model <> 'daily' GROUP BY 1)
SELECT horizon, min_by(model, mae) AS best_model, min(mae) AS best_mae, max(mae) AS worst_mae, stddev_pop(mae) AS mae_std, avg(rmse) AS mean_rmse, max(best_gain) AS best_gain,
  max(best_gain) >= 0.1 AS meets_10, max(best_gain) >= 0.15 AS meets_15 FROM mt JOIN g USING (horizon) GROUP BY 1""", "best_mae worst_mae mae_std mean_rmse best_gain")
q("block_evaluation", "M10", lambda t: M.block_eval(t.errors, t.readings, 12), f"""
WITH r AS (SELECT station_id, datetime_utc, row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc) - 1 AS p FROM readings),
b AS (SELECT station_id, (p - 12) // 12 AS k, min(datetime_utc) AS a, max(datetime_utc) AS z FROM r WHERE p >= 12 GROUP BY 1, 2 HAVING count(*) = 12 AND date_diff('hour', min(datetime_utc), max(datetime_utc)) = 11)
SELECT model, {PM}, 12 AS horizon FROM errors e JOIN b ON b.station_id = e.station_id AND target_ts BETWEEN a AND z GROUP BY 1 HAVING count(err) >= 100""", "mae rmse smape")
ORG = """o AS (SELECT k, a + (168 + 24 * k) * INTERVAL 1 HOUR AS origin FROM (SELECT min(datetime_utc) AS a, max(datetime_utc) AS z FROM readings), range(0, 10) t(k)
 WHERE a + (168 + 24 * k) * INTERVAL 1 HOUR <= z - INTERVAL 24 HOUR)"""
q("rolling_origins", "M11", lambda t: M.origins(t.readings), f"WITH {ORG} SELECT * FROM o")
q("origin_splits", "M12", lambda t: M.split_at(t.readings, M.origins(t.readings)), f"""
WITH {ORG} SELECT station_id, origin, count(*) FILTER (WHERE datetime_utc < origin) AS train, count(*) FILTER (WHERE datetime_utc BETWEEN origin AND origin + INTERVAL 24 HOUR) AS test
FROM readings, o GROUP BY 1, 2 HAVING count(*) FILTER (WHERE datetime_utc < origin) >= 72 AND count(*) FILTER (WHERE datetime_utc BETWEEN origin AND origin + INTERVAL 24 HOUR) >= 6""")
CV = f"""{ORG}, pr AS (SELECT k, station_id, hour(datetime_utc) AS h, avg(pm25) AS p FROM readings, o WHERE datetime_utc < origin GROUP BY 1, 2, 3),
mn AS (SELECT k, station_id, avg(pm25) AS m FROM readings, o WHERE datetime_utc < origin GROUP BY 1, 2),
te AS (SELECT r.station_id, o.k, origin, pm25 AS y, date_diff('hour', origin, datetime_utc) AS lead, hour(datetime_utc) AS h FROM readings r, o WHERE datetime_utc >= origin AND datetime_utc < origin + INTERVAL 24 HOUR),
fc AS (SELECT te.*, coalesce(p, m) AS fp, m AS fm FROM te JOIN mn USING (k, station_id) LEFT JOIN pr USING (k, station_id, h)),
ln AS (SELECT 'profile' AS model, origin, lead, y, fp AS yhat, y - fp AS err FROM fc UNION ALL SELECT 'mean', origin, lead, y, fm, y - fm FROM fc),
cv AS (SELECT model, origin, horizon, {PM} FROM ln JOIN (SELECT unnest([6, 12, 24]) AS horizon) ON lead < horizon GROUP BY 1, 2, 3)"""


def _cv(t):
    return M.rolling_cv(t.readings, M.origins(t.readings))


q("rolling_origin_cv", "M13", _cv, f"WITH {CV} SELECT * FROM cv", "mae rmse smape")
q("cv_comparison", "M14", lambda t: M.cv_compare(_cv(t)), f"""
WITH {CV}, m AS (SELECT model, horizon, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, count(*) AS origins FROM cv GROUP BY 1, 2)
SELECT *, mae_mean = min(mae_mean) OVER (PARTITION BY horizon) AS best FROM m""", "mae_mean mae_std rmse_mean")
q("residual_statistics", "M15", lambda t: M.residual_stats(t.errors), f"""
SELECT model, avg(err) AS mean, stddev_pop(err) AS std, min(err) AS min, max(err) AS max, avg(pow(err - m, 3)) / pow(stddev_pop(err), 3) AS skewness, kurtosis_pop(err) AS kurtosis, avg(abs(err)) AS mae,
  sqrt(avg(err * err)) AS rmse, avg(abs(err / y)) * 100 AS mape, {SMAPE} AS smape, max(err) - min(err) AS range, quantile_cont(err, 0.5) AS median
FROM errors JOIN (SELECT model, avg(err) AS m FROM errors GROUP BY 1) USING (model) GROUP BY 1""", "mean std min max skewness kurtosis mae rmse mape smape range median")
q("residual_diagnostics", "M16", lambda t: M.residual_diag(t.errors), """
WITH s AS (SELECT model, stddev_pop(err) AS s, avg(y) AS my, quantile_cont(err, 0.75) - quantile_cont(err, 0.25) AS iq FROM errors GROUP BY 1)
SELECT model, avg(abs(err)) AS mean_abs, stddev_pop(abs(err)) AS std_abs, avg(err) AS bias, avg(CASE WHEN abs(err) <= s THEN 1 ELSE 0 END) AS within_1, avg(CASE WHEN abs(err) <= 2 * s THEN 1 ELSE 0 END) AS within_2,
  avg(CASE WHEN abs(err) <= 3 * s THEN 1 ELSE 0 END) AS within_3, 1 - sum(err * err) / sum(pow(y - my, 2)) AS efficiency, pow(corr(y, yhat), 2) AS r2, avg(CASE WHEN abs(err) > 1.5 * iq THEN 1 ELSE 0 END) AS outlier_share
FROM errors JOIN s USING (model) GROUP BY 1""", "mean_abs std_abs bias within_1 within_2 within_3 efficiency r2 outlier_share")
q("residual_tests", "M17", lambda t: M.residual_tests(t.errors), """
WITH d AS (SELECT e.model, e.station_id, err, err - m AS d, row_number() OVER w AS i, lag(err) OVER w AS p, """ + ", ".join(f"lag(err - m, {k}) OVER w AS d{k}" for k in range(1, 11)) + """
  FROM errors e JOIN (SELECT model, station_id, avg(err) AS m FROM errors GROUP BY 1, 2) x ON x.model = e.model AND x.station_id = e.station_id WINDOW w AS (PARTITION BY e.model, e.station_id ORDER BY target_ts)),
a AS (SELECT model, station_id, sum(pow(err - p, 2)) / sum(err * err) AS durbin_watson, count(*) * (count(*) + 2) * (""" + " + ".join(f"pow(sum(d * d{k}) / sum(d * d), 2) / (count(*) - {k})" for k in range(1, 11)) + """) AS ljung_box,
  count(*) * pow(corr(err * err, i), 2) AS breusch_pagan FROM d GROUP BY 1, 2)
SELECT *, durbin_watson BETWEEN 1.5 AND 2.5 AS uncorrelated, ljung_box < 18.307038 AS white_noise, breusch_pagan < 3.841459 AS homoscedastic FROM a""", "durbin_watson ljung_box breusch_pagan")
q("residual_normality", "M18", lambda t: reduce(DataFrame.unionByName, [M.ks_normal(t.errors, m) for m in ("persist", "profile", "daily")]))
q("tail_normality", "M18 tails", lambda t: M.tail_normality(t.errors))
q("unit_root", "M18 unit root", lambda t: G.unit_root(t.errors))
q("best_model_by_metric", "M19", lambda t: M.residual_compare(M.residual_stats(t.errors)), f"""
WITH s AS (SELECT model, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, {SMAPE} AS smape, stddev_pop(err) AS std, avg(err) AS mean FROM errors GROUP BY 1),
l AS (UNPIVOT s ON mae, rmse, smape, std, mean INTO NAME metric VALUE v) SELECT metric, min_by(model, v) AS best_model, min(v) AS best_value FROM l GROUP BY 1""", "best_value")
q("blend_grid_sweep", "M20", lambda t: M.grid_sweep(L.two_model_table(t.errors, "persist", "profile")), f"""
WITH {TWO}, gr AS (SELECT tw.*, distance, floor FROM tw, (SELECT unnest([1.5, 2.0, 3.0, 4.0, 5.0]) AS distance), (SELECT unnest([0.1, 0.2, 0.25, 0.3]) AS floor)), {blend_sql('distance', 'floor', 'gr', ', distance, floor')}
SELECT distance, floor, avg(m) AS mae FROM (SELECT distance, floor, station_id, avg(abs(y - yhat)) AS m FROM bl GROUP BY 1, 2, 3) GROUP BY 1, 2""", "distance floor mae")
q("season_period_sweep", "M21", lambda t: M.param_sweep(t.readings, "2024-01-25"), """
WITH tr AS (SELECT * FROM readings WHERE datetime_utc < TIMESTAMP '2024-01-25'),
p AS (SELECT station_id, datetime_utc, pm25 AS y, period, datetime_utc - period * INTERVAL 1 HOUR AS lt FROM readings, (SELECT unnest([24, 168, 720]) AS period) WHERE datetime_utc >= TIMESTAMP '2024-01-25'),
n AS (SELECT period, y, h.pm25 AS v, row_number() OVER (PARTITION BY p.station_id, p.datetime_utc, period ORDER BY abs(epoch(h.datetime_utc) - epoch(lt)), h.datetime_utc) AS rn FROM p JOIN tr h ON h.station_id = p.station_id),
m AS (SELECT period, avg(abs(y - v)) AS mae FROM n WHERE rn = 1 GROUP BY 1)
SELECT *, mae = (SELECT min(mae) FROM m) AS best FROM m""", "mae")
q("evaluation_matrix", "M22", lambda t: M.point_metrics(t.errors, ["model", "station_id", "horizon"]), f"SELECT model, station_id, horizon, {PM} FROM errors GROUP BY 1, 2, 3", "mae rmse smape")
q("missing_by_station", "M23", lambda t: M.missing_by_station(t.holed), "SELECT station_id, count(*) FILTER (WHERE pm25 IS NULL) * 100 / count(*) AS missing_pct FROM holed GROUP BY 1", "missing_pct")
EX = """
p AS (SELECT station_id, hour(datetime_utc) AS h, pm25 AS y, row_number() OVER (ORDER BY datetime_utc, station_id) - 1 AS p, count(*) OVER () AS n FROM readings),
r AS (SELECT *, CASE WHEN p < n - 5 * (n // 6) THEN 0 ELSE (p - (n - 5 * (n // 6))) // (n // 6) + 1 END AS run FROM p),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold), pf AS (SELECT fold, station_id, h, avg(y) AS a FROM r, f WHERE run < fold GROUP BY 1, 2, 3), gl AS (SELECT fold, avg(y) AS g FROM r, f WHERE run < fold GROUP BY 1),
e AS (SELECT r.*, f.fold, y - coalesce(a, g) AS err FROM r JOIN f ON run <= f.fold JOIN gl ON gl.fold = f.fold LEFT JOIN pf ON pf.fold = f.fold AND pf.station_id = r.station_id AND pf.h = r.h),
cv AS (SELECT fold, CASE WHEN run = fold THEN 'validation' ELSE 'train' END AS part, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, count(*) AS n FROM e GROUP BY 1, 2)"""
q("expanding_folds", "M24", lambda t: M.expanding_cv(t.readings), f"WITH {EX} SELECT * FROM cv", "mae rmse")
q("expanding_fold_summary", "M24", lambda t: M.expanding_summary(M.expanding_cv(t.readings)), f"""
WITH {EX} SELECT part, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std FROM cv GROUP BY 1""", "mae_mean mae_std rmse_mean rmse_std")
