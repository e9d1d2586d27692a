"""Queries of importance, attribution, scenarios, anomalies and user functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hazewell.operators import attribution as A
from hazewell.operators import explain as O
from hazewell.operators import joins as J
from hazewell.operators import udf as U
from hazewell.operators.select import fit_forest
from hazewell.plans.registry import query as q

c = F.col
KEYS = ["station_id", "datetime_utc"]
COLS = ["u10", "v10", "t2m_celsius", "blh", "wind_speed"]


MODELS: dict = {}


def _model(t):
    """The forest of a table, fitted once a session: what follows asks the same model."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in MODELS:
        MODELS[key] = fit_forest(t.met, COLS, "pm25", trees=100, depth=10)
    return MODELS[key]


q("permutation_importance", "O1", lambda t: O.permutation_importance(*_model(t), t.met, COLS, "pm25", KEYS, repeats=10))
q("windowed_importance", "O2", lambda t: O.windowed_importance(*_model(t), t.met, COLS, "pm25", KEYS, repeats=5))
q("importance_stability", "O3", lambda t: O.importance_stability(t.met, COLS, "pm25", KEYS, folds=5, trees=100, depth=10))
q("explanation_quality", "O4", lambda t: O.explain_quality(t.scores), """
WITH r AS (SELECT method, feature FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rn FROM scores) WHERE rn <= 5),
m AS (SELECT DISTINCT method FROM scores), i AS (SELECT a.method AS a, b.method AS b, count(*) AS n FROM r a JOIN r b ON a.feature = b.feature AND a.method < b.method GROUP BY 1, 2),
j AS (SELECT avg(coalesce(n, 0) / (10 - coalesce(n, 0))) AS consistency FROM m x JOIN m y ON x.method < y.method LEFT JOIN i ON i.a = x.method AND i.b = y.method),
s AS (SELECT 1 / (1 + avg(cv)) AS stability FROM (SELECT stddev_pop(score) / (avg(score) + 1e-8) AS cv FROM scores GROUP BY feature)), k AS (SELECT count(DISTINCT method) / 5 AS completeness FROM scores)
SELECT completeness, consistency, stability, (completeness + consistency + stability) / 3 AS overall FROM j, s, k""", "completeness consistency stability overall")


def _att(t):
    return O.linear_attributions(t.met, COLS, "pm25", KEYS)


ATT = "att AS (" + " UNION ALL ".join(f"SELECT station_id, datetime_utc, '{x}' AS feature, w * ({x} - m) AS attribution FROM met, (SELECT regr_slope(pm25, {x}) AS w, avg({x}) AS m FROM met)" for x in COLS) + ")"
q("attribution_rollup", "O5", lambda t: O.attribution_rollup(_att(t)), f"""
WITH {ATT} SELECT feature, avg(abs(attribution)) AS mean_abs, max(abs(attribution)) AS max_abs, count(*) AS n, quantile_cont(abs(attribution), 0.5) AS median_abs FROM att GROUP BY 1""", "mean_abs max_abs median_abs")
q("attribution_by_hour", "O5", lambda t: O.attribution_by_hour(_att(t)), f"""
WITH {ATT} SELECT date_trunc('hour', datetime_utc) AS hour, feature, avg(abs(attribution)) AS importance, count(*) AS n FROM att GROUP BY 1, 2""", "importance")
q("attribution_top_features", "O5", lambda t: O.attribution_top(_att(t), KEYS), f"""
WITH {ATT} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, datetime_utc ORDER BY abs(attribution) DESC, feature) AS rank FROM att) WHERE rank <= 3""", "attribution")
q("forest_attributions", "O5 forest", lambda t: A.forest_attributions(_model(t)[0], t.met, COLS, KEYS))
q("forest_attribution_rollup", "O5 forest", lambda t: O.attribution_rollup(A.forest_attributions(_model(t)[0], t.met, COLS, KEYS)))
SCEN = {"calmer": {"wind_speed": ("multiply", 0.5)}, "warmer": {"t2m_celsius": ("add", 5.0)}, "stagnant": {"wind_speed": ("multiply", 0.3), "blh": ("add", -200.0)}}
q("what_if_scenarios", "O6", lambda t: O.what_if(*_model(t), O.last_rows(t.met, COLS), COLS, SCEN))


def _scenarios(t):
    base = O.last_rows(t.met, COLS)
    made = O.make_scenarios(base, COLS, "systematic").unionByName(O.make_scenarios(base, COLS, "random")).unionByName(
        O.make_scenarios(base, COLS, "grouped", groups={"wind": ["u10", "v10", "wind_speed"], "air": ["t2m_celsius", "blh"]}))
    return O.score_scenarios(*_model(t), base, made).select("station_id", "scenario", F.array_join("perturbed", ",").alias("perturbed"), "baseline_pred", "scenario_pred", "impact", "impact_pct")


q("generated_scenarios", "O7", _scenarios)
q("sensitivity", "O8", lambda t: O.sensitivity(*_model(t), O.last_rows(t.met, COLS), COLS))
q("counterfactuals", "O9", lambda t: O.counterfactuals(*_model(t), O.last_rows(t.met, COLS), COLS))
q("anomalies", "O10", lambda t: O.anomalies(t.met, ["pm25", "wind_speed", "blh", "t2m_celsius"], KEYS))

q("rolling_user_function", "U1", lambda t: U.rolling_apply(t.holed, "pm25", 12, lambda v: float(np.max(v) - np.min(v)), least=6, name="spread").select(*KEYS, "spread"), """
SELECT station_id, datetime_utc, CASE WHEN count(pm25) OVER w >= 6 THEN max(pm25) OVER w - min(pm25) OVER w END AS spread FROM holed
WINDOW w AS (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "spread")
U.register_model("last_day_mean", lambda h: h["pm25"].tail(24).mean(), lambda m, p: np.full(len(p), m))
q("user_model_forecast", "U2", lambda t: U.run_model("last_day_mean", t.readings, J.future_hours(t.readings, 0, 24)), """
SELECT station_id, z + s * INTERVAL 1 HOUR AS datetime_utc, m AS yhat FROM (SELECT station_id, max(datetime_utc) AS z, avg(pm25) AS m FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc DESC) AS rn FROM readings) WHERE rn <= 24 GROUP BY 1), range(1, 25) t(s)""", "yhat")
U.register_metric("within_ten", lambda: F.avg((F.abs("err") <= 10).cast("int")))
U.register_metric("under_share", lambda: F.avg((c("err") > 0).cast("int")))
q("user_metrics", "U3", lambda t: U.run_metrics(t.errors, ["within_ten", "under_share"]), """
SELECT model, avg(CASE WHEN abs(err) <= 10 THEN 1 ELSE 0 END) AS within_ten, avg(CASE WHEN err > 0 THEN 1 ELSE 0 END) AS under_share FROM errors GROUP BY 1""", "within_ten under_share")
q("forecast_table_function", "U4", lambda t: U.forecast_rows(t.sparse, 24), """
SELECT station_id, step, z + step * INTERVAL 1 HOUR AS target_ts FROM (SELECT station_id, max(datetime_utc) AS z FROM sparse GROUP BY 1), range(1, 25) t(step)""")
