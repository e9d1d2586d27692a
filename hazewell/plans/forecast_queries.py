"""Queries of forecasts, ensembles and bias learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.operators import agg as A
from hazewell.operators import forecast as L
from hazewell.operators import joins as J
from hazewell.operators import regress as G
from hazewell.plans.registry import query as q

c = F.col
MODELS = ["persist", "daily", "profile"]

FIT = """
b AS (SELECT station_id, count(*) AS n, count(pm25) AS seen, avg(pm25) AS m, stddev_samp(pm25) AS s, var_samp(pm25) AS v FROM {src} GROUP BY 1),
p AS (SELECT *, CASE WHEN n >= 336 THEN 168 WHEN n >= 48 THEN 24 WHEN n >= 144 THEN 72 WHEN n >= 2 THEN n // 2 ELSE 24 END AS period FROM b),
r AS (SELECT x.station_id, pm25, row_number() OVER (PARTITION BY x.station_id ORDER BY datetime_utc) - 1 AS pos FROM {src} x),
ph AS (SELECT station_id, avg(pow(pm - m, 2)) AS sv FROM (SELECT r.station_id, pos % period AS k, avg(pm25) AS pm, max(m) AS m FROM r JOIN p ON p.station_id = r.station_id GROUP BY 1, 2) GROUP BY 1),
md AS (SELECT r.station_id, avg(abs(pm25 - m)) AS mad FROM r JOIN p ON p.station_id = r.station_id GROUP BY 1),
fit AS (SELECT p.station_id, period, coalesce(m, 25) AS mean, CASE WHEN seen > 1 THEN s ELSE 0 END AS std, CASE WHEN seen > 1 THEN mad ELSE 0 END AS mad,
  CASE WHEN seen >= 2 * period AND v > 0 THEN least(1.0, sv / v) ELSE 0 END AS strength FROM p JOIN md USING (station_id) JOIN ph USING (station_id))"""
q("seasonal_naive_fit", "L1", lambda t: L.snaive_fit(t.sparse), f"WITH {FIT.format(src='sparse')} SELECT * FROM fit", "mean std mad strength")
GRID = """g AS (SELECT station_id, step, z + step * INTERVAL 1 HOUR AS datetime_utc FROM (SELECT station_id, max(datetime_utc) AS z FROM {src} GROUP BY 1), range(1, {n} + 1) t(step))"""


def _snaive(t):
    return L.snaive_predict(L.snaive_fit(t.holed), t.holed, L.forecast_grid(t.holed, 24))


SN = f"""{FIT.format(src='holed')}, {GRID.format(src='holed', n=24)},
lk AS (SELECT g.*, fit.* EXCLUDE (station_id), g.datetime_utc - period * INTERVAL 1 HOUR AS lt FROM g JOIN fit USING (station_id)),
nr AS (SELECT lk.station_id, lk.step, h.pm25 AS v, row_number() OVER (PARTITION BY lk.station_id, lk.step ORDER BY abs(epoch(h.datetime_utc) - epoch(lt)), h.datetime_utc) AS rn FROM lk JOIN holed h USING (station_id)),
nm AS (SELECT lk.station_id, lk.step, avg(h.pm25) AS a FROM lk LEFT JOIN holed h ON h.station_id = lk.station_id AND h.datetime_utc BETWEEN lt - INTERVAL 3 HOUR AND lt + INTERVAL 3 HOUR GROUP BY 1, 2),
pr AS (SELECT lk.station_id, lk.step, lk.datetime_utc, period, mean, std, mad, strength, coalesce(v, a, mean) AS yhat FROM lk JOIN nr ON nr.station_id = lk.station_id AND nr.step = lk.step AND rn = 1
       JOIN nm ON nm.station_id = lk.station_id AND nm.step = lk.step)"""
q("seasonal_naive_forecast", "L2", _snaive, f"WITH {SN} SELECT * FROM pr", "mean std mad strength yhat")
q("seasonal_naive_interval", "L3", lambda t: L.snaive_interval(_snaive(t)).select("station_id", "step", "yhat", "q10", "q90"), f"""
WITH {SN} SELECT station_id, step, yhat, greatest(0, yhat - 1.28 * mad) AS q10, yhat + 1.28 * mad AS q90 FROM pr""", "yhat q10 q90")
q("forecast_grid", "L4", lambda t: L.forecast_grid(t.sparse, 48), f"WITH {GRID.format(src='sparse', n=48)} SELECT * FROM g")
PF = """
i AS (SELECT station_id, pm25, datetime_utc, row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc) - 1 AS i FROM holed WHERE pm25 IS NOT NULL),
pf AS (SELECT station_id, avg(pm25) AS mean, stddev_samp(pm25) AS std, CASE WHEN count(*) > 10 THEN regr_slope(pm25, i) ELSE 0 END AS slope FROM i GROUP BY 1)"""
q("profile_fit", "L5", lambda t: L.profile_fit(t.holed), f"WITH {PF} SELECT * FROM pf", "mean std slope")
q("profile_forecast", "L6", lambda t: L.profile_predict(L.profile_fit(t.holed), A.seasonal_profile(t.holed), L.forecast_grid(t.holed, 24)), f"""
WITH {PF}, {GRID.format(src='holed', n=24)}, hd AS (SELECT station_id, hour(datetime_utc) AS h, avg(pm25) AS a FROM i GROUP BY 1, 2), dd AS (SELECT station_id, isodow(datetime_utc) AS d, avg(pm25) AS a FROM i GROUP BY 1, 2),
y AS (SELECT g.station_id, step, g.datetime_utc, std, greatest(0, mean + slope * (step - 1) + coalesce(hd.a - mean, 0) + coalesce(dd.a - mean, 0)) AS yhat FROM g JOIN pf USING (station_id)
  LEFT JOIN hd ON hd.station_id = g.station_id AND h = hour(g.datetime_utc) LEFT JOIN dd ON dd.station_id = g.station_id AND d = isodow(g.datetime_utc))
SELECT station_id, step, datetime_utc, yhat, greatest(0, yhat - 1.28 * std) AS q10, yhat + 1.28 * std AS q90 FROM y""", "yhat q10 q90")
LINE = G.Additive(changes=0, daily=0, weekly=0, yearly=0)
q("additive_line", "L5 additive", lambda t: G.additive_fit(t.holed, LINE).select("station_id", "n", (F.col("coef")[0] * F.col("unit")).alias("level"), (F.col("coef")[1] * F.col("unit")).alias("rise"), "sigma"), """
WITH s AS (SELECT station_id, min(epoch(datetime_utc)) AS a, max(epoch(datetime_utc)) - min(epoch(datetime_utc)) AS l FROM holed WHERE pm25 IS NOT NULL GROUP BY 1),
r AS (SELECT station_id, pm25 AS y, (epoch(datetime_utc) - a) / l AS t FROM holed JOIN s USING (station_id) WHERE pm25 IS NOT NULL),
f AS (SELECT station_id, regr_intercept(y, t) AS level, regr_slope(y, t) AS rise FROM r GROUP BY 1)
SELECT station_id, count(*) AS n, any_value(level) AS level, any_value(rise) AS rise, sqrt(avg(pow(y - level - rise * t, 2))) AS sigma FROM r JOIN f USING (station_id) GROUP BY 1""", "level rise sigma")
WEATHER = ("wind_speed", "blh")
q("additive_fit", "L5 additive", lambda t: G.additive_fit(t.met, G.Additive(regressors=WEATHER)).select("station_id", "n", "sigma", F.size("coef").alias("terms"), F.array_join(F.transform("coef", lambda v: F.format_number(v, 4)), " ").alias("coef")))
q("additive_forecast", "L6 additive", lambda t: G.additive_predict(G.additive_fit(t.holed, G.Additive()), L.forecast_grid(t.holed, 24), G.Additive()))
AR = """
sc AS (SELECT station_id, avg(pm25) AS centre, greatest(stddev_pop(pm25), 1e-6) AS scale, max_by(pm25, datetime_utc) AS l FROM readings GROUP BY 1),
z AS (SELECT station_id, (pm25 - centre) / scale AS y, (lag(pm25) OVER (PARTITION BY station_id ORDER BY datetime_utc) - centre) / scale AS x FROM readings JOIN sc USING (station_id)),
f AS (SELECT station_id, corr(x, y) AS coef, avg(y) - corr(x, y) * avg(x) AS intercept FROM z WHERE x IS NOT NULL GROUP BY 1),
ar AS (SELECT sc.station_id, centre, scale, (l - centre) / scale AS last_value, coef, intercept, sigma FROM sc JOIN f USING (station_id)
  JOIN (SELECT station_id, stddev_pop(y - intercept - coef * x) AS sigma FROM z JOIN f USING (station_id) WHERE x IS NOT NULL GROUP BY 1) USING (station_id))"""
q("ar1_fit", "L7", lambda t: L.ar1_fit(t.readings), f"WITH {AR} SELECT * FROM ar", "centre scale last_value coef intercept sigma")
q("ar1_forecast", "L8", lambda t: L.ar1_predict(L.ar1_fit(t.readings), L.forecast_grid(t.readings, 24)), f"""
WITH RECURSIVE {AR}, {GRID.format(src='readings', n=24)},
path AS (SELECT station_id, CAST(0 AS BIGINT) AS step, last_value AS v FROM ar UNION ALL SELECT p.station_id, p.step + 1, intercept + coef * v FROM path p JOIN ar USING (station_id) WHERE p.step < 24)
SELECT station_id, step, datetime_utc, v * scale + centre AS yhat, greatest(0, v * scale + centre - 1.64 * sigma * scale) AS q10, v * scale + centre + 1.64 * sigma * scale AS q90
FROM path JOIN ar USING (station_id) JOIN g USING (station_id, step)""", "yhat q10 q90")
q("arma_first_order", "L7 orders", lambda t: G.arma_fit(t.readings, p=1, q=0, long=1).select("station_id", "ar", "intercept", F.col("phi")[0].alias("phi"), "n"), """
WITH z AS (SELECT station_id, pm25 AS y, lag(pm25) OVER (PARTITION BY station_id ORDER BY datetime_utc) AS x FROM readings),
f AS (SELECT station_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m, regr_syy(y, x) AS r0, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS r1, count(*) AS n FROM z WHERE x IS NOT NULL GROUP BY 1)
SELECT station_id, CASE WHEN n * ln(r1 / n) + 2 * ln(n) < n * ln(r0 / n) + ln(n) THEN 1 ELSE 0 END AS ar, CASE WHEN n * ln(r1 / n) + 2 * ln(n) < n * ln(r0 / n) + ln(n) THEN a ELSE m END AS intercept,
  CASE WHEN n * ln(r1 / n) + 2 * ln(n) < n * ln(r0 / n) + ln(n) THEN b ELSE 0 END AS phi, n FROM f""", "intercept phi")


def _arma(t):
    return G.arma_fit(t.met, regressors=WEATHER)


q("arma_fit", "L7 orders", lambda t: _arma(t).select("station_id", "ar", "ma", "intercept", "sigma", "n", "criterion", F.array_join(F.transform(F.concat("phi", "theta", "beta"), lambda v: F.format_number(v, 4)), " ").alias("coef")))
q("arma_forecast", "L8 orders", lambda t: G.arma_predict(_arma(t), J.align_future(L.forecast_grid(t.met, 24), t.weather), WEATHER))
q("combine_equal", "L9", lambda t: L.combine(t.forecasts), "SELECT station_id, target_ts, avg(yhat) AS combined FROM forecasts GROUP BY 1, 2", "combined")
PW = """
sp AS (SELECT station_id, max(target_ts) AS z, least(168, floor(date_diff('hour', min(target_ts), max(target_ts)) / 4)) AS hrs FROM errors GROUP BY 1),
ma AS (SELECT model, avg(abs(err)) AS mae FROM errors JOIN sp USING (station_id) WHERE hrs >= 24 AND epoch(target_ts) > epoch(z) - hrs * 3600 GROUP BY 1),
pw AS (SELECT model, mae, (1 / (mae + 0.001)) / sum(1 / (mae + 0.001)) OVER () AS weight FROM ma)"""
q("performance_weights", "L10", lambda t: L.perf_weights(t.errors), f"WITH {PW} SELECT * FROM pw", "mae weight")
q("combine_quantiles", "L11", lambda t: L.combine(L.quantile_rows(t.forecasts), L.perf_weights(t.errors), ("station_id", "target_ts", "quantile")), f"""
WITH {PW}, ql AS (SELECT model, station_id, target_ts, quantile, yhat + d AS v FROM forecasts, (VALUES (0.1, -8), (0.5, 0), (0.9, 8)) k(quantile, d))
SELECT station_id, target_ts, quantile, sum(weight * v) / sum(weight) AS combined FROM ql JOIN pw USING (model) GROUP BY 1, 2, 3""", "quantile combined")
DW = """
pe AS (SELECT model, target_ts, avg(abs(err)) AS mae FROM errors GROUP BY 1, 2),
se AS (SELECT model, target_ts, CASE WHEN count(mae) OVER w >= 24 THEN 1 / (1 + avg(mae) OVER w) END AS score FROM pe WINDOW w AS (PARTITION BY model ORDER BY target_ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND CURRENT ROW)),
rw AS (SELECT *, CASE WHEN count(score) OVER t = 0 THEN 1 / count(*) OVER t ELSE coalesce(score / sum(score) OVER t, 0.05) END AS raw FROM se WINDOW t AS (PARTITION BY target_ts)),
dw AS (SELECT model, target_ts, score, least(0.8, greatest(0.05, raw)) / sum(least(0.8, greatest(0.05, raw))) OVER (PARTITION BY target_ts) AS weight FROM rw)"""
q("dynamic_weights", "L12", lambda t: L.dynamic_weights(t.errors), f"WITH {DW} SELECT * FROM dw", "score weight")
STEPS = """
st AS (SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY target_ts) AS i, p, d, f FROM (SELECT station_id, target_ts, avg(1 / (1 + abs(err))) FILTER (WHERE model = 'persist') AS p,
   avg(1 / (1 + abs(err))) FILTER (WHERE model = 'daily') AS d, avg(1 / (1 + abs(err))) FILTER (WHERE model = 'profile') AS f FROM errors GROUP BY 1, 2)),
n AS (SELECT station_id, max(i) AS n FROM st GROUP BY 1)"""
OUT3 = "SELECT station_id, unnest(['persist', 'daily', 'profile']) AS model, unnest([a, b, g]) AS weight FROM rec JOIN n USING (station_id) WHERE i = n"
LIM = "least(0.8, greatest(0.05, {w} + coalesce(0.1 * ({s} - 0.5), 0)))"
SUM3 = "(" + " + ".join(LIM.format(w=w, s=s) for w, s in (("a", "p"), ("b", "d"), ("g", "f"))) + ")"
q("adaptive_weights", "L13", lambda t: L.adaptive_weights(t.errors, MODELS), f"""
WITH RECURSIVE {STEPS}, rec AS (SELECT station_id, CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) / 3 AS a, CAST(1 AS DOUBLE) / 3 AS b, CAST(1 AS DOUBLE) / 3 AS g FROM n
 UNION ALL SELECT r.station_id, st.i, {LIM.format(w='a', s='p')} / {SUM3}, {LIM.format(w='b', s='d')} / {SUM3}, {LIM.format(w='g', s='f')} / {SUM3} FROM rec r JOIN st ON st.station_id = r.station_id AND st.i = r.i + 1)
{OUT3}""", "weight")
TOT = "(coalesce(p, 0) + coalesce(d, 0) + coalesce(f, 0))"
MIX = "(0.7 * {w} + 0.3 * coalesce({s} / " + TOT + ", 0))"
MS = "(" + " + ".join(MIX.format(w=w, s=s) for w, s in (("a", "p"), ("b", "d"), ("g", "f"))) + ")"
q("smoothed_weights", "L14", lambda t: L.smooth_weights(t.errors, MODELS), f"""
WITH RECURSIVE {STEPS}, rec AS (SELECT station_id, CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) / 3 AS a, CAST(1 AS DOUBLE) / 3 AS b, CAST(1 AS DOUBLE) / 3 AS g FROM n
 UNION ALL SELECT r.station_id, st.i, {MIX.format(w='a', s='p')} / {MS}, {MIX.format(w='b', s='d')} / {MS}, {MIX.format(w='g', s='f')} / {MS} FROM rec r JOIN st ON st.station_id = r.station_id AND st.i = r.i + 1)
{OUT3}""", "weight")
q("dynamic_forecast", "L15", lambda t: L.dynamic_forecast(t.forecasts, L.dynamic_weights(t.errors)), f"""
WITH {DW}, pa AS (SELECT station_id, target_ts, sum(weight * yhat) / sum(weight) AS yhat FROM forecasts JOIN dw USING (model, target_ts) GROUP BY 1, 2),
sd AS (SELECT station_id, stddev_pop(yhat) AS d FROM pa GROUP BY 1)
SELECT station_id, target_ts, yhat, greatest(0, yhat - 1.96 * d) AS lower, yhat + 1.96 * d AS upper FROM pa JOIN sd USING (station_id)""", "yhat lower upper")
q("blend_spread", "L16", lambda t: L.blend_spread(t.forecasts), """
WITH u AS (SELECT model, station_id, stddev_pop(yhat) AS u FROM forecasts GROUP BY 1, 2),
g AS (SELECT station_id, target_ts, avg(yhat) AS mean, quantile_cont(yhat, 0.5) AS median, stddev_pop(yhat) AS epistemic, avg(u) AS aleatoric FROM forecasts JOIN u USING (model, station_id) GROUP BY 1, 2)
SELECT *, mean - s AS lower_68, mean + s AS upper_68, mean - 1.96 * s AS lower_95, mean + 1.96 * s AS upper_95 FROM (SELECT *, sqrt(epistemic * epistemic + aleatoric * aleatoric) AS s FROM g)""".replace("SELECT *, mean - s", "SELECT * EXCLUDE (s), mean - s"),
  "mean median epistemic aleatoric lower_68 upper_68 lower_95 upper_95")
TWO = """
tw AS (SELECT a.station_id, a.target_ts, a.y, a.yhat AS fa, b.yhat AS fb, lag(a.y) OVER w AS last_obs, avg(abs(a.err)) OVER k AS ra, avg(abs(b.err)) OVER k AS rb
  FROM errors a JOIN errors b ON a.model = 'persist' AND b.model = 'profile' AND a.station_id = b.station_id AND a.target_ts = b.target_ts
  WINDOW w AS (PARTITION BY a.station_id ORDER BY a.target_ts), k AS (PARTITION BY a.station_id ORDER BY a.target_ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))"""


def blend_sql(d: str, f: str, src: str = "tw", extra: str = "") -> str:
    return f"""
e AS (SELECT *, abs(fa - last_obs) AS ea, abs(fb - last_obs) AS eb, coalesce(ra, abs(fa - last_obs)) AS ua, coalesce(rb, abs(fb - last_obs)) AS ub FROM {src}),
h AS (SELECT *, least(1 - {f}, greatest({f}, ub / (ua + ub))) AS ca, least(1 - {f}, greatest({f}, ua / (ua + ub))) AS cb FROM e),
bl AS (SELECT station_id, target_ts, y, fa, fb, last_obs, ra, rb{extra}, CASE WHEN last_obs IS NULL THEN fa WHEN ea + eb > 1e-6 AND abs(fa - fb) <= {d} THEN
    (CASE WHEN ua + ub > 1e-6 THEN ca / (ca + cb) ELSE 0.6 END) * fa + (1 - CASE WHEN ua + ub > 1e-6 THEN ca / (ca + cb) ELSE 0.6 END) * fb WHEN eb < ea THEN fb ELSE fa END AS yhat,
  CASE WHEN last_obs IS NULL THEN 'a' WHEN ea + eb > 1e-6 AND abs(fa - fb) <= {d} THEN 'blend' WHEN eb < ea THEN 'b' ELSE 'a' END AS chosen FROM h)"""


def _two(t):
    return L.two_model_table(t.errors, "persist", "profile")


q("two_model_blend", "L17", lambda t: L.blend_two(_two(t), 10.0, 0.25), f"WITH {TWO}, {blend_sql('10', '0.25')} SELECT * FROM bl", "y fa fb last_obs ra rb yhat")
q("variation_band", "L18", lambda t: L.cv_band(t.forecasts.select("model", "station_id", "target_ts", "yhat"), 0.9), """
SELECT model, station_id, target_ts, yhat, greatest(0, yhat - yhat * 0.2 * 1.645) AS lower, yhat + yhat * 0.2 * 1.645 AS upper FROM forecasts""", "yhat lower upper")
MB = "mb AS (SELECT model, station_id, hour(target_ts) AS h, avg(err) AS bias, count(*) AS observations FROM errors GROUP BY 1, 2, 3)"
q("offset_correction", "L19", lambda t: L.offset_correct(t.forecasts.select("model", "station_id", "target_ts", "yhat"), L.latest_errors(t.errors), L.mean_bias(t.errors)), f"""
WITH {MB}, le AS (SELECT model, station_id, max_by(err, target_ts) AS err, hour(max(target_ts)) AS h FROM errors GROUP BY 1, 2),
o AS (SELECT le.model, le.station_id, 0.7 * err + 0.3 * bias AS o FROM le JOIN mb ON mb.model = le.model AND mb.station_id = le.station_id AND mb.h = le.h)
SELECT f.model, f.station_id, f.target_ts, yhat, greatest(0, yhat + o + 0.1 * bias) AS corrected FROM forecasts f JOIN o USING (model, station_id)
JOIN mb ON mb.model = f.model AND mb.station_id = f.station_id AND mb.h = hour(f.target_ts)""", "yhat corrected")
BIAS = """
bs AS (SELECT model, station_id, hour(target_ts) AS hour, row_number() OVER k AS i, avg(err) OVER (k ROWS BETWEEN 335 PRECEDING AND CURRENT ROW) AS m, least(336, row_number() OVER k) AS n FROM errors
   WINDOW k AS (PARTITION BY model, station_id, hour(target_ts) ORDER BY target_ts)),
bn AS (SELECT model, station_id, hour, max(i) AS n FROM bs GROUP BY 1, 2, 3),
br AS (SELECT model, station_id, hour, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS bias FROM bn
   UNION ALL SELECT r.model, r.station_id, r.hour, s.i, CASE WHEN s.n >= 24 THEN least(10, greatest(-10, bias + least(0.8, greatest(-0.8, 0.1 * (m - bias))))) ELSE bias END
   FROM br r JOIN bs s ON s.model = r.model AND s.station_id = r.station_id AND s.hour = r.hour AND s.i = r.i + 1),
lb AS (SELECT br.model, br.station_id, br.hour, bias, n AS observations FROM br JOIN bn ON bn.model = br.model AND bn.station_id = br.station_id AND bn.hour = br.hour WHERE i = n)"""
q("learned_bias", "L20", lambda t: L.learn_bias(t.errors), f"WITH RECURSIVE {BIAS} SELECT * FROM lb", "bias")
q("apply_bias", "L21", lambda t: L.apply_bias(t.forecasts.select("model", "station_id", "target_ts", "yhat"), L.learn_bias(t.errors)), f"""
WITH RECURSIVE {BIAS} SELECT f.model, f.station_id, f.target_ts, yhat, greatest(0, yhat + coalesce(bias, 0)) AS corrected FROM forecasts f
LEFT JOIN lb ON lb.model = f.model AND lb.station_id = f.station_id AND lb.hour = hour(f.target_ts)""", "yhat corrected")
q("bias_summary", "L22", lambda t: L.bias_summary(L.mean_bias(t.errors)), f"""
WITH {MB} SELECT model, station_id, avg(bias) AS mean_bias, max(bias) AS max_bias, min(bias) AS min_bias, CAST(sum(observations) AS BIGINT) AS observations FROM mb GROUP BY 1, 2""", "mean_bias max_bias min_bias")
q("learning_rates", "L23", lambda t: L.adapt_rate(t.errors), """
WITH RECURSIVE s AS (SELECT model, station_id, hour(target_ts) AS hour, row_number() OVER (PARTITION BY model, station_id, hour(target_ts) ORDER BY target_ts) AS i, abs(err) AS e FROM errors),
n AS (SELECT model, station_id, hour, max(i) AS n FROM s GROUP BY 1, 2, 3),
r AS (SELECT model, station_id, hour, CAST(0 AS BIGINT) AS i, CAST(0.1 AS DOUBLE) AS rate FROM n
  UNION ALL SELECT r.model, r.station_id, r.hour, s.i, CASE WHEN e > 5 THEN least(0.3, rate * 1.1) WHEN e < 2 THEN greatest(0.05, rate * 0.95) ELSE rate END
  FROM r JOIN s ON s.model = r.model AND s.station_id = r.station_id AND s.hour = r.hour AND s.i = r.i + 1)
SELECT r.model, r.station_id, r.hour, rate FROM r JOIN n ON n.model = r.model AND n.station_id = r.station_id AND n.hour = r.hour WHERE i = n""", "rate")
q("error_trend", "L24", lambda t: L.error_trend(t.errors), """
SELECT model, station_id, recent, older, CASE WHEN n < 10 THEN 'insufficient_data' WHEN recent < older * 0.9 THEN 'improving' WHEN recent > older * 1.1 THEN 'degrading' ELSE 'stable' END AS trend FROM (
  SELECT model, station_id, avg(abs(err)) FILTER (WHERE rn <= 10) AS recent, avg(abs(err)) FILTER (WHERE rn > 10) AS older, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY model, station_id ORDER BY target_ts DESC) AS rn FROM errors) WHERE rn <= 20 GROUP BY 1, 2)""", "recent older")
q("forest_forecast", "L25", lambda t: L.predict_forest(t.met, ["u10", "v10", "t2m_celsius", "blh", "wind_speed"], "pm25", "2024-01-25", trees=100, depth=10))
q("deviation_quantiles", "L26", lambda t: L.std_quantiles(t.forecasts), """
WITH d AS (SELECT model, station_id, stddev_pop(yhat) AS d FROM forecasts GROUP BY 1, 2)
SELECT model, station_id, target_ts, k AS quantile, yhat + d * 2 * (k - 0.5) AS value FROM forecasts JOIN d USING (model, station_id), (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS k)""", "quantile value")
q("bootstrap_forecast", "L27", lambda t: L.bootstrap_forecast(t.readings))
PR = "pr AS (SELECT model, date_trunc('day', target_ts) AS day, avg(abs(err)) AS mae, avg(CASE WHEN abs(err) <= 20 THEN 1 ELSE 0 END) AS coverage FROM errors GROUP BY 1, 2)"
q("recommend_model", "L28", lambda t: L.recommend_model(L.performance_records(t.errors), 0.95), f"""
WITH {PR}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day) AS f, row_number() OVER (PARTITION BY model ORDER BY day DESC) AS l FROM pr),
m AS (SELECT model, avg(mae) AS mae, avg(mae) FILTER (WHERE l <= 3) / avg(mae) FILTER (WHERE f <= 3) AS trend FROM r GROUP BY 1),
w AS (SELECT model, mae, trend, mae * trend * 0.95 AS adaptive, (1 / (mae + 1e-6)) / sum(1 / (mae + 1e-6)) OVER () AS weight FROM m)
SELECT *, (SELECT min_by(model, mae) FROM w) AS best, (SELECT min_by(model, adaptive) FROM w) AS best_adaptive, (SELECT max_by(model, weight) FROM w) AS best_ensemble FROM w""", "mae trend adaptive weight")
q("optimised_weights", "L29", lambda t: L.optimise_weights(L.performance_records(t.errors), L.inverse_error_weights(t.errors)), f"""
WITH {PR}, m AS (SELECT model, 1 / (avg(mae) + 1e-6) * (1 - abs(avg(coverage) - 0.9)) AS raw FROM pr GROUP BY 1),
p AS (SELECT model, (1 / (avg(abs(err)) + 0.001)) AS i FROM errors GROUP BY 1)
SELECT model, raw / sum(raw) OVER () AS optimal, 0.9 * i / sum(i) OVER () + 0.1 * raw / sum(raw) OVER () AS weight FROM m JOIN p USING (model)""", "optimal weight")
q("validation_weights", "L30", lambda t: L.inverse_error_weights(t.errors, 1e-8, ["station_id"]), """
SELECT *, (1 / (mae + 1e-8)) / sum(1 / (mae + 1e-8)) OVER (PARTITION BY station_id) AS weight FROM (SELECT station_id, model, avg(abs(err)) AS mae FROM errors GROUP BY 1, 2)""", "mae weight")
