"""Queries of the window operators, rankings and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazewell.operators import windows as W
from hazewell.plans.registry import query as q

c = F.col
OVER = "(PARTITION BY station_id ORDER BY datetime_utc)"
KEY2 = ["station_id", "datetime_utc"]


def new_cols(df, base):
    return df.select(*KEY2, *[x for x in df.columns if x not in base.columns])


def on(table, op, *args, **kw):
    def build(t):
        base = getattr(t, table)
        return new_cols(op(base, *args, **kw), base)
    return build


def tail(n: int) -> str:
    return f"OVER (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def need(x: str, n: int, least: int, expr: str, name: str) -> str:
    return f"CASE WHEN count({x}) {tail(n)} >= {least} THEN {expr} END AS {name}"


SQL_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def lag_sql(src, x, ns, name):
    return f"SELECT station_id, datetime_utc, " + ", ".join(f"lag({x}, {n}) OVER {OVER} AS {name}_{n}" for n in ns) + f" FROM {src}"


def roll_sql(src, cols, ns, stats=("mean", "std", "min", "max")):
    parts = [need(x, n, max(1, n // 2), f"{SQL_STATS[s]}({x}) {tail(n)}", f"{s}_{n}_{x}") for x in cols for n in ns for s in stats]
    return "SELECT station_id, datetime_utc, " + ", ".join(parts) + f" FROM {src}"


def names(stats, ns, cols):
    return " ".join(f"{s}_{n}_{x}" for x in cols for n in ns for s in stats)


ALL = ("mean", "std", "min", "max")
LAGS = [1, 2, 3, 6, 12, 24]
q("target_lags", "E1", on("sparse", W.lags, "pm25", LAGS), lag_sql("sparse", "pm25", LAGS, "lag_pm25"), " ".join(f"lag_pm25_{n}" for n in LAGS))
q("target_time_lags", "E1", on("sparse", W.time_lags, "pm25", [1, 24]), """
SELECT a.station_id, a.datetime_utc, b.pm25 AS tlag_pm25_1, d.pm25 AS tlag_pm25_24 FROM sparse a
LEFT JOIN sparse b ON b.station_id = a.station_id AND b.datetime_utc = a.datetime_utc - INTERVAL 1 HOUR
LEFT JOIN sparse d ON d.station_id = a.station_id AND d.datetime_utc = a.datetime_utc - INTERVAL 24 HOUR""", "tlag_pm25_1 tlag_pm25_24")
q("target_rolling", "E2", on("holed", W.rolling, ["pm25"], [6, 12, 24]), roll_sql("holed", ["pm25"], [6, 12, 24]), names(ALL, [6, 12, 24], ["pm25"]))
q("target_rolling_segmented", "E2", lambda t: new_cols(W.in_segments(
    t.holed, lambda d, keys: W.rolling(d, ["pm25"], [6, 24], keys=keys), back=23, segment_rows=100), t.holed),
  roll_sql("holed", ["pm25"], [6, 24]), names(ALL, [6, 24], ["pm25"]))
def _segmented_lags(t):
    return new_cols(W.in_segments(t.sparse, lambda d, keys: W.lags(d, "pm25", [1, 24], keys=keys), back=24, segment_rows=40), t.sparse)


q("target_lags_segmented", "E1", _segmented_lags, lag_sql("sparse", "pm25", [1, 24], "lag_pm25"), "lag_pm25_1 lag_pm25_24")


def slope_sql(src):
    parts = [need("pm25", n, max(2, n // 2), f"regr_slope(pm25, n) {tail(n)}", f"slope_{n}") for n in (6, 24)]
    return ("SELECT station_id, datetime_utc, " + ", ".join(parts) +
            f" FROM (SELECT *, count(pm25) OVER {OVER} AS n FROM {src})")


q("rolling_slope", "E3", on("holed", W.rolling_slope, "pm25", [6, 24]), slope_sql("holed"), "slope_6 slope_24")
MET = ["wind_speed", "wind_direction", "t2m_celsius", "blh"]


def _met_lags(t):
    out = t.met
    for x in MET:
        out = W.lags(out, x, [1, 3, 6, 12])
    return new_cols(out, t.met)


q("met_lags", "E4", _met_lags, "SELECT station_id, datetime_utc, " + ", ".join(
    f"lag({x}, {n}) OVER {OVER} AS lag_{x}_{n}" for x in MET for n in (1, 3, 6, 12)) + " FROM met",
  " ".join(f"lag_{x}_{n}" for x in MET for n in (1, 3, 6, 12)))
MR = ["wind_speed", "t2m_celsius", "blh"]
q("met_rolling", "E5", on("met", W.rolling, MR, [6, 24]), roll_sql("met", MR, [6, 24]), names(ALL, [6, 24], MR))
q("wind_speed_std", "E6", on("met", W.rolling, ["wind_speed"], [6, 12, 24], ("std",)), roll_sql("met", ["wind_speed"], [6, 12, 24], ("std",)),
  names(["std"], [6, 12, 24], ["wind_speed"]))
q("wind_consistency", "E7", on("met", W.wind_consistency, "wind_direction", [6, 12, 24]), "SELECT station_id, datetime_utc, " + ", ".join(
    need("wind_direction", n, n // 2, f"sqrt(pow(avg(sin(radians(wind_direction))) {tail(n)}, 2) + pow(avg(cos(radians(wind_direction))) {tail(n)}, 2))",
         f"consistency_{n}") for n in (6, 12, 24)) + " FROM met", "consistency_6 consistency_12 consistency_24")


def diff_sql(src, x, ns, name, per=False):
    return "SELECT station_id, datetime_utc, " + ", ".join(
        f"({x} - lag({x}, {n}) OVER {OVER}){f' / {n}' if per else ''} AS {name}_{n}" for n in ns) + f" FROM {src}"


q("wind_shear", "E8", on("met", W.diffs, "wind_speed", [1, 3, 6], "shear"), diff_sql("met", "wind_speed", [1, 3, 6], "shear"), "shear_1 shear_3 shear_6")


def _sector_mode(t):
    from hazewell.functions import rules as R
    return W.sector_mode(t.met.withColumn("sector", R.wind_sector(c("wind_direction"))), "sector").select(*KEY2, "sector_mode")


q("wind_sector_mode", "E9", _sector_mode, """
WITH s AS (SELECT station_id, datetime_utc, CAST(floor((wind_direction + 11.25) / 22.5) AS BIGINT) % 16 AS sector,
             row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc) AS rn FROM met),
n AS (SELECT a.station_id, a.datetime_utc, a.rn, b.sector, count(*) AS k FROM s a JOIN s b ON a.station_id = b.station_id AND b.rn BETWEEN a.rn - 23 AND a.rn GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY station_id, rn ORDER BY k DESC, sector) AS pos FROM n)
SELECT station_id, datetime_utc, CASE WHEN rn >= 12 THEN sector END AS sector_mode FROM m WHERE pos = 1""")
q("temperature_range", "E10", on("met", W.temp_range, "t2m_celsius"), "SELECT station_id, datetime_utc, " + ", ".join(
    need("t2m_celsius", n, max(6, n // 4), f"max(t2m_celsius) {tail(n)} - min(t2m_celsius) {tail(n)}", f"range_{n}") + ", " +
    need("t2m_celsius", n, max(6, n // 4), f"t2m_celsius - avg(t2m_celsius) {tail(n)}", f"amplitude_{n}") for n in (24, 48)) + " FROM met",
  "range_24 range_48 amplitude_24 amplitude_48")
q("temperature_gradient", "E11", on("met", W.diffs, "t2m_celsius", [1, 3, 6], "gradient", True), diff_sql("met", "t2m_celsius", [1, 3, 6], "gradient", True),
  "gradient_1 gradient_3 gradient_6")
q("boundary_layer_growth", "E12", on("met", W.diffs, "blh", [1, 3, 6], "growth"), diff_sql("met", "blh", [1, 3, 6], "growth"), "growth_1 growth_3 growth_6")
q("boundary_layer_normalised", "E13", on("met", W.centred_normalised, "blh"), """
SELECT station_id, datetime_utc, CASE WHEN n >= 12 AND hi > lo THEN (blh - lo) / (hi - lo) ELSE 0.5 END AS normalised FROM (
  SELECT *, min(blh) OVER w AS lo, max(blh) OVER w AS hi, count(blh) OVER w AS n FROM met
  WINDOW w AS (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))""", "normalised")
q("relative_pollution", "E14", on("holed", W.relative_pollution), f"""
SELECT station_id, datetime_utc, (pm25 - b) / (b + 1) AS relative_pollution FROM (
  SELECT *, {need('pm25', 24, 12, f'avg(pm25) {tail(24)}', 'b')} FROM holed)""", "relative_pollution")
q("regional_trend", "E15", on("readings", W.regional_trend, "pm25"), f"""
SELECT station_id, datetime_utc, avg(pm25) {tail(24)} AS trend_mean_24, sum(pm25) {tail(48)} AS accumulation_48 FROM readings""", "trend_mean_24 accumulation_48")
q("regional_differences", "E16", on("readings", W.diffs, "pm25", [6, 12, 24], "trend"), diff_sql("readings", "pm25", [6, 12, 24], "trend"), "trend_6 trend_12 trend_24")
q("row_position", "E17", on("sparse", W.row_position), f"SELECT station_id, datetime_utc, row_number() OVER {OVER} - 1 AS position FROM sparse")
q("global_position", "E18", on("sparse", W.global_position), """
SELECT station_id, datetime_utc, row_number() OVER (ORDER BY station_id, datetime_utc) - 1 AS global_position FROM sparse""")


def _seq_cols():
    cols = [f"lag_pm25_{n}" for n in (1, 24, 168)] + [f"{s}_{n}_pm25" for n in (3, 24, 168) for s in ALL] + ["diff_1", "diff_24"]
    return cols


q("sequence_features", "E19", on("readings", W.sequence_features), f"""
SELECT station_id, datetime_utc, {', '.join(f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({x} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {x}" for x in _seq_cols())}
FROM (SELECT station_id, datetime_utc, {', '.join(f"lag(pm25, {n}) OVER {OVER} AS lag_pm25_{n}" for n in (1, 24, 168))},
  {', '.join(need('pm25', n, n, f"{SQL_STATS[s]}(pm25) {tail(n)}", f"{s}_{n}_pm25") for n in (3, 24, 168) for s in ALL)},
  pm25 - lag(pm25, 1) OVER {OVER} AS diff_1, pm25 - lag(pm25, 24) OVER {OVER} AS diff_24 FROM readings)""", " ".join(_seq_cols()))


def _sequences(t):
    s = W.sequences(t.readings)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    return s.select("station_id", "start", F.size("context").alias("n_context"), F.size("target").alias("n_target"), mean(c("context")).alias("context_mean"),
                    mean(c("target")).alias("target_mean"), F.element_at("context", -1).alias("context_last"), F.element_at("target", 1).alias("target_first"))


q("context_target_sequences", "E20", _sequences, """
SELECT station_id, datetime_utc AS start, 96 AS n_context, 24 AS n_target, cm AS context_mean, tm AS target_mean, cl AS context_last, tf AS target_first FROM (
  SELECT *, row_number() OVER w - 1 AS p, count(*) OVER c AS nc, count(*) OVER t AS nt, avg(pm25) OVER c AS cm, avg(pm25) OVER t AS tm,
    lead(pm25, 95) OVER w AS cl, lead(pm25, 96) OVER w AS tf FROM readings
  WINDOW w AS (PARTITION BY station_id ORDER BY datetime_utc),
    c AS (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN CURRENT ROW AND 95 FOLLOWING),
    t AS (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN 96 FOLLOWING AND 119 FOLLOWING))
WHERE p % 24 = 0 AND nc = 96 AND nt = 24""", "context_mean target_mean context_last target_first")
q("score_trend", "E21", on("readings", W.score_trend, "pm25"), f"""
SELECT station_id, datetime_utc, avg(pm25) {tail(100)} AS score_mean, stddev_pop(pm25) {tail(100)} AS score_std FROM readings""", "score_mean score_std")
q("pollution_regressors", "E22", on("holed", W.pollution_regressors), f"""
SELECT station_id, datetime_utc, {', '.join(f"coalesce(last_value(l{n} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY datetime_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m) AS lag_{n}" for n in (1, 24, 168))},
  coalesce(a24, m) AS mean_24, coalesce(s24, s) AS std_24, coalesce(a168, m) AS mean_168
FROM (SELECT *, {', '.join(f"lag(pm25, {n}) OVER {OVER} AS l{n}" for n in (1, 24, 168))}, avg(pm25) {tail(24)} AS a24, stddev_samp(pm25) {tail(24)} AS s24,
        avg(pm25) {tail(168)} AS a168, avg(pm25) OVER (PARTITION BY station_id) AS m, stddev_samp(pm25) OVER (PARTITION BY station_id) AS s FROM holed)""",
  "lag_1 lag_24 lag_168 mean_24 std_24 mean_168")
q("rank_features", "E23", lambda t: W.rank_by(t.scores, "score", ["feature"], ["method"]), """
SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rank FROM scores""", "score")
q("time_since_start", "E24", lambda t: W.time_since_start(t.sparse).drop("pm25"), """
SELECT station_id, datetime_utc, (epoch(datetime_utc) - s) / 3600 AS hours_since_start, (epoch(datetime_utc) - s) / (e - s) AS share_of_span
FROM sparse, (SELECT min(epoch(datetime_utc)) AS s, max(epoch(datetime_utc)) AS e FROM sparse)""", "hours_since_start share_of_span")

q("top_features_per_method", "F1", lambda t: W.top_features(t.scores, 5), """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rank FROM scores) WHERE rank <= 5""", "score")


def _mean_scores(t):
    return t.scores.groupBy("feature").agg(F.avg("score").alias("score"))


q("select_top_with_floor", "F2", lambda t: W.select_top(_mean_scores(t), 20), """
WITH s AS (SELECT feature, avg(score) AS score FROM scores GROUP BY 1)
SELECT * FROM (SELECT * FROM s WHERE score >= 0.1 ORDER BY score DESC, feature LIMIT 20)
UNION ALL SELECT * FROM (SELECT * FROM s WHERE (SELECT count(*) FROM s WHERE score >= 0.1) = 0 ORDER BY feature LIMIT 10)""", "score")
q("sorted_readings", "F3", lambda t: W.sorted_output(t.readings), "SELECT * FROM readings ORDER BY station_id, datetime_utc", "pm25")
q("last_rows_per_station", "F4", lambda t: W.last_n(t.sparse, 48, ["datetime_utc"]), """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime_utc DESC) AS rn FROM sparse) WHERE rn <= 48""", "pm25")
q("latest_reading", "F5", lambda t: W.latest(t.holed), """
SELECT station_id, max(datetime_utc) AS datetime_utc, max_by(pm25, datetime_utc) AS pm25 FROM holed WHERE pm25 IS NOT NULL GROUP BY 1""", "pm25")


def _trials(t):
    return t.errors.groupBy("model", "horizon").agg(F.avg(F.abs("err")).alias("mae"))


q("best_trial", "F6", lambda t: W.best_trial(_trials(t), ["model", "horizon"]), """
SELECT avg(abs(err)) AS mae, model, horizon FROM errors GROUP BY model, horizon ORDER BY mae, model, horizon LIMIT 1""", "mae")
q("best_stations", "F7", lambda t: W.best_stations(t.stations).select("station_id", "quality_score", "missingness_pct", "data_span_days"), """
SELECT station_id, quality_score, missingness_pct, data_span_days FROM stations WHERE quality_score >= 0.7 AND missingness_pct <= 30 AND data_span_days >= 20""",
  "quality_score missingness_pct")
