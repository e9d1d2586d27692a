"""Queries of feature statistics and selection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hazewell.operators import select as K
from hazewell.operators.neighbours import mi_neighbours
from hazewell.plans.registry import query as q

c = F.col
KEYS = ["station_id", "datetime_utc"]
BASE = ["u10", "v10", "t2m_celsius", "blh", "wind_speed", "wind_direction"]
WIDE = [*BASE, "flat", "u_copy", "scarce", "tiny"]


def _wide(t):
    return t.met.select("*", F.lit(1.0).alias("flat"), c("u10").alias("u_copy"), F.when(c("pm25") < 30, c("v10")).alias("scarce"), (c("u10") / 997).alias("tiny"),
                        F.when(c("blh") > 900, float("inf")).otherwise(c("blh")).alias("spiky"))


W = """w AS (SELECT *, CAST(1 AS DOUBLE) AS flat, u10 AS u_copy, CASE WHEN pm25 < 30 THEN v10 END AS scarce, u10 / 997 AS tiny,
  CASE WHEN blh > 900 THEN CAST('inf' AS DOUBLE) ELSE blh END AS spiky FROM met)"""


def each(cols, text):
    return " UNION ALL ".join(text.format(x=x) for x in cols)


NUL = "count(*) FILTER (WHERE {x} IS NULL) / count(*)"
q("null_infinite_profile", "K1", lambda t: K.null_inf_profile(_wide(t), [*WIDE, "spiky"]), f"WITH {W} " + each([*WIDE, "spiky"], f"SELECT '{{x}}' AS feature, {NUL} AS null_share, count(*) FILTER (WHERE isinf({{x}})) AS infinite FROM w"), "null_share")
q("constant_columns", "K2", lambda t: K.constant_cols(_wide(t), WIDE), f"WITH {W} SELECT feature FROM (" + each(WIDE, "SELECT '{x}' AS feature, count(DISTINCT {x}) AS n FROM w") + ") WHERE n <= 1")
q("low_variance_columns", "K3", lambda t: K.low_variance(_wide(t), WIDE), f"WITH {W} SELECT * FROM (" + each(WIDE, "SELECT '{x}' AS feature, var_samp({x}) AS variance FROM w") + ") WHERE variance < 0.001", "variance")
PAIRS = list(combinations(WIDE, 2))
q("duplicate_columns", "K4", lambda t: K.duplicate_cols(_wide(t), WIDE, KEYS), f"WITH {W} SELECT a, b FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) AS d FROM w" for a, b in PAIRS) + ") WHERE d = 0")
CP = "cp AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM w" for a, b in PAIRS if "flat" not in (a, b)) + ") WHERE abs(r) > 0.95)"
q("correlated_pairs", "K5", lambda t: K.corr_pairs(_wide(t), WIDE), f"WITH {W}, {CP} SELECT * FROM cp", "r")
NOCOPY = [x for x in WIDE if x not in ("u_copy",)]
CP2 = "cp AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM w" for a, b in combinations(NOCOPY, 2) if "flat" not in (a, b)) + ") WHERE abs(r) > 0.95)"
VV = "vv AS (" + each(WIDE, "SELECT '{x}' AS feature, var_samp({x}) AS v FROM w") + ")"
q("drop_correlated", "K6", lambda t: K.drop_correlated(_wide(t), NOCOPY), f"""
WITH {W}, {CP2}, {VV} SELECT DISTINCT CASE WHEN x.v < y.v THEN a ELSE b END AS feature FROM cp JOIN vv x ON x.feature = a JOIN vv y ON y.feature = b""")
q("drop_sparse", "K7", lambda t: K.drop_sparse(_wide(t), WIDE, 0.3), f"WITH {W} SELECT * FROM (" + each(WIDE, f"SELECT '{{x}}' AS feature, {NUL} AS null_share FROM w") + ") WHERE null_share > 0.3", "null_share")
FS = [*BASE, "scarce"]
q("feature_statistics", "K8", lambda t: K.feature_stats(_wide(t), FS, "pm25"), f"WITH {W} " + each(FS, """
SELECT '{x}' AS feature, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max, avg(pow({x} - m, 3)) / pow(stddev_pop({x}), 3) AS skewness,
  kurtosis_pop({x}) AS kurtosis, coalesce(corr({x}, pm25), 0) AS target_corr, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q75
FROM w, (SELECT avg({x}) AS m FROM w)"""), "mean std min max skewness kurtosis target_corr q25 median q75")
q("categorical_statistics", "K9", lambda t: K.categorical_stats(t.raw, "sensor_id"), """
WITH n AS (SELECT sensor_id AS v, count(*) AS n FROM raw_meas GROUP BY 1), t AS (SELECT sum(n) AS t FROM n)
SELECT count(*) AS distinct_values, (SELECT v FROM n ORDER BY n DESC, v LIMIT 1) AS mode, max(n) AS mode_count, max(n / t) AS mode_share, -sum(n / t * log2(n / t + 1e-10)) AS entropy FROM n, t""", "mode_share entropy")
q("feature_quality", "K10", lambda t: K.feature_quality(_wide(t), WIDE, KEYS), f"""
WITH {W}, {CP}, s AS (SELECT avg(ns) AS missing, 0 AS infinite, (SELECT count(*) FROM cp) AS correlated FROM ({each(WIDE, f"SELECT {NUL} AS ns FROM w")}))
SELECT missing, infinite, 1 AS constant, 1 AS duplicate, correlated,
  1 - least(0.5, missing * 2) - least(0.2, 0.05) - least(0.1, 0.03) - least(0.15, correlated / 10 * 0.2) AS score FROM s""", "missing score")
q("f_test_scores", "K11", lambda t: K.f_score(_wide(t), BASE, "pm25"))
q("correlation_scores", "K12", lambda t: K.corr_score(_wide(t), BASE, "pm25"), f"WITH {W} " + each(BASE, "SELECT '{x}' AS feature, abs(corr({x}, pm25)) AS score FROM w"), "score")


def _bins(x):
    return " + ".join(f"CASE WHEN {x} > (SELECT quantile_cont({x}, {i / 8}) FROM met) THEN 1 ELSE 0 END" for i in range(1, 8))


q("mutual_information", "K13", lambda t: K.mi_score(t.met, ["u10", "blh"], "pm25"), f"""
WITH y AS (SELECT u10, blh, {_bins('pm25')} AS yb, {_bins('u10')} AS bu, {_bins('blh')} AS bb FROM met),
j AS (SELECT 'u10' AS feature, bu AS bx, yb, count(*) AS n FROM y GROUP BY ALL UNION ALL SELECT 'blh', bb, yb, count(*) FROM y GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, yb) AS ny, sum(n) OVER (PARTITION BY feature) AS nt FROM j)
SELECT feature, sum(n / nt * ln(n * nt / (nx * ny))) AS score FROM p GROUP BY 1""", "score")
q("mutual_information_neighbours", "K13 neighbours", lambda t: mi_neighbours(t.met, BASE, "pm25", KEYS))
q("tree_scores", "K14", lambda t: K.tree_score(t.met, BASE, "pm25", trees=100, depth=10))
q("combined_scores", "K15", lambda t: K.combine_scores(t.scores), """
SELECT feature, avg(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score > 0 THEN 1 ELSE 0 END) AS score
FROM scores JOIN (SELECT method, min(score) AS lo, max(score) AS hi FROM scores GROUP BY 1) USING (method) GROUP BY 1""", "score")
KIND = {"multiplicative": "{a} * {b}", "ratio": "{a} / ({b} + 1e-8)", "difference": "{a} - {b}", "polynomial": "{a} * {a} + {b} * {b}",
        "log_ratio": "CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} + 1) - ln({b} + 1) END"}
IC = ["u10", "t2m_celsius", "blh", "wind_speed"]
q("find_interactions", "K16", lambda t: K.find_interactions(t.met, IC, "v10", top=20), """
SELECT a, b, kind, abs(r) AS score, n FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, '{k}' AS kind, corr({e.format(a=a, b=b)}, v10) AS r, count({e.format(a=a, b=b)}) AS n FROM met" for a, b in combinations(IC, 2) for k, e in KIND.items()) + """)
WHERE abs(r) >= 0.1 AND n > 10 AND abs(r) * sqrt((n - 2) / (1 - r * r)) > 1.96 ORDER BY score DESC, a, b, kind LIMIT 20""", "score")
q("domain_interactions", "K17", lambda t: K.domain_interactions(t.met, KEYS), """
SELECT station_id, datetime_utc, wind_speed * blh AS wind_speed_x_blh, t2m_celsius * wind_speed AS t2m_celsius_x_wind_speed, blh / (t2m_celsius + 1e-8) AS blh_div_t2m_celsius FROM met""",
  "wind_speed_x_blh t2m_celsius_x_wind_speed blh_div_t2m_celsius")
DI = ["wind_speed_x_blh", "t2m_celsius_x_wind_speed", "blh_div_t2m_celsius"]
q("interaction_statistics", "K18", lambda t: K.interaction_stats(K.domain_interactions(t.met, [*KEYS, "pm25"]), DI, "pm25"), """
WITH d AS (SELECT pm25, wind_speed * blh AS wind_speed_x_blh, t2m_celsius * wind_speed AS t2m_celsius_x_wind_speed, blh / (t2m_celsius + 1e-8) AS blh_div_t2m_celsius FROM met) """ + each(DI, f"""
SELECT '{{x}}' AS feature, avg({{x}}) AS mean, stddev_samp({{x}}) AS std, min({{x}}) AS min, max({{x}}) AS max, {NUL} AS missing, corr({{x}}, pm25) AS target_corr FROM d"""),
  "mean std min max missing target_corr")
q("select_by_correlation", "K19", lambda t: K.select_n(t.met, BASE, "pm25", 3), "SELECT * FROM (" + each(BASE, "SELECT '{x}' AS feature, abs(corr({x}, pm25)) AS score FROM met") + ") ORDER BY score DESC LIMIT 3", "score")
q("select_by_variance", "K19", lambda t: K.select_n(t.met, BASE, "pm25", 3, "variance"), "SELECT * FROM (" + each(BASE, "SELECT '{x}' AS feature, var_samp({x}) AS score FROM met") + ") ORDER BY score DESC LIMIT 3", "score")
q("rank_target_and_nulls", "K20", lambda t: K.rank_features(_wide(t), [*BASE, "scarce"], "pm25", 4), f"WITH {W} SELECT * FROM (SELECT 'correlation' AS ranking, * FROM (" + each(
    [*BASE, "scarce"], "SELECT '{x}' AS feature, abs(corr({x}, pm25)) AS value FROM w") + ") ORDER BY value DESC LIMIT 4) UNION ALL SELECT 'nulls', 'scarce', count(*) FILTER (WHERE scarce IS NULL) FROM w", "value")
