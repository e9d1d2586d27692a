"""Queries that SQL cannot express, against brute force on small data, and properties of the others."""

import hashlib
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.operators import calibrate, evaluate, explain, forecast, quality, select
from hazewell.sources import readers
from hazewell.sources.adapters import Tables

FOLDER = "/root/testdata/sf0.001"
COLS = ["u10", "v10", "t2m_celsius", "blh", "wind_speed"]
KEYS = ["station_id", "datetime_utc"]


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def test_file_hash_and_inventory(spark, t):
    got = {r.file: (r.sha256, r.length) for r in readers.file_hash(spark, FOLDER).collect()}
    for name in os.listdir(FOLDER):
        body = open(f"{FOLDER}/{name}", "rb").read()
        assert got[name] == (hashlib.sha256(body).hexdigest(), len(body))
    total = [r for r in readers.scan_inventory(spark, FOLDER).collect() if r.extension is None and r.folder is None][0]
    assert total.files == len(got) and total.bytes == sum(n for _, n in got.values())


def test_schema_check(t):
    got = {r.column: r.status for r in quality.check_schema(t.raw, {"value": T.DoubleType(), "parameter": T.LongType(), "altitude": T.DoubleType()}).collect()}
    assert got["value"] == "ok" and got["parameter"] == "wrong type" and got["altitude"] == "missing" and got["unit"] == "extra"


def test_missing_required_column_fails(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="missing required columns"):
        readers.read_table(spark, str(tmp_path / "x"), "readings")


def test_f_scores(t):
    pdf = t.met.toPandas()
    got = {r.feature: r.score for r in select.f_score(t.met, COLS, "pm25").collect()}
    for c in COLS:
        r, n = np.corrcoef(pdf[c], pdf["pm25"])[0, 1], len(pdf)
        assert got[c] == pytest.approx(1 - math.erfc(abs(r) * math.sqrt((n - 2) / (1 - r * r)) / math.sqrt(2)), abs=1e-9)


def test_tree_scores_find_the_driver(t):
    made = t.met.withColumn("target", F.col("blh") * 3 + F.col("u10") * 0.01)
    got = {r.feature: r.score for r in select.tree_score(made, COLS, "target", trees=10, depth=5).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["blh"] + got["t2m_celsius"] > 0.9


def test_ks_statistic(t):
    e = t.errors.filter("model = 'profile'").toPandas()["err"].sort_values().to_numpy()
    z = (e - e.mean()) / e.std()
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    n = len(z)
    want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    assert evaluate.ks_normal(t.errors, "profile").first().statistic == pytest.approx(want, abs=1e-9)


def _weights(df, replicas):
    w = forecast.poisson_weight(F.col("replica"), F.col("station_id"), F.col("datetime_utc"))
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica")).withColumn("w", w).toPandas()


def test_bootstrap_forecast_matches_brute_force(t):
    pdf = _weights(t.readings, 5)
    assert pdf["w"].mean() == pytest.approx(1, abs=0.1)
    pdf["hour"] = pdf["datetime_utc"].dt.hour
    pdf["wy"] = pdf["w"] * pdf["pm25"]
    g = pdf.groupby(["station_id", "hour", "replica"])[["wy", "w"]].sum()
    f = (g["wy"] / g["w"]).groupby(["station_id", "hour"])
    want = pd.DataFrame({"yhat": f.mean(), "std": f.std(ddof=0), "q10": f.quantile(0.1)})
    got = forecast.bootstrap_forecast(t.readings, 5).toPandas().set_index(["station_id", "hour"]).sort_index()
    np.testing.assert_allclose(got[["yhat", "std", "q10"]].to_numpy(), want.loc[got.index].to_numpy(), rtol=1e-9, atol=1e-9)


def test_bootstrap_metrics_surround_the_plain_metric(t):
    bands = calibrate.conformal_apply(t.forecasts, calibrate.conformal_fit(t.errors))
    plain = {r.model: r for r in calibrate.calibration_metrics(bands).collect()}
    for r in calibrate.bootstrap_metrics(bands, 40).collect():
        assert r.low <= r.mean <= r.high
        assert r.mean == pytest.approx(plain[r.model][r.metric], rel=0.05)


def test_permutation_importance_is_near_a_numpy_shuffle(t):
    made = t.met.withColumn("target", F.col("blh") / 100)
    model, va = select.fit_forest(made, COLS, "target", trees=5, depth=5)
    got = {r.feature: r.importance for r in explain.permutation_importance(model, va, made, COLS, "target", KEYS, repeats=2).collect()}
    assert max(got, key=got.get) in ("blh", "t2m_celsius") and got["v10"] < 0.1 * max(got.values())
    again = {r.feature: r.importance for r in explain.permutation_importance(model, va, made, COLS, "target", KEYS, repeats=2).collect()}
    assert again == pytest.approx(got)


def test_stability_and_windows(t):
    s = explain.importance_stability(t.met, COLS, "pm25", KEYS, trees=5, depth=3).collect()
    assert {r.feature for r in s} == set(COLS) and all(r.cv >= 0 for r in s)
    model, va = select.fit_forest(t.met, COLS, "pm25", trees=5, depth=3)
    assert explain.windowed_importance(model, va, t.met, COLS, "pm25", KEYS, rows=[24]).count() == len(COLS)


def test_scenarios_against_direct_predictions(t):
    model, va = select.fit_forest(t.met, COLS, "pm25", trees=5, depth=3)
    base = explain.last_rows(t.met, COLS)
    got = {(r.station_id): r for r in explain.what_if(model, va, base, COLS, {"calm": {"wind_speed": ("multiply", 0.5)}}).collect()}
    direct = model.transform(va.transform(base.withColumn("wind_speed", F.col("wind_speed") * 0.5))).collect()
    for r in direct:
        assert got[r.station_id].scenario_pred == pytest.approx(r.prediction)
        assert got[r.station_id].impact == pytest.approx(r.prediction - got[r.station_id].baseline_pred)
    sens = explain.sensitivity(model, va, base, COLS).collect()
    assert len(sens) == base.count() * len(COLS) and all(r.sensitivity >= 0 for r in sens)
    for r in explain.counterfactuals(model, va, base, COLS).collect():
        goal = r.baseline_pred * 1.2
        assert abs(r.scenario_pred - goal) < abs(r.baseline_pred - goal) and r["rank"] <= 5


def test_made_scenarios(t):
    base = explain.last_rows(t.met, COLS)
    one = explain.make_scenarios(base, COLS, "systematic").collect()
    assert all(len(r.perturbed) == 1 for r in one) and len(one) == base.count() * 5
    ref = {r.station_id: r for r in base.collect()}
    for r in one:
        for c in COLS:
            if c in r.perturbed:
                assert abs(r[c] / ref[r.station_id][c] - 1) <= 0.2
            else:
                assert r[c] == ref[r.station_id][c]


def test_anomalies_find_planted_rows(spark, t):
    odd = t.met.limit(1).withColumn("pm25", F.lit(5000.0)).withColumn("station_id", F.lit(99).cast("bigint"))
    df = t.met.select(*KEYS, "pm25", "blh").unionByName(odd.select(*KEYS, "pm25", "blh"))
    got = explain.anomalies(df, ["pm25", "blh"], KEYS, trees=25).filter("station_id = 99").collect()
    assert len(got) == 1 and got[0].variable == "pm25"


def test_forest_forecast_splits_by_time(t):
    out = forecast.predict_forest(t.met, COLS, "pm25", "2024-01-25", trees=5, depth=3)
    first = out.agg(F.min("datetime_utc")).first()[0]
    assert str(first) >= "2024-01-25" and out.filter("yhat IS NULL").count() == 0


def test_weights_sum_to_one(t):
    for df, keys in ((forecast.dynamic_weights(t.errors), ["target_ts"]), (forecast.adaptive_weights(t.errors, ["persist", "daily", "profile"]), ["station_id"])):
        worst = df.groupBy(*keys).agg(F.sum("weight").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]
        assert worst == pytest.approx(0, abs=1e-9)


def test_gaps_and_rows_fill_the_grid(t):
    g = quality.gaps(t.sparse, "2024-01-01 00:00:00", "2024-01-30 23:00:00").groupBy("station_id").agg(F.sum("slots").alias("s"))
    c = quality.completeness(t.sparse, "2024-01-01 00:00:00", "2024-01-30 23:00:00")
    assert g.join(c, "station_id").filter("s + actual <> expected").count() == 0
