"""Hand-made tables with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hazewell.functions import rules as R
from hazewell.functions import scalars as S
from hazewell.operators import agg, alerts, calibrate, clean, evaluate, forecast, joins, quality
from hazewell.operators import windows as W
from hazewell.operators.quantiles import exact_quantiles

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, station=1, start=T0, hours=None):
    hours = hours if hours is not None else range(len(values))
    rows = [(station, start + dt.timedelta(hours=h), None if v is None else float(v)) for h, v in zip(hours, values)]
    return spark.createDataFrame(rows, "station_id BIGINT, datetime_utc TIMESTAMP, pm25 DOUBLE")


def column(df, name, order="datetime_utc"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def test_lags_and_rolling(spark):
    df = series(spark, range(1, 9))
    assert column(W.lags(df, "pm25", [1]), "lag_pm25_1") == [None, 1, 2, 3, 4, 5, 6, 7]
    assert column(W.rolling(df, ["pm25"], [6], ("mean",)), "mean_6_pm25") == [None, None, 2.0, 2.5, 3.0, 3.5, 4.5, 5.5]


def test_slope_is_two_and_flat_is_zero(spark):
    got = column(W.rolling_slope(series(spark, [2, 4, 6, 8, 10, 12]), "pm25", [6]), "slope_6")
    assert got[:2] == [None, None] and got[2:] == pytest.approx([2.0] * 4)
    assert column(W.rolling_slope(series(spark, [5] * 6), "pm25", [6]), "slope_6")[2:] == pytest.approx([0.0] * 4)


def test_slope_skips_nulls(spark):
    got = column(W.rolling_slope(series(spark, [1, None, 2, None, 3, 4]), "pm25", [6]), "slope_6")
    assert got[-1] == pytest.approx(1.0)


def test_wind_consistency(spark):
    got = column(W.wind_consistency(series(spark, [0, 180]), "pm25", [2]), "consistency_2")
    assert got == pytest.approx([1.0, 0.0], abs=1e-12)


def test_interpolation_limit(spark):
    values = [1] + [None] * 8 + [10, None, None]
    got = column(clean.interpolate_limit(series(spark, values), 6, ["pm25"]), "pm25_filled")
    assert got[:7] == pytest.approx([1, 2, 3, 4, 5, 6, 7])
    assert got[7:9] == [None, None] and got[9:] == [10, 10, 10]
    assert column(clean.interpolate_limit(series(spark, [None, 3]), 6, ["pm25"]), "pm25_filled") == [None, 3]


def test_gap_islands(spark):
    df = series(spark, [1] * 6, hours=[0, 1, 2, 6, 7, 9])
    g = quality.gaps(df, "2024-01-01 00:00:00", "2024-01-01 09:00:00").orderBy("gap_start").collect()
    assert [(r.gap_start.hour, r.gap_end.hour, r.slots) for r in g] == [(3, 5, 3), (8, 8, 1)]


def test_gaps_reach_the_edges(spark):
    g = quality.gaps(series(spark, [1], hours=[5]), "2024-01-01 00:00:00", "2024-01-01 09:00:00").orderBy("gap_start").collect()
    assert [(r.gap_start.hour, r.gap_end.hour) for r in g] == [(0, 4), (6, 9)]


def test_aqi_edges(spark):
    df = spark.createDataFrame([(v,) for v in (12.0, 35.4, 55.4, 150.4, 250.4, 350.4)], "x DOUBLE")
    r = df.select(S.aqi(F.col("x")).alias("a"), S.aqi(F.col("x"), legacy=True).alias("b")).collect()
    assert [x.a for x in r] == pytest.approx([50, 100, 150, 200, 300, 400])
    assert r[3].b == pytest.approx(250)


def test_aqi_is_monotone(spark):
    df = spark.range(0, 4000).select((F.col("id") / 10).alias("x"))
    got = [r.a for r in df.orderBy("x").select(S.aqi(F.col("x")).alias("a")).collect()]
    assert all(b >= a for a, b in zip(got, got[1:]))


def test_bins_open_on_the_left(spark):
    df = spark.createDataFrame([(0.0,)], "x DOUBLE")
    r = df.select(R.aqi_label(F.col("x")).alias("a"), R.bl_class(F.col("x")).alias("b"), R.wind_class(F.col("x")).alias("w"), R.uhi_class(F.col("x")).alias("u")).first()
    assert (r.a, r.b, r.w, r.u) == ("nan", "nan", "calm", "nan")


def test_half_hours_round_to_even(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=30),), (T0 + dt.timedelta(minutes=90),), (T0 + dt.timedelta(minutes=31),)], "t TIMESTAMP")
    assert [r.h.hour for r in df.select(S.round_hour(F.col("t")).alias("h")).collect()] == [0, 2, 1]


def test_ar1_path(spark):
    df = spark.range(1, 4).select(forecast.ar1_path(F.lit(0.5), F.lit(1.0), F.lit(4.0), F.col("id").cast("double")).alias("v"))
    assert [r.v for r in df.collect()] == pytest.approx([3, 2.5, 2.25])


def test_ar1_of_a_constant_series(spark):
    r = forecast.ar1_fit(series(spark, [7.0] * 20)).first()
    assert r.coef == 0.0 and r.centre == 7.0


def test_pinball(spark):
    df = spark.createDataFrame([("m", 0.9, 12.0, 10.0), ("m", 0.9, 8.0, 10.0)], "model STRING, quantile DOUBLE, actual DOUBLE, yhat DOUBLE")
    assert evaluate.pinball(df).first().loss == pytest.approx(1.0)


def errors(spark, errs, model="m"):
    rows = [(model, 1, T0 + dt.timedelta(hours=i), 0.0, float(e), float(e)) for i, e in enumerate(errs)]
    return spark.createDataFrame(rows, "model STRING, station_id BIGINT, target_ts TIMESTAMP, yhat DOUBLE, y DOUBLE, err DOUBLE")


def test_conformal_threshold(spark):
    assert calibrate.conformal_fit(errors(spark, range(1, 11))).first().threshold == pytest.approx(9.1)
    assert calibrate.conformal_fit(errors(spark, range(1, 11)), finite_sample=True).first().threshold == 10


def test_online_quantile_tends_to_its_level(spark):
    e = errors(spark, [(i * 37) % 100 for i in range(4000)])
    up = calibrate.online_quantile(e, 0.9, 1.0).first().threshold
    legacy = calibrate.online_quantile(e, 0.9, 1.0, legacy=True).first().threshold
    assert up == pytest.approx(90, abs=5) and legacy == pytest.approx(10, abs=5)


def test_quiet_hours(spark):
    df = spark.createDataFrame([(23,), (6,), (12,)], "h INT")
    assert [r.q for r in df.select(alerts.in_quiet_hours(F.col("h"), F.lit(22), F.lit(7)).alias("q")).collect()] == [True, True, False]


def test_record_quality_counts(spark):
    rows = [(i, 3459 + i % 3, "pm25", 25.0 + i % 50, T0 + dt.timedelta(hours=i)) for i in range(100)]
    bad = {0: (None, 0), 1: (-5.0, 1), 2: (1500.0, 2), 3: (30.0, None), 4: (None, 4)}
    rows = [(i, s, p, bad[i][0] if i in bad else v, (t if i != 3 else None)) for i, s, p, v, t in rows]
    rows += [(100 + k, *rows[10 + k][1:]) for k in range(5)]
    df = spark.createDataFrame(rows, "event_id BIGINT, station_id BIGINT, parameter STRING, value DOUBLE, datetime_utc TIMESTAMP")
    m = quality.quality_score(quality.record_quality(df)).first()
    assert (m.total, m.missing, m.duplicates, m.outliers, m.valid) == (105, 3, 5, 2, 95)
    assert m.score == pytest.approx(0.4 * 95 / 105 + 0.3 * (1 - 3 / 105) + 0.2 * (1 - 5 / 105) + 0.1 * (1 - 2 / 105))
    empty = quality.quality_score(quality.record_quality(df.filter("false"))).first()
    assert empty.score == 0.0


def test_rain_resample(spark):
    rows = [(T0 + dt.timedelta(minutes=30 * i), v, 100, 100) for i, v in enumerate([2.5, 1.5, 3.0, 2.0])]
    df = spark.createDataFrame(rows, "datetime_utc TIMESTAMP, precipitation_mm_30min DOUBLE, valid_pixels INT, total_pixels INT")
    assert column(agg.resample_hourly(df), "precipitation_mm_hourly") == [4.0, 5.0]


def test_coverage_of_a_sensor(spark):
    rows = [(7, T0 + dt.timedelta(hours=i), 1.0) for i in range(700)]
    df = spark.createDataFrame(rows, "sensor_id BIGINT, datetime_utc TIMESTAMP, value DOUBLE")
    r = quality.sensor_coverage(df, "2024-01-01", "2024-02-01").first()
    assert (r.expected, r.actual) == (744, 700) and r.missing_pct == pytest.approx(5.9, abs=0.05)


def test_distance_to_itself_is_zero(spark):
    df = spark.range(1).select(S.haversine(F.lit(27.7), F.lit(85.3), F.lit(27.7), F.lit(85.3)).alias("d"))
    assert df.first().d == 0.0


def test_acceptance_gate(spark):
    st = spark.createDataFrame([(i, 27.7 + i * 0.01, 85.3, 0.9, 10.0, 500) for i in range(3)],
                               "station_id INT, latitude DOUBLE, longitude DOUBLE, quality_score DOUBLE, missingness_pct DOUBLE, data_span_days INT")
    days = spark.createDataFrame([(24, "", True, True)], "hours INT, missing STRING, ok_hours BOOLEAN, ok BOOLEAN")
    rain = spark.createDataFrame([(True,)], "ok BOOLEAN")
    assert quality.acceptance(st, days, rain, 27.7, 85.3).first().accepted
    assert not quality.acceptance(st.limit(2), days, rain, 27.7, 85.3).first().accepted


def test_exact_quantiles_of_a_large_skewed_group(spark):
    """Above the sketch's own size the bracket is used; a third of the rows share one value."""
    n = 150_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.col("id") / 1000.0, 2)).alias("x"), F.lit("k").alias("g"))
    import numpy as np

    x = np.array([r.x for r in df.select("x").collect()])
    for probs in ([0.25, 0.5, 0.9], [0.0, 1.0], [0.05]):
        got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
        for p in probs:
            assert got[p] == pytest.approx(float(np.quantile(x, p)), rel=1e-12)


def test_station_pairs_match_brute_force(spark):
    import random

    random.seed(1)
    pts = [(i, random.uniform(26, 30), random.uniform(80, 88)) for i in range(60)]
    df = spark.createDataFrame(pts, "station_id INT, latitude DOUBLE, longitude DOUBLE")

    def hav(a, b):
        dla, dlo = math.radians(b[1] - a[1]) / 2, math.radians(b[2] - a[2]) / 2
        return 2 * 6371 * math.asin(math.sqrt(math.sin(dla) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(dlo) ** 2))

    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and hav(a, b) <= 90}
    assert {(r.a_id, r.b_id) for r in joins.station_pairs(df, 90).collect()} == want
    near = {r.station_id: r.km for r in quality.nearest_neighbour(df).collect()}
    for a in pts:
        assert near[a[0]] == pytest.approx(min(hav(a, b) for b in pts if b[0] != a[0]))
