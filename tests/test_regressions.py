"""Additive models, autoregressions and residual tests against plain least squares on the whole series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazewell.operators import evaluate, regress

START = dt.datetime(2022, 1, 1)
ROWS = "station_id long, datetime_utc timestamp, pm25 double, wind double"


def series(n, seed, level=40.0):
    rnd = np.random.Generator(np.random.PCG64(seed))
    h = np.arange(n)
    y = level + 0.01 * h + np.where(h > n // 2, -0.02 * (h - n // 2), 0) + 6 * np.sin(2 * np.pi * h / 24) + 3 * np.cos(2 * np.pi * h / 168) + rnd.normal(size=n)
    wind = rnd.gamma(2, 2, n)
    return y - 0.8 * wind, wind


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for s, n in ((1, 3000), (2, 700), (3, 30)):
        y, wind = series(n, s)
        rows += [(s, START + dt.timedelta(hours=i), None if i % 97 == 5 else float(a), float(b)) for i, (a, b) in enumerate(zip(y, wind))]
    rows += [(4, START, 5.0, 1.0), (5, START, None, 1.0)]
    return spark.createDataFrame(rows, ROWS).repartition(7), rows


def plain_additive(rows, station, form):
    own = [(t.replace(tzinfo=dt.timezone.utc).timestamp(), y, w) for s, t, y, w in rows if s == station and y is not None]
    sec, y, w = (np.array(c, float) for c in zip(*own))
    span = max(sec.max() - sec.min(), 1.0)
    unit = max(np.abs(y).max(), 1e-9)
    d = form.design((sec - sec.min()) / span, sec, np.full(len(sec), span), w[:, None] if form.regressors else np.zeros((len(sec), 0)))
    noise = 0.0
    for _ in range(3):
        root = np.sqrt(form.penalty(noise))
        coef = np.linalg.lstsq(np.concatenate([d, np.diag(root)]), np.concatenate([y / unit, np.zeros(len(root))]), rcond=1e-9)[0]
        noise = ((y / unit - d @ coef) ** 2).mean()
    return coef * unit, noise**0.5 * unit, d @ coef * unit


@pytest.mark.parametrize("form", [regress.Additive(regressors=["wind"]), regress.Additive(changes=3, daily=2, weekly=0, yearly=0)])
def test_additive_model_by_least_squares(table, monkeypatch, form):
    df, rows = table
    monkeypatch.setattr(regress, "HELD", 20_000)  # sums are passed on many times
    fits = {r.station_id: r for r in regress.additive_fit(df, form).collect()}
    assert set(fits) == {1, 2, 3, 4}
    out = {(r.station_id, r.datetime_utc): r for r in regress.additive_predict(regress.additive_fit(df, form), df.filter("pm25 IS NOT NULL"), form, floor=None).collect()}
    for s in (1, 2, 3, 4):
        coef, sigma, line = plain_additive(rows, s, form)
        own = [r for r in rows if r[0] == s and r[2] is not None]
        assert fits[s].n == len(own) and fits[s].sigma == pytest.approx(sigma, rel=1e-4, abs=1e-6)
        assert [out[s, r[1]].yhat for r in own] == pytest.approx(list(line), abs=1e-3)
    if form.regressors:
        assert fits[1].coef[-1] * fits[1].unit == pytest.approx(-0.8, abs=0.03) and 0.9 < fits[1].sigma < 1.1


def test_additive_forecast_follows_the_last_trend(spark, table):
    df, _ = table
    form = regress.Additive(yearly=0, regressors=["wind"])
    points = spark.createDataFrame([(1, START + dt.timedelta(hours=3000 + i), 4.0) for i in range(200)], "station_id long, datetime_utc timestamp, wind double")
    out = regress.additive_predict(regress.additive_fit(df.filter("station_id = 1"), form), points, form).orderBy("datetime_utc").collect()
    h = 3000 + np.arange(200)
    want = 40 + 0.01 * h - 0.02 * (h - 1500) + 6 * np.sin(2 * np.pi * h / 24) + 3 * np.cos(2 * np.pi * h / 168) - 3.2
    assert np.abs(np.array([r.yhat for r in out]) - want).mean() < 1.0
    assert out[-1].q90 - out[-1].q10 > out[0].q90 - out[0].q10 and all(r.q10 >= 0 for r in out)


def plain_arma(y, x, p, q, long):
    lag = lambda v, i: np.concatenate([np.full(i, np.nan), v[:-i]])
    def ols(cols, target):
        d = np.column_stack([np.ones(len(target)), *cols])
        ok = ~np.isnan(d).any(axis=1) & ~np.isnan(target)
        return d, ok, np.linalg.lstsq(d[ok], target[ok], rcond=None)[0]
    d, ok, c = ols([lag(y, i) for i in range(1, long + 1)], y)
    e = np.where(ok, y - d @ c, np.nan)
    cols = [*[lag(y, i) for i in range(1, p + 1)], *[lag(e, i) for i in range(1, q + 1)], *x]
    d, ok, _ = ols(cols, y)
    best = None
    for a in range(p + 1):
        for b in range(q + 1):
            use = [0, *range(1, 1 + a), *range(1 + p, 1 + p + b), *range(1 + p + q, d.shape[1])]
            c = np.linalg.lstsq(d[ok][:, use], y[ok], rcond=None)[0]
            rss, n = ((y[ok] - d[ok][:, use] @ c) ** 2).sum(), ok.sum()
            score = n * np.log(rss / n) + len(use) * np.log(n)
            if best is None or score < best[0]:
                best = (score, a, b, c, rss, n)
    return best, e


def test_orders_and_terms_by_least_squares(spark):
    rnd = np.random.Generator(np.random.PCG64(8))
    rows, plain = [], {}
    for s, n in ((1, 3000), (2, 400)):
        e, wind = rnd.normal(size=n), rnd.normal(size=n)
        y = np.zeros(n)
        for i in range(n):
            y[i] = 2 + (0.6 * y[i - 1] - 0.2 * y[i - 2] if i > 1 else 0) + e[i] + (0.5 * e[i - 1] if i else 0) + 1.5 * wind[i]
        plain[s] = (y, wind)
        rows += [(s, START + dt.timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, wind))] + [(s, START - dt.timedelta(hours=5), None, 0.0)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    fit = regress.arma_fit(df, p=3, q=2, regressors=["wind"], long=20)
    for r in fit.collect():
        y, wind = plain[r.station_id]
        (score, a, b, c, rss, n), e = plain_arma(y, [wind], 3, 2, 20)
        assert (r.ar, r.ma, r.n) == (a, b, n) and r.criterion == pytest.approx(score, rel=1e-6)
        assert [r.intercept, *r.phi[:a], *r.theta[:b], *r.beta] == pytest.approx(list(c), abs=1e-6)
        assert r["values"] == pytest.approx(y[-1:-4:-1].tolist()) and r.errors == pytest.approx(e[-1:-4:-1].tolist(), abs=1e-6)
        assert r.sigma == pytest.approx((rss / (n - len(c))) ** 0.5)
        if r.station_id == 1:
            assert r.ar >= 1 and r.ma >= 1 and r.beta[0] == pytest.approx(1.5, abs=0.1)
    points = spark.createDataFrame([(s, i, START + dt.timedelta(hours=3000 + i), 0.5 * i) for s in (1, 2, 9) for i in range(1, 31)], "station_id long, step long, datetime_utc timestamp, wind double")
    out = {}
    for r in regress.arma_predict(fit, points, ["wind"]).collect():
        out.setdefault(r.station_id, {})[r.step] = r
    assert set(out) == {1, 2} and all(len(v) == 30 for v in out.values())
    f = {r.station_id: r for r in fit.collect()}[1]
    y1 = f.intercept + sum(c * v for c, v in zip(f.phi, f["values"])) + sum(c * v for c, v in zip(f.theta, f.errors)) + f.beta[0] * 0.5
    assert out[1][1].yhat == pytest.approx(y1) and out[1][1].q90 - out[1][1].yhat == pytest.approx(1.64 * f.sigma)


def test_path_of_a_first_order_process():
    y, dev = regress.arma_path(1.0, [0.5], [0.2], 2.0, [4.0], [1.0], np.zeros(3))
    assert y.tolist() == pytest.approx([3.2, 2.6, 2.3])
    assert dev.tolist() == pytest.approx([2.0, 2 * math.sqrt(1 + 0.49), 2 * math.sqrt(1 + 0.49 + 0.1225)])


def plain_unit_root(y, most):
    d, best = np.diff(y), None
    for lags in range(most + 1):
        t = np.arange(most, len(d))
        x = np.column_stack([np.ones(len(t)), y[t], *[d[t - i] for i in range(1, lags + 1)]])
        c, *_ = np.linalg.lstsq(x, d[t], rcond=None)
        rss, n, k = ((d[t] - x @ c) ** 2).sum(), len(t), 2 + lags
        score = n * np.log(rss / n) + 2 * k
        if best is None or score < best[0]:
            best = (score, lags, c[1] / np.sqrt(rss / (n - k) * np.linalg.inv(x.T @ x)[1, 1]), n)
    return best[1:]


def test_unit_root_by_least_squares(spark):
    rnd = np.random.Generator(np.random.PCG64(4))
    walk, calm = np.cumsum(rnd.normal(size=600)), rnd.normal(size=600)
    for i in range(1, 600):
        calm[i] += 0.5 * calm[i - 1]
    rows = [(m, 1, START + dt.timedelta(hours=i), float(v)) for m, y in (("walk", walk), ("calm", calm)) for i, v in enumerate(y)]
    rows += [("flat", 1, START + dt.timedelta(hours=i), 3.0) for i in range(50)] + [("short", 1, START, 1.0), ("walk", 1, START - dt.timedelta(days=1), None)]
    out = {r.model: r for r in regress.unit_root(spark.createDataFrame(rows, "model string, station_id long, target_ts timestamp, err double").repartition(3)).collect()}
    for name, y in (("walk", walk), ("calm", calm)):
        lags, statistic, n = plain_unit_root(y, 12)
        assert (out[name].lags, out[name].n) == (lags, n) and out[name].statistic == pytest.approx(statistic, rel=1e-6)
    assert out["calm"].stationary and not out["walk"].stationary and out["flat"].statistic is None
    assert out["calm"].critical == pytest.approx(-2.866, abs=0.01)


def test_tail_normality_by_brute_force(spark):
    rnd = np.random.Generator(np.random.PCG64(7))
    data = {"normal": rnd.normal(3, 2, 500), "heavy": rnd.standard_t(2, 500), "ties": np.round(rnd.normal(size=300))}
    rows = [(m, i % 3, START + dt.timedelta(hours=i), float(v)) for m, y in data.items() for i, v in enumerate(y)] + [("normal", 9, START, None), ("flat", 1, START, 1.0), ("flat", 2, START, 1.0)]
    df = spark.createDataFrame(rows, "model string, station_id long, target_ts timestamp, err double")
    out = {r.model: r for r in evaluate.tail_normality(df).collect()}
    for name, y in data.items():
        z = (np.sort(y) - y.mean()) / y.std(ddof=1)
        share = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
        above = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        i, n = np.arange(1, len(y) + 1), len(y)
        want = -n - ((2 * i - 1) * (np.log(share) + np.log(above[::-1]))).sum() / n
        assert out[name].n == n and out[name].statistic == pytest.approx(want, rel=1e-9)
    assert out["normal"].normal and not out["heavy"].normal and out["flat"].statistic is None
    far = spark.createDataFrame([(-40.0,), (-31.0,), (-29.0,), (0.0,), (50.0,)], "z double").select(evaluate._log_share("z").alias("v")).collect()
    assert [r.v for r in far] == pytest.approx([-804.608442, -484.8572, -424.7893, -0.6931472, 0.0], rel=1e-3)
