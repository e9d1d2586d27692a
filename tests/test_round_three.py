"""Series folds in stretches, moving order statistics, keyed streams in event order, and the day store."""

import contextlib
import datetime as dt
import io
import itertools
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazewell.operators import calibrate, forecast, moving, scan
from hazewell.streaming import streams as X

ERRORS = "model string, station_id long, target_ts timestamp, err double"
N = 1_000_000


def explained(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("extended")
    return text.getvalue()


@pytest.fixture(scope="module")
def long_series(spark):
    """A million errors of one model, station and hour, 3 ms apart, and some short series and nulls beside them."""
    h = F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003.0
    one = spark.range(N).select(
        F.lit("a").alias("model"), F.lit(1).cast("long").alias("station_id"), F.timestamp_micros(F.lit(1_700_002_800_000_000) + F.col("id") * 3000).alias("target_ts"),
        ((h - 0.4) * 14).alias("err"))
    few = spark.createDataFrame([("b", s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i, hours=s), float((i * 7919 + s) % 23 - 9) + i / 7) for s in range(3) for i in range(30 * s + 1)], ERRORS)
    from hazewell.session import stored

    return stored(one.unionByName(few).repartition(8), "long-series")


@pytest.fixture(scope="module")
def plain_series(long_series):
    rows = long_series.toPandas().sort_values(["model", "station_id", "target_ts"])
    return {k: g["err"].to_numpy() for k, g in rows.groupby(["model", "station_id"])}


def by_series(df):
    return {(r["model"], r["station_id"]): r for r in df.collect()}


def test_running_quantile_of_a_million_rows(long_series, plain_series):
    out = by_series(calibrate.online_quantile(long_series, 0.9, 0.01))
    assert set(out) == set(plain_series)
    for key, err in plain_series.items():
        a = None
        for s in np.abs(err).tolist():
            a = s if a is None else a + 0.009 if s > a else a - 0.001
        assert out[key].threshold == pytest.approx(a, abs=1e-6)


def test_running_quantile_counts_a_tie_as_covered(spark):
    rows = [("a", 1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate([1, 2, 3, 3, 1.5, 2.5, 2.5, 9, 0])]
    df = spark.createDataFrame(rows + [("a", 1, dt.datetime(2023, 1, 1), None), ("n", 1, dt.datetime(2023, 1, 1), None)], ERRORS)
    a = None
    for *_, v in rows:
        a = v if a is None else a + 0.5 if v > a else a - 0.5
    assert [(r.model, r.threshold) for r in calibrate.online_quantile(df, 0.5, 1.0).collect()] == [("a", a)]


def test_moments_of_a_million_rows(long_series, plain_series):
    out = by_series(calibrate.online_moments(long_series))
    for key, err in plain_series.items():
        m, v = 0.0, 1.0
        for i, s in enumerate(np.abs(err).tolist()):
            m = 0.99 * m + 0.01 * s
            v = 0.99 * v + 0.01 * (s - m) ** 2 if i else v
        assert (out[key]["mean"], out[key].variance) == (pytest.approx(m, abs=1e-9), pytest.approx(v, abs=1e-9))


def test_bias_and_rate_of_a_million_rows(long_series):
    key = ["model", "station_id", "hour"]
    plain = long_series.withColumn("hour", F.hour("target_ts")).toPandas().sort_values([*key, "target_ts"])
    bias = {tuple(r[k] for k in key): r for r in forecast.learn_bias(long_series).collect()}
    rate = {tuple(r[k] for k in key): r.rate for r in forecast.adapt_rate(long_series).collect()}
    groups = {k: g["err"] for k, g in plain.groupby(key)}
    assert set(groups) == set(bias) == set(rate)
    for k, err in groups.items():
        b, r = 0.0, 0.1
        means = err.rolling(336, min_periods=1).mean().to_numpy()
        for i, (e, m) in enumerate(zip(err.to_numpy().tolist(), means.tolist())):
            if i + 1 >= 24:
                b = max(-10, min(10, b + max(-0.8, min(0.8, 0.1 * (m - b)))))
            r = min(0.3, r * 1.1) if abs(e) > 5 else max(0.05, r * 0.95) if abs(e) < 2 else r
        assert bias[k].bias == pytest.approx(b, abs=1e-9) and bias[k].observations == len(err)
        assert rate[k] == pytest.approx(r, abs=1e-12)


def test_weights_over_time(spark):
    rnd = random.Random(3)
    models = ["p", "d"]
    rows = [(m, s, dt.datetime(2000, 1, 1) + dt.timedelta(hours=i), rnd.choice([None, rnd.uniform(-9, 9), rnd.uniform(-1, 1)])) for s, n in ((1, 20_000), (2, 1), (3, 40)) for i in range(n) for m in models]
    rows = [r for r in rows if r[1] != 3] + [(*r[:3], None) for r in rows if r[1] == 3]  # station 3 has no errors at all
    df = spark.createDataFrame(rows, ERRORS)
    smooth = {(r.station_id, r.model): r.weight for r in forecast.smooth_weights(df, models).collect()}
    moved = {(r.station_id, r.model): r.weight for r in forecast.adaptive_weights(df, models).collect()}
    for s in (1, 2, 3):
        a, b = [0.5, 0.5], [0.5, 0.5]
        hours = {}
        for m, st, t, e in rows:
            if st == s:
                hours.setdefault(t, {})[m] = None if e is None else 1 / (1 + abs(e))
        for t in sorted(hours):
            sc = [hours[t].get(m) for m in models]
            total = sum(x or 0 for x in sc)
            if total > 0:
                a = [w * 0.7 + 0.3 * (x or 0) / total for w, x in zip(a, sc)]
                a = [w / sum(a) for w in a]
            b = [max(0.05, min(0.8, w + (0.0 if x is None else (x - 0.5) * 0.1))) for w, x in zip(b, sc)]
            b = [w / sum(b) for w in b]
        assert [smooth[s, m] for m in models] == pytest.approx(a, abs=1e-9) and [moved[s, m] for m in models] == pytest.approx(b, abs=1e-9)


def test_series_are_not_gathered(long_series):
    for df in (calibrate.online_quantile(long_series), calibrate.online_moments(long_series), forecast.learn_bias(long_series), forecast.adapt_rate(long_series),
               forecast.smooth_weights(long_series, ["a", "b"]), forecast.adaptive_weights(long_series, ["a", "b"]), calibrate.batch_adapt(long_series, 20.0)):
        assert "collect_list" not in explained(df)


def test_stretches_are_dealt_over_tasks(long_series):
    made = []
    family = scan.Clamped(0.1, 0.05, 0.3)
    plan = scan.fold(long_series.withColumn("scale", F.lit(1.1)), ["model", "station_id"], ["target_ts"], ["scale"], family, ["rate"], stretch=1000)
    text = explained(plan)
    assert "rangepartitioning(model" in text.replace(" ASC NULLS FIRST", "") or "RepartitionByExpression" in text
    made = {(r.model, r.station_id): (r.rate, r.rows) for r in plan.collect()}
    assert made["a", 1] == (0.3, N)


def test_families_compose():
    rnd = random.Random(8)
    for _ in range(60):
        bounds = [rnd.randint(-5, 30) for _ in range(rnd.randint(1, 50))]
        cut = rnd.randint(0, len(bounds))
        parts = [scan.Counted().extend([], np.array(p, float)[:, None]) for p in (bounds[:cut], bounds[cut:])]
        for k0 in range(0, 40, 3):
            k = k0
            for b in bounds:
                k += k < b
            assert scan.Counted().apply(parts[1], scan.Counted().apply(parts[0], [k0]))[0] == k
        f, ms = scan.Limited(0.1, 0.8, 10.0), [rnd.gauss(0, rnd.choice([1, 20])) for _ in range(rnd.randint(1, 80))]
        made = f.extend(f.identity(), np.array(ms)[:, None])
        for b0 in (-10.0, -3.3, 0.0, 9.0):
            b = b0
            for m in ms:
                b = max(-10, min(10, b + max(-0.8, min(0.8, 0.1 * (m - b)))))
            assert f.apply(made, np.array([b0]))[0] == pytest.approx(b, abs=1e-9)


def test_moving_quantile_of_a_wide_frame(spark):
    n, rows = 250_000, 100_000
    h = F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double")
    df = spark.range(n).select(F.lit("a").alias("model"), F.lit(1).cast("long").alias("station_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000).alias("target_ts"),
                               F.when(F.col("id") % 50 != 7, h).alias("err"))
    out = calibrate.sliding_threshold(df, rows=rows, least=100, segment_rows=rows).toPandas().sort_values("target_ts")["threshold"].to_numpy()
    err = np.array([np.nan if r.err is None else r.err for r in df.orderBy("target_ts").select("err").collect()])
    assert len(out) == n
    for i in [*range(95, 108), *random.Random(1).sample(range(n), 60), n - 1]:
        x = err[max(0, i + 1 - rows) : i + 1]
        x = x[~np.isnan(x)]
        assert (np.isnan(out[i]) and len(x) < 100) or out[i] == pytest.approx(np.quantile(x, 0.9))


def test_rank_tree():
    rnd = np.random.Generator(np.random.PCG64(5))
    for n in (1, 2, 3, 8, 100):
        ranks = rnd.permutation(n)
        tree = moving.RankTree(ranks)
        for _ in range(30):
            a, b = sorted(rnd.integers(0, n + 1, 2).tolist())
            if a < b:
                k = int(rnd.integers(0, b - a))
                assert tree.smallest(np.array([a]), np.array([b]), np.array([k]))[0] == sorted(ranks[a:b])[k]


def test_finite_sample_threshold_leaves_nulls_out(spark):
    rows = [("a", i, dt.datetime(2024, 1, 1), float(i)) for i in range(1, 101)]
    gaps = [("a", 1000 + i, dt.datetime(2024, 1, 1), None) for i in range(20)]
    for some in (rows, rows + gaps):
        df = spark.createDataFrame(some, ERRORS)
        assert calibrate.conformal_fit(df, finite_sample=True).first().threshold == 91.0
    none = spark.createDataFrame(gaps, ERRORS)
    assert calibrate.conformal_fit(none, finite_sample=True).count() == 0


# --- streams -----------------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp, user_id long, station_id long, value double"
DAY = dt.datetime(2024, 3, 1)


def dealt(spark, rows, folder, order):
    """The rows in five files that a stream takes one by one in the given order, and one file with a last event that lets all others through."""
    parts = [rows[i::5] for i in range(5)]
    last = [(10**6, DAY + dt.timedelta(days=50), -1, -1, 60.0)]
    for place, part in enumerate([*[parts[i] for i in order], last]):
        path = f"{folder}/{place}.parquet"
        pd.DataFrame(part, columns=["event_id", "ts", "user_id", "station_id", "value"]).to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (1_700_000_000 + 100 * place,) * 2)
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("name", ["alerts", "stale", "bias", "conformal"])
def test_keyed_streams_do_not_depend_on_the_order_of_files(spark, tmp_path, name):
    rnd = random.Random(6)
    rows = [(i, DAY + dt.timedelta(seconds=rnd.randint(0, 30 * 3600)), rnd.randint(1, 4), rnd.randint(1, 2), rnd.uniform(20, 90)) for i in range(400)]
    late = "40 hours"  # all five files lie within it
    build = {
        "alerts": lambda e: X.run_to_table(X.stream_alerts(e, late=late), "alerts"),
        "stale": lambda e: X.run_to_table(X.stream_stale(e, late=late), "stale"),
        "bias": lambda e: X.last_rows(X.run_to_table(X.stream_bias(e, least=2, late=late), "bias"), ["station_id", "hour"]),
        "conformal": lambda e: X.last_rows(X.run_to_table(X.stream_conformal(e, late=late), "conformal"), ["station_id"]),
    }[name]
    orders = [(0, 1, 2, 3, 4), (4, 2, 0, 3, 1)]
    got = []
    for order in orders:
        folder = tmp_path / "-".join(map(str, order))
        folder.mkdir()
        got.append(sorted(tuple(r) for r in build(dealt(spark, rows, folder, order)).collect()))
    assert got[0] == got[1] and got[0]
    by_time = sorted(rows, key=lambda r: (r[1], r[0]))
    if name == "alerts":
        want, last = [], {}
        for i, ts, user, _, value in by_time:
            if value >= 55 and (user not in last or ts - last[user] >= dt.timedelta(minutes=30)):
                want.append((user, i, ts, value))
                last[user] = ts
        assert [g[:2] for g in got[0]] == sorted(w[:2] for w in want)
    if name == "conformal":
        for station in (1, 2):
            scores = [abs(r[4] - 50) for r in by_time if r[3] == station]
            thr = scores[0]
            for s in scores[1:]:
                thr = thr + 0.45 if s > thr else thr - 0.05
            found = [g for g in got[0] if g[0] == station][0]
            assert found[1] == len(scores) and found[2] == pytest.approx(thr)
    if name == "bias":
        assert sum(g[2] for g in got[0]) == len(rows) - len({(r[3], r[1].hour) for r in rows})
    if name == "stale":
        times = {u: sorted(r[1] for r in rows if r[2] == u) for u in range(1, 5)}
        want = sum(b - a > dt.timedelta(hours=2) for t in times.values() for a, b in itertools.pairwise(t)) + len([t for t in times.values() if t])
        assert len(got[0]) == want


def view_rows(view):
    return sorted((r.station_id, r.datetime_utc, r.pm25, r.n, r.least, r.most) for r in view.read().collect())


def test_day_store_merges_only_touched_days(spark, tmp_path):
    view = X.HourlyView(spark, str(tmp_path / "view"))
    assert view.read().count() == 0
    at = lambda day, hour, v, s=1: (s, DAY + dt.timedelta(days=day, hours=hour, minutes=5), v)
    batch = lambda rows: spark.createDataFrame(rows, "station_id long, ts timestamp, value double")
    view.add(batch([at(0, 1, 4.0), at(0, 1, 6.0), at(1, 3, 7.0), at(1, 3, None)]), 0)
    # day 0 can't be read from here on: a batch that touches day 1 alone must not need it
    broken = [p for p in (tmp_path / "view/days/day=2024-03-01/epoch=0").iterdir() if p.name.endswith(".parquet")]
    kept = [p.read_bytes() for p in broken]
    for p in broken:
        p.write_bytes(b"not a table")
    assert view.paths([DAY.date() + dt.timedelta(days=1)], 1) == [f"{tmp_path}/view/days/day=2024-03-02/epoch=0"]
    view.add(batch([at(1, 3, 9.0), at(2, 0, 1.0, 2)]), 1)
    for p, data in zip(broken, kept):
        p.write_bytes(data)
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    want = [(1, DAY + dt.timedelta(hours=1), 5.0, 2, 4.0, 6.0), (1, DAY + dt.timedelta(days=1, hours=3), 8.0, 2, 7.0, 9.0), (2, DAY + dt.timedelta(days=2), 1.0, 1, 1.0, 1.0)]
    assert view_rows(view) == want
    view.add(batch([at(1, 3, 9.0), at(2, 0, 1.0, 2)]), 1)  # the same batch again
    assert view_rows(view) == want


def test_day_store_survives_a_batch_that_was_cut_off(spark, tmp_path, monkeypatch):
    view = X.HourlyView(spark, str(tmp_path / "view"))
    batch = lambda v: spark.createDataFrame([(1, DAY, v)], "station_id long, ts timestamp, value double")
    view.add(batch(2.0), 0)
    real = spark.createDataFrame

    def fail(*args, **kw):
        raise RuntimeError("cut off before the log")

    second = batch(4.0)
    monkeypatch.setattr(spark, "createDataFrame", fail)
    with pytest.raises(RuntimeError):
        view.add(second, 1)  # days are written, the log isn't
    monkeypatch.setattr(spark, "createDataFrame", real)
    assert view_rows(view) == [(1, DAY, 2.0, 1, 2.0, 2.0)]
    view.add(second, 1)
    assert view_rows(view) == [(1, DAY, 3.0, 2, 2.0, 4.0)]


# --- replicas, importance, partitions -------------------------------------------------------------

def plain_bands(n, seed=4):
    rnd = np.random.Generator(np.random.PCG64(seed))
    y = rnd.gamma(2.0, 20.0, n)
    mid = y + rnd.normal(0, 12, n)
    return [("m", i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(a), float(b - 18), float(b + 18 + i % 5)) for i, (a, b) in enumerate(zip(y, mid))]


def test_replica_weights_are_those_of_the_column_form(spark):
    from hazewell.operators import replicas

    df = spark.range(500).select("id", F.xxhash64("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r"))
    rows = df.select("id", "key", "r", forecast.poisson_weight(F.col("r"), F.col("id")).alias("w")).orderBy("id", "r").collect()
    keys = np.array([r.key for r in rows if r.r == 0])
    assert replicas.poisson(keys, 10).ravel().tolist() == [r.w for r in rows]


def test_a_thousand_replicas_of_blocks_agree_with_replicas_of_rows(spark):
    """60,000 rows lie in 1,024 blocks; intervals of weighted rows, by brute force, are within 5 % of those of blocks."""
    rows = plain_bands(60_000)
    df = spark.createDataFrame(rows, "model string, station_id long, target_ts timestamp, y double, lower double, upper double")
    out = calibrate.bootstrap_metrics(df, replicas=1000, blocks=1024)
    assert "Generate" not in explained(out)
    got = {r.metric: r for r in out.collect()}
    y, lo, hi = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
    wink = hi - lo + 20 * (np.maximum(0, lo - y) + np.maximum(0, y - hi))
    rnd = np.random.Generator(np.random.PCG64(9))
    per = {"coverage": [], "width": [], "winkler": []}
    for _ in range(600):
        w = rnd.poisson(1.0, len(rows))
        for name, v in (("coverage", (y >= lo) & (y <= hi)), ("width", hi - lo), ("winkler", wink)):
            per[name].append((w * v).sum() / w.sum())
    for name, values in per.items():
        low, high = np.quantile(values, [0.025, 0.975])
        assert abs(got[name].low - low) < 0.05 * abs(low) and abs(got[name].high - high) < 0.05 * abs(high)
        assert (got[name].high - got[name].low) / (high - low) == pytest.approx(1, abs=0.15)


def test_donors_come_from_one_numbering(spark):
    from hazewell.operators import explain, select

    rnd = random.Random(2)
    df = spark.createDataFrame([(i, rnd.random(), rnd.random(), 0.0) for i in range(300)], "id long, a double, b double, y double").withColumn("y", F.col("a") * 10)
    model, va = select.fit_forest(df, ["a", "b"], "y", trees=5, depth=4)
    plan = explained(explain.permutation_importance(model, va, df, ["a", "b"], "y", ["id"], repeats=10))
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("SortMergeJoin") + physical.count("BroadcastHashJoin") + physical.count("ShuffledHashJoin") <= 3
    got = {r.feature: r for r in explain.permutation_importance(model, va, df, ["a", "b"], "y", ["id"], repeats=10).collect()}
    assert got["a"].importance > 10 and abs(got["b"].importance) < 1 and got["a"].std > 0
    one = explain.permutation_importance(model, va, df.limit(1), ["a", "b"], "y", ["id"]).collect()
    assert [r.importance for r in one] == [None, None]


def test_missing_slots_are_read_off_neighbours(spark):
    from hazewell.sources import landing

    rnd = random.Random(5)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 60))) for s in range(4) for _ in range(12)]
    df = spark.createDataFrame(rows, "station_id long, datetime_utc timestamp")
    want = {tuple(r) for r in landing.missing_partitions(landing.required_partitions(df), landing.present_partitions(df)).collect()}
    got = [tuple(r) for r in landing.missing_slots(df).collect()]
    assert set(got) == want and len(got) == len(want)


# --- pairs of columns ------------------------------------------------------------------------------

def test_pairs_of_many_columns_take_one_scan(spark):
    from hazewell.operators import pairs, select

    rnd = np.random.Generator(np.random.PCG64(1))
    x = rnd.normal(size=(400, 40)) @ rnd.normal(size=(40, 40)) + 1e5
    x[:, 7] = 3.0
    x[:, 8] = x[:, 9] * 2
    gaps = rnd.random(x.shape) < 0.05
    cols = [f"x{i}" for i in range(40)]
    rows = [[None if g else float(v) for v, g in zip(r, m)] for r, m in zip(x, gaps)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r.a, r.b): r.r for r in pairs.correlations(df, cols).collect()}
    pdf = pd.DataFrame(np.where(gaps, np.nan, x), columns=cols)
    assert len(got) == 40 * 39 // 2
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            if "x7" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(pdf[a].corr(pdf[b]), abs=1e-9)
    assert {(r.a, r.b) for r in select.corr_pairs(df, cols).collect()} == {k for k, v in got.items() if v is not None and abs(v) > 0.95} >= {("x8", "x9")}
    wide = df.select(*cols, *[F.col(c).alias(f"{c}_{k}") for c in cols for k in range(7)])
    plan = explained(pairs.correlations(wide, wide.columns)).split("== Physical Plan ==")[1]
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_pair_features_by_brute_force(spark):
    from hazewell.operators import pairs

    rnd = np.random.Generator(np.random.PCG64(2))
    n = 500
    data = {"a": rnd.normal(3, 2, n), "b": rnd.gamma(2, 3, n), "c": rnd.normal(-1, 4, n), "y": rnd.normal(0, 1, n)}
    data["y"] += data["a"] * data["b"] / 10
    pdf = pd.DataFrame(data).mask(rnd.random((n, 4)) < 0.06)
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in pdf.to_numpy()]
    got = {(r.a, r.b, r.kind): r for r in pairs.interactions(spark.createDataFrame(rows, "a double, b double, c double, y double"), ["a", "b", "c"], "y", ["multiplicative", "ratio", "difference", "polynomial", "log_ratio"]).collect()}
    assert len(got) == 15
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        u, v = pdf[a], pdf[b]
        with np.errstate(invalid="ignore", divide="ignore"):
            made = {"multiplicative": u * v, "ratio": u / (v + 1e-8), "difference": u - v, "polynomial": u * u + v * v, "log_ratio": (np.log(u + 1) - np.log(v + 1)).where((u > 0) & (v > 0))}
        for kind, x in made.items():
            r = got[a, b, kind]
            assert r.n == (x.notna() & pdf["y"].notna()).sum() and r.r == pytest.approx(x.corr(pdf["y"]), abs=1e-9)
            assert r.nulls == pytest.approx(max(u.isna().mean(), v.isna().mean()))


# --- attributions of a forest ---------------------------------------------------------------------

def plain_game(tree, node, x, known):
    """A tree's value with only some features known: both ways, weighted by training rows, at splits on the others."""
    if tree["left"][node] < 0:
        return tree["value"][node]
    f, a, b = tree["feature"][node], tree["left"][node], tree["right"][node]
    if f in known:
        return plain_game(tree, a if x[f] <= tree["cut"][node] else b, x, known)
    return (tree["rows"][a] * plain_game(tree, a, x, known) + tree["rows"][b] * plain_game(tree, b, x, known)) / tree["rows"][node]


@pytest.mark.parametrize("most", [200_000, 30])
def test_forest_attributions_are_shapley_values(spark, monkeypatch, most):
    """Against sums over all subsets of six columns; also with a forest that goes out in parts."""
    import math

    from hazewell.operators import attribution, select

    monkeypatch.setattr(attribution, "LEAVES", most)
    rnd = np.random.Generator(np.random.PCG64(3))
    x = rnd.normal(size=(300, 6))
    y = x[:, 0] * 3 + np.where(x[:, 1] > 0, x[:, 2], -1) + rnd.normal(size=300) / 5
    cols = [f"f{i}" for i in range(6)]
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(1000, *[None] * 6, 0.0)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", y double").repartition(3)
    model, va = select.fit_forest(df, cols, "y", trees=7, depth=6)
    got = {}
    out = attribution.forest_attributions(model, df, cols, ["id"])
    for r in out.collect():
        got.setdefault(r.id, {})[r.feature] = r
    pred = {r.id: r.prediction for r in model.transform(va.transform(df)).select("id", "prediction").collect()}
    assert set(got) == set(pred) and len(pred) == 300
    for i, parts in got.items():
        assert sum(p.attribution for p in parts.values()) + parts["f0"].mean == pytest.approx(pred[i], abs=1e-9)
    tables = attribution.tree_tables(spark, model)
    for i in (0, 17, 200):
        value = {}
        for mask in range(64):
            known = {f for f in range(6) if mask >> f & 1}
            value[mask] = np.mean([plain_game(t, 0, x[i], known) for t in tables])
        for f in range(6):
            want = sum(math.factorial(bin(m).count("1")) * math.factorial(5 - bin(m).count("1")) / 720 * (value[m | 1 << f] - value[m]) for m in range(64) if not m >> f & 1)
            assert got[i][f"f{f}"].attribution == pytest.approx(want, abs=1e-9)


# --- mutual information from neighbours -----------------------------------------------------------

def plain_information(x, y, k=3):
    rx, ry = (np.argsort(np.argsort(v)) for v in (x, y))
    n = len(x)
    d = np.maximum(np.abs(rx[:, None] - rx[None]), np.abs(ry[:, None] - ry[None]))
    np.fill_diagonal(d, 10**9)
    kth = np.sort(d, axis=1)[:, k - 1]
    harmonic = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, n + 2)))) - 0.5772156649015329
    psi = lambda m: harmonic[np.asarray(m) - 1]
    near = [(np.abs(r[:, None] - r[None]) < kth[:, None]).sum(axis=1) - 1 for r in (rx, ry)]
    return max(0.0, psi(k) + psi(n) - (psi(near[0] + 1) + psi(near[1] + 1)).mean())


@pytest.mark.parametrize("least", [1024, 4])
def test_information_from_neighbours_by_brute_force(spark, monkeypatch, least):
    """Also with strips so narrow that rows are looked at again in wider ones."""
    from hazewell.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAST", least)
    monkeypatch.setattr(neighbours, "ROOTS", 8 if least > 4 else 0.1)
    rnd = np.random.Generator(np.random.PCG64(6))
    n = 2000
    y = rnd.normal(size=n)
    data = {"same": y + rnd.normal(size=n) / 2, "bent": y * y + rnd.normal(size=n) / 10, "none": rnd.normal(size=n), "line": y * 3 + 1}
    rows = [(i, *[float(v[i]) for v in data.values()], float(y[i])) for i in range(n)] + [(n + 1, None, float("nan"), 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, same double, bent double, none double, line double, y double").repartition(4)
    got = {r.feature: r.score for r in neighbours.mi_neighbours(df, list(data), "y", ["id"]).collect()}
    for name, x in data.items():
        assert got[name] == pytest.approx(plain_information(x, y), rel=1e-9, abs=1e-9)
    assert got["same"] == pytest.approx(0.5 * np.log(5), rel=0.1) and got["none"] < 0.05 and got["bent"] > 0.5


def test_neighbours_with_ties_and_few_rows(spark):
    from hazewell.operators import neighbours

    df = spark.createDataFrame([(i, float(i % 2), float(i % 2)) for i in range(3000)], "id long, x double, y double")
    assert neighbours.mi_neighbours(df, ["x"], "y", ["id"]).first().score == pytest.approx(np.log(2), rel=0.05)
    flat = df.withColumn("x", F.lit(1.0))
    assert neighbours.mi_neighbours(flat, ["x"], "y", ["id"]).first().score < 0.05
    assert neighbours.mi_neighbours(df.limit(3), ["x"], "y", ["id"]).count() == 0
    assert neighbours.digamma(np.array([1, 2, 10, 1000])) == pytest.approx([-0.5772156649, 0.4227843351, 2.2517525891, 6.9072551956], abs=1e-9)


# --- nearest neighbours -----------------------------------------------------------------------------

@pytest.mark.parametrize("cell", [32, 2])
def test_neighbours_in_a_dense_city_and_far_off(spark, cell):
    """A city of 1,500 stations, others over the globe, equal places, and one alone at a pole, against all distances."""
    from hazewell.operators import celltree

    rnd = np.random.Generator(np.random.PCG64(3))
    n = 1500 if cell == 32 else 150
    lat = np.concatenate([27.7 + rnd.normal(0, 0.02, n), np.degrees(np.arcsin(rnd.uniform(-1, 1, 60))), [-89.99, 10.0, 10.0, 0.0, 0.0]])
    lon = np.concatenate([85.3 + rnd.normal(0, 0.02, n), rnd.uniform(-180, 180, 60), [3.0, 20.0, 20.0, 180.0, -180.0]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [(9000, None, 1.0), (None, 1.0, 1.0)]
    got = {r.station_id: r.km for r in celltree.nearest(spark.createDataFrame(rows, "station_id long, latitude double, longitude double"), cell=cell, levels=20).collect()}
    a, b = np.radians(lat), np.radians(lon)
    v = np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
    far = np.array([np.partition(np.sqrt(np.maximum(((v - p) ** 2).sum(axis=1), 0)), 1)[1] for p in v])
    want = 2 * 6371.0 * np.arcsin(far / 2)
    assert set(got) == set(range(len(lat)))
    assert [got[i] for i in range(len(lat))] == pytest.approx(want.tolist(), rel=1e-3, abs=1e-6)
    assert got[n + 61] == got[n + 62] == 0.0
    one = spark.createDataFrame([(1, 1.0, 2.0)], "station_id long, latitude double, longitude double")
    assert celltree.nearest(one).count() == 0 and celltree.nearest(one.limit(0)).count() == 0
