"""Forecast metrics, rolling-origin back-tests, residual diagnostics and parameter sweeps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.functions import scalars as S
from hazewell.operators import forecast as L
from hazewell.operators import joins as J
from hazewell.operators import windows as W
from hazewell.operators.quantiles import quantile_columns
from hazewell.operators.scalars_on import with_scalar
from hazewell.operators.windows import ordered_position
from hazewell.session import bounded_broadcast, stored

TIME = "datetime_utc"
HORIZONS = (6, 12, 24)
# 5 % points of the chi-squared distribution by degrees of freedom.
CHI2_95 = {1: 3.841459, 10: 18.307038}


def mae() -> Column:
    return F.avg(F.abs("err"))


def rmse() -> Column:
    return F.sqrt(F.avg(F.col("err") * F.col("err")))


def smape() -> Column:
    half = (F.abs("y") + F.abs("yhat")) / 2
    return F.coalesce(F.avg(F.when(half > 1e-8, F.try_divide(F.abs("err"), half))) * 100, F.lit(0.0))


def point_metrics(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE, RMSE, sMAPE and count per key; rows with a null side drop out of the averages."""
    return errors.groupBy(*keys).agg(mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape"), F.count("err").alias("n"))


def mase(errors: DataFrame, readings: DataFrame, lag: int = 24) -> DataFrame:
    """MAE over the seasonal-naive MAE of each station (lag 1 on short series)."""
    w = Window.partitionBy("station_id").orderBy(TIME)
    d = readings.select("station_id", F.abs(F.col("pm25") - F.lag("pm25", lag).over(w)).alias("a"), F.abs(F.col("pm25") - F.lag("pm25", 1).over(w)).alias("b"))
    base = d.groupBy("station_id").agg(F.when(F.count("*") > lag, F.avg("a")).otherwise(F.coalesce(F.avg("b"), F.lit(1.0))).alias("_b"))
    m = errors.groupBy("model", "station_id").agg(mae().alias("mae")).join(base, "station_id")
    return m.select("model", "station_id", "mae", (F.col("mae") / F.when(F.col("_b") == 0, 1e-8).otherwise(F.col("_b"))).alias("mase"))


def pinball(quantile_rows: DataFrame) -> DataFrame:
    """Mean pinball loss per model and quantile."""
    e = F.col("actual") - F.col("yhat")
    return quantile_rows.groupBy("model", "quantile").agg(F.avg(F.when(e >= 0, F.col("quantile") * e).otherwise((F.col("quantile") - 1) * e)).alias("loss"))


def coverage(bands: DataFrame, level: float, keys: Sequence[str] = ("model",)) -> DataFrame:
    ok = F.col("y").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    c = F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("int"))
    return bands.filter(ok).groupBy(*keys).agg(c.alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"), F.abs(c - level).alias("coverage_error"))


def improvement(metrics: DataFrame, baseline: str) -> DataFrame:
    """Relative gain in MAE over the baseline model at each horizon."""
    b = metrics.filter(F.col("model") == baseline).select("horizon", F.col("mae").alias("_b"))
    return metrics.join(b, "horizon").select("model", "horizon", "mae", F.when(F.col("_b") > 0, F.try_divide(F.col("_b") - F.col("mae"), F.col("_b"))).alias("gain"))


def champion(metrics: DataFrame) -> DataFrame:
    a = metrics.groupBy("model").agg(F.avg("mae").alias("average_mae"))
    return a.agg(F.min(F.struct("average_mae", "model")).alias("b")).select("b.model", "b.average_mae")


def summary(metrics: DataFrame, baseline: str) -> DataFrame:
    """Per horizon: best model, MAE spread, best gain and whether it meets 10 % and 15 %."""
    gain = improvement(metrics, baseline).filter(F.col("model") != baseline).groupBy("horizon").agg(F.max("gain").alias("best_gain"))
    s = metrics.groupBy("horizon").agg(
        F.min_by("model", F.struct("mae", "model")).alias("best_model"), F.min("mae").alias("best_mae"), F.max("mae").alias("worst_mae"),
        F.stddev_pop("mae").alias("mae_std"), F.avg("rmse").alias("mean_rmse"))
    return s.join(gain, "horizon").select("*", (F.col("best_gain") >= 0.10).alias("meets_10"), (F.col("best_gain") >= 0.15).alias("meets_15"))


def block_eval(errors: DataFrame, readings: DataFrame, horizon: int, least: int = 100) -> DataFrame:
    """Metrics over full, non-overlapping blocks of ``horizon`` consecutive hours, the first one starting after ``horizon`` rows."""
    pos = F.row_number().over(Window.partitionBy("station_id").orderBy(TIME)) - 1
    rows = readings.select("station_id", TIME, pos.alias("p")).filter(F.col("p") >= horizon).withColumn("block", F.floor((F.col("p") - horizon) / horizon))
    full = rows.groupBy("station_id", "block").agg(
        F.count("*").alias("n"), ((F.unix_timestamp(F.max(TIME)) - F.unix_timestamp(F.min(TIME))) / 3600).alias("span")).filter(
        (F.col("n") == horizon) & (F.col("span") == horizon - 1))
    kept = rows.join(full.select("station_id", "block"), ["station_id", "block"], "left_semi").select("station_id", F.col(TIME).alias("target_ts"))
    return point_metrics(errors.join(kept, ["station_id", "target_ts"]), ["model"]).filter(F.col("n") >= least).withColumn("horizon", F.lit(horizon))


# --- rolling origins ------------------------------------------------------------------------

def origins(df: DataFrame, first: int = 168, step: int = 24, most: int = 10, horizon: int = 24, gap: int = 0) -> DataFrame:
    """Origins from the first training span on, at most ``most``, with room for the longest horizon."""
    span = df.agg(F.min(TIME).alias("a"), F.max(TIME).alias("z"))
    at = F.sequence(F.lit(0), F.lit(most - 1))
    o = span.select("a", "z", F.explode(at).alias("k")).withColumn("origin", F.timestamp_seconds(F.unix_timestamp("a") + (F.col("k") * step + first) * 3600))
    return o.filter(F.unix_timestamp("origin") <= F.unix_timestamp("z") - (horizon + gap) * 3600).select("k", "origin")


def _origin_rows(df: DataFrame, os: DataFrame) -> DataFrame:
    """Every row with the short array of origins; what a row is to an origin is decided inside the row."""
    arr = os.agg(F.array_sort(F.collect_list(F.struct("k", "origin"))).alias("_os"))
    return with_scalar(df, arr)


def split_at(df: DataFrame, os: DataFrame, horizon: int = 24, gap: int = 0, min_train: int = 72, min_test: int = 6) -> DataFrame:
    """Train and test size per origin and station, kept where both are large enough.

    Train rows are counted per segment between origins and summed, so no row is copied per origin.
    """
    t = F.unix_timestamp(TIME)
    rows = _origin_rows(df, os)
    seg = F.size(F.filter("_os", lambda o: F.unix_timestamp(o["origin"]) <= t))
    per = rows.select("station_id", seg.alias("seg"), "_os").groupBy("station_id", "seg").agg(F.count("*").alias("c"), F.first("_os").alias("_os"))
    train = per.select("station_id", "c", F.explode(F.filter("_os", lambda o: o["k"] >= F.col("seg"))).alias("o")).groupBy("station_id", "o.k", "o.origin").agg(F.sum("c").alias("train"))
    start = lambda o: F.unix_timestamp(o["origin"]) + gap * 3600
    test = rows.select("station_id", F.explode(F.filter("_os", lambda o: t.between(start(o), start(o) + horizon * 3600))).alias("o")).groupBy("station_id", "o.k").agg(F.count("*").alias("test"))
    return train.join(test, ["station_id", "k"]).filter((F.col("train") >= min_train) & (F.col("test") >= min_test)).select("station_id", "origin", "train", "test")


def rolling_cv(df: DataFrame, os: DataFrame, horizons: Sequence[int] = HORIZONS, gap: int = 0, col: str = "pm25") -> DataFrame:
    """Hour-of-day profile and station mean fitted before every origin and scored after it, all origins in one job.

    Sums per (station, hour, segment between origins) are added up to each origin; only these sums meet the
    origins, not the rows.
    """
    t = F.unix_timestamp(TIME)
    rows = _origin_rows(df.filter(F.col(col).isNotNull()), os).withColumn("hour", F.hour(TIME))
    seg = F.size(F.filter("_os", lambda o: F.unix_timestamp(o["origin"]) <= t))
    sums = rows.withColumn("seg", seg).groupBy("station_id", "hour", "seg").agg(F.sum(col).alias("s"), F.count(col).alias("c"), F.first("_os").alias("_os"))
    at = sums.select("station_id", "hour", "s", "c", F.explode(F.filter("_os", lambda o: o["k"] >= F.col("seg"))).alias("o")).withColumn("k", F.col("o.k"))
    prof = at.groupBy("station_id", "k", "hour").agg((F.sum("s") / F.sum("c")).alias("p"))
    mean = at.groupBy("station_id", "k").agg((F.sum("s") / F.sum("c")).alias("m"))
    lead = lambda o: (t - F.unix_timestamp(o["origin"])) / 3600 - gap
    far = max(horizons)
    test = rows.select("station_id", "hour", TIME, F.col(col).alias("y"), F.explode(F.filter("_os", lambda o: (lead(o) >= 0) & (lead(o) < far))).alias("o")).select(
        "station_id", "hour", "y", F.col("o.k").alias("k"), F.col("o.origin").alias("origin"), ((t - F.unix_timestamp("o.origin")) / 3600 - gap).alias("lead"))
    j = test.join(mean, ["station_id", "k"]).join(prof, ["station_id", "k", "hour"], "left")
    models = F.explode(F.array(F.struct(F.lit("profile").alias("model"), F.coalesce("p", "m").alias("yhat")), F.struct(F.lit("mean").alias("model"), F.col("m").alias("yhat")))).alias("f")
    hs = F.filter(F.array(*map(F.lit, horizons)), lambda h: F.col("lead") < h)
    scored = j.select("origin", "y", models, hs.alias("hs")).select("origin", "y", "f.model", "f.yhat", F.explode("hs").alias("horizon"))
    return point_metrics(scored.withColumn("err", F.col("y") - F.col("yhat")), ["model", "origin", "horizon"])


def cv_compare(cv: DataFrame) -> DataFrame:
    """Mean and deviation over origins, with the best model of each horizon marked."""
    m = cv.groupBy("model", "horizon").agg(
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.avg("rmse").alias("rmse_mean"), F.count("*").alias("origins"))
    best = m.groupBy("horizon").agg(F.min_by("model", F.struct("mae_mean", "model")).alias("_b"))
    return m.join(best, "horizon").select("model", "horizon", "mae_mean", "mae_std", "rmse_mean", "origins", (F.col("model") == F.col("_b")).alias("best"))


def expanding_cv(df: DataFrame, folds: int = 5, col: str = "pm25") -> DataFrame:
    """Expanding folds by time order: per fold the train and validation error of the station hour profile.

    Rows are cut into folds + 1 runs by position; fold k trains on the runs before run k.  The placed rows are
    written once, since sums, totals and errors all read them.
    """
    placed = W.ordered_position(df.select("station_id", TIME, col).filter(F.col(col).isNotNull()).withColumn("_t", F.unix_timestamp(TIME)), "_t", ["station_id"], name="_p")
    n = placed.agg(F.count("*").alias("_n"))
    size = F.floor(F.col("_n") / (folds + 1))
    head = F.col("_n") - size * folds
    run = F.when(F.col("_p") < head, 0).otherwise(F.floor((F.col("_p") - head) / size) + 1)
    rows = stored(with_scalar(placed, n).select("station_id", F.hour(TIME).alias("hour"), F.col(col).alias("y"), run.alias("run")), "folds")
    sums = rows.groupBy("station_id", "hour", "run").agg(F.sum("y").alias("s"), F.count("*").alias("c"))
    at = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")).filter(F.col("run") < F.col("fold"))
    prof = at.groupBy("fold", "station_id", "hour").agg((F.sum("s") / F.sum("c")).alias("p"))
    all_ = at.groupBy("fold").agg((F.sum("s") / F.sum("c")).alias("g"))
    use = rows.select("*", F.explode(F.sequence(F.greatest("run", F.lit(1)), F.lit(folds))).alias("fold"))
    e = use.join(all_, "fold").join(prof, ["fold", "station_id", "hour"], "left").select(
        "fold", F.when(F.col("run") == F.col("fold"), "validation").otherwise("train").alias("part"), (F.col("y") - F.coalesce("p", "g")).alias("err"))
    return e.groupBy("fold", "part").agg(mae().alias("mae"), rmse().alias("rmse"), F.count("*").alias("n"))


def expanding_summary(cv: DataFrame) -> DataFrame:
    return cv.groupBy("part").agg(
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"))


# --- residuals ------------------------------------------------------------------------------

def residual_stats(errors: DataFrame) -> DataFrame:
    e = F.col("err")
    m = errors.groupBy("model").agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"), F.skewness(e).alias("skewness"), F.kurtosis(e).alias("kurtosis"),
        mae().alias("mae"), rmse().alias("rmse"), (F.avg(F.abs(F.try_divide(e, F.col("y")))) * 100).alias("mape"), smape().alias("smape"))
    med = quantile_columns(errors, "err", {"median": 0.5}, ["model"])
    return m.withColumn("range", F.col("max") - F.col("min")).join(med, "model")


def residual_diag(errors: DataFrame) -> DataFrame:
    """Shares within 1, 2 and 3 deviations, efficiency, squared correlation and the share beyond 1.5 quartile distances."""
    s = errors.groupBy("model").agg(F.stddev_pop("err").alias("_s"), F.avg("y").alias("_my"))
    q = quantile_columns(errors, "err", {"_a": 0.25, "_b": 0.75}, ["model"])
    j = errors.join(s.join(q, "model"), "model")
    a = F.abs("err")
    share = {f"within_{k}": F.avg((a <= F.col("_s") * k).cast("int")) for k in (1, 2, 3)}
    return j.groupBy("model").agg(
        F.avg(a).alias("mean_abs"), F.stddev_pop(a).alias("std_abs"), F.avg("err").alias("bias"), *[v.alias(k) for k, v in share.items()],
        (1 - F.try_divide(F.sum(F.col("err") * F.col("err")), F.sum(F.pow(F.col("y") - F.col("_my"), 2)))).alias("efficiency"),
        F.pow(S.corr("y", "yhat"), 2).alias("r2"), F.avg((a > (F.col("_b") - F.col("_a")) * 1.5).cast("int")).alias("outlier_share"))


def residual_tests(errors: DataFrame, lags: int = 10) -> DataFrame:
    """Per model and station: Durbin-Watson, Ljung-Box Q and Breusch-Pagan n r2 on time, against 5 % points."""
    key = ["model", "station_id"]
    w = Window.partitionBy(*key).orderBy("target_ts")
    m = errors.groupBy(*key).agg(F.avg("err").alias("_m"))
    pos = F.row_number().over(w).cast("double")
    rows = errors.join(m, key).select(*key, "err", pos.alias("i"), (F.col("err") - F.col("_m")).alias("d"), F.lag("err").over(w).alias("p"),
                                      *[F.lag(F.col("err") - F.col("_m"), k).over(w).alias(f"d{k}") for k in range(1, lags + 1)])
    e2 = F.col("err") * F.col("err")
    a = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("err") - F.col("p"), 2)).alias("dd"), F.sum(e2).alias("ss"), F.sum(F.col("d") * F.col("d")).alias("v"),
        S.corr(e2, F.col("i")).alias("r"), *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    total = F.lit(0.0)
    for k in range(1, lags + 1):
        total = total + F.try_divide(F.pow(F.try_divide(F.col(f"c{k}"), F.col("v")), 2), F.col("n") - k)
    dw, q, bp = F.try_divide("dd", "ss"), F.col("n") * (F.col("n") + 2) * total, F.col("n") * F.col("r") * F.col("r")
    return a.select(*key, dw.alias("durbin_watson"), q.alias("ljung_box"), bp.alias("breusch_pagan"), dw.between(1.5, 2.5).alias("uncorrelated"),
                    (q < CHI2_95[lags]).alias("white_noise"), (bp < CHI2_95[1]).alias("homoscedastic"))


def ks_normal(errors: DataFrame, model: str) -> DataFrame:
    """Kolmogorov-Smirnov test of one model's residuals against the normal with their mean and deviation."""
    e = errors.filter(F.col("model") == model).select("err")
    m = e.agg(F.avg("err").alias("m"), F.stddev_pop("err").alias("s")).first()  # two numbers
    return KolmogorovSmirnovTest.test(e, "err", "norm", float(m["m"]), float(m["s"])).select(
        F.lit(model).alias("model"), F.col("pValue").alias("p_value"), "statistic")


def tail_normality(errors: DataFrame, keys: Sequence[str] = ("model",), value: str = "err", ties: Sequence[str] = ("station_id", "target_ts")) -> DataFrame:
    """Normality test that weighs the tails, per model: statistic, critical (5 %) and normal, with mean and sample deviation from the data.

    Each value counts by its place among the n: 2 i - 1 times for the share below it, 2 (n - i) + 1 times for the share
    above. Places come from one range exchange per table. Nulls are left out; without variation the statistic is null.
    """
    rows = errors.filter(F.col(value).isNotNull()).select(*keys, *ties, F.col(value).cast("double").alias("_v"))
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"))
    placed = ordered_position(rows, "_v", list(ties), list(keys), name="_i").join(bounded_broadcast(fit), list(keys))
    z = F.try_divide(F.col("_v") - F.col("_m"), F.col("_s"))
    below, above = _log_share(z), _log_share(-z)
    term = (F.col("_i") * 2 + 1) * below + ((F.col("n") - F.col("_i")) * 2 - 1) * above
    a = placed.groupBy(*keys, "n").agg(F.sum(term).alias("_t")).withColumn("statistic", -F.col("n") - F.col("_t") / F.col("n"))
    critical = 0.787 / (1 + 4 / F.col("n") - 25 / (F.col("n") * F.col("n")))
    return a.select(*keys, "n", "statistic", critical.alias("critical"), (F.col("statistic") < critical).alias("normal"))


@F.pandas_udf(T.DoubleType())
def _log_share(z: pd.Series) -> pd.Series:
    """Log of the normal share below z; far out in the tail by its expansion, where the share itself is no number any more."""
    x = z.to_numpy(dtype=float)
    near = np.log(np.maximum(0.5 * np.vectorize(math.erfc, otypes=[float])(-np.maximum(x, -37.0) / math.sqrt(2)), 1e-320))
    far = -0.5 * x * x - np.log(np.maximum(-x, 1.0)) - 0.5 * math.log(2 * math.pi) + np.log1p(-1.0 / np.maximum(x * x, 2.0))
    return pd.Series(np.where(np.isnan(x), np.nan, np.where(x < -30, far, near)))


def residual_compare(stats: DataFrame) -> DataFrame:
    """Best model per metric (lowest value)."""
    metrics = ["mae", "rmse", "smape", "std", "mean"]
    long = stats.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x")).select("model", "x.*")
    return long.groupBy("metric").agg(F.min_by("model", F.struct("value", "model")).alias("best_model"), F.min("value").alias("best_value"))


# --- sweeps ---------------------------------------------------------------------------------

def grid_sweep(pairs: DataFrame, distances: Sequence[float] = (1.5, 2.0, 3.0, 4.0, 5.0), floors: Sequence[float] = (0.10, 0.20, 0.25, 0.30)) -> DataFrame:
    """Mean over stations of the blend's MAE for every grid point; one pass, the copies meet in the partial aggregate."""
    grid = F.array(*[F.struct(F.lit(d).alias("distance"), F.lit(f).alias("floor")) for d in distances for f in floors])
    rows = pairs.select("*", F.explode(grid).alias("g")).select("*", "g.distance", "g.floor")
    b = L.blend_two(rows, F.col("distance"), F.col("floor"))
    per = b.groupBy("distance", "floor", "station_id").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("m"))
    return per.groupBy("distance", "floor").agg(F.avg("m").alias("mae"))


def param_sweep(df: DataFrame, split: str, periods: Sequence[int] = (24, 168, 720), col: str = "pm25") -> DataFrame:
    """MAE of the seasonal-naive forecast on the hold-out for each period, best one marked."""
    cut = F.lit(split).cast("timestamp")
    train = df.filter(F.col(TIME) < cut)
    ps = F.explode(F.array(*map(F.lit, periods))).alias("period")
    points = df.filter(F.col(TIME) >= cut).select("station_id", TIME, F.col(col).alias("y"), ps)
    near = J.lookback(points, train, F.col("period") * 3600, col)
    mean = train.groupBy("station_id").agg(F.avg(col).alias("_m"))
    e = near.join(mean, "station_id").withColumn("err", F.col("y") - F.coalesce("nearest", "near_mean", "_m"))
    m = e.groupBy("period").agg(mae().alias("mae"))
    best = m.agg(F.min_by("period", F.struct("mae", "period")).alias("_b"))
    return with_scalar(m, best).select("period", "mae", (F.col("period") == F.col("_b")).alias("best"))


def missing_by_station(df: DataFrame, col: str = "pm25") -> DataFrame:
    return df.groupBy("station_id").agg((F.avg(F.col(col).isNull().cast("int")) * 100).alias("missing_pct"))
