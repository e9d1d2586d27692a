"""Baseline forecasts, ensembles and bias learning for all stations at once.

Fits are grouped aggregates, so one job fits any number of stations.  Rules that depend on the
previous step (smoothed weights, learned bias, learning rate) are folded by ``scan``, in stretches
side by side; adaptive weights pass by in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazewell.functions import scalars as S
from hazewell.operators import joins as J
from hazewell.operators import replicas as replicas_
from hazewell.operators import scan
from hazewell.operators import windows as W
from hazewell.operators.scalars_on import with_scalar

TIME = "datetime_utc"
DEFAULT_PM25 = 25.0
SEASON_PERIODS = [168, 24, 72]
WEIGHT_LIMITS = (0.05, 0.8)
#: Rows of one key that a moving frame is worked out over in one task.
SEGMENT = 100_000


def simple_forecasts(readings: DataFrame) -> DataFrame:
    """Long table of three forecasts per reading: last row, row a day back, hour-of-day mean."""
    w = Window.partitionBy("station_id").orderBy(TIME)
    hour = F.hour(TIME)
    profile = readings.groupBy("station_id", hour.alias("_h")).agg(F.avg("pm25").alias("profile"))
    wide = readings.select(
        "*", F.lag("pm25", 1).over(w).alias("persist"), F.lag("pm25", 24).over(w).alias("daily"), hour.alias("_h")
    ).join(profile, ["station_id", "_h"])
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat")) for m in ("persist", "daily", "profile")])
    long = wide.select("station_id", TIME, F.col("pm25").alias("y"), "_h", F.explode(pairs).alias("f"))
    horizon = F.element_at(F.array(F.lit(6), F.lit(12), F.lit(24)), (F.col("_h") % 3 + 1)).cast("bigint")
    return long.filter(F.col("f.yhat").isNotNull()).select(
        F.col("f.model").alias("model"),
        "station_id",
        F.timestamp_seconds(F.unix_timestamp(TIME) - horizon * 3600).alias("origin"),
        horizon.alias("horizon"),
        F.col(TIME).alias("target_ts"),
        F.col("f.yhat").alias("yhat"),
        "y",
    )


# --- seasonal-naive -------------------------------------------------------------------------

def snaive_fit(df: DataFrame, col: str = "pm25") -> DataFrame:
    """Per station: period by row count, mean, deviation, mean absolute deviation, seasonal strength."""
    n = F.col("rows")
    period = F.when(n >= 2, F.floor(n / 2)).otherwise(24)
    for p in reversed(SEASON_PERIODS):
        period = F.when(n >= 2 * p, p).otherwise(period)
    base = df.groupBy("station_id").agg(
        F.count("*").alias("rows"), F.count(col).alias("seen"), F.avg(col).alias("m"), F.stddev_samp(col).alias("s"), F.var_samp(col).alias("v"))
    base = base.withColumn("period", period.cast("bigint"))
    pos = F.row_number().over(Window.partitionBy("station_id").orderBy(TIME)) - 1
    rows = df.select("station_id", F.col(col).alias("y"), pos.alias("pos")).join(base, "station_id")
    mads = rows.groupBy("station_id").agg(F.avg(F.abs(F.col("y") - F.col("m"))).alias("mad"))
    phase = rows.groupBy("station_id", (F.col("pos") % F.col("period")).alias("ph")).agg(F.avg("y").alias("pm"), F.first("m").alias("m"))
    sv = phase.groupBy("station_id").agg(F.avg(F.pow(F.col("pm") - F.col("m"), 2)).alias("sv"))
    j = base.join(mads, "station_id").join(sv, "station_id")
    many = F.col("seen") > 1
    strength = F.when((F.col("seen") >= 2 * F.col("period")) & (F.col("v") > 0), F.least(F.lit(1.0), F.try_divide("sv", "v"))).otherwise(0.0)
    return j.select(
        "station_id", "period", F.coalesce("m", F.lit(DEFAULT_PM25)).alias("mean"), F.when(many, F.col("s")).otherwise(0.0).alias("std"),
        F.when(many, F.col("mad")).otherwise(0.0).alias("mad"), strength.alias("strength"))


def forecast_grid(df: DataFrame, hours: int) -> DataFrame:
    """Next hours of every station after its latest row."""
    return J.future_hours(df, 0, hours)


def snaive_predict(fit: DataFrame, history: DataFrame, points: DataFrame) -> DataFrame:
    """Value one period back (nearest in time), else the mean of the hours around it, else the station mean."""
    p = points.join(fit, "station_id")
    back = F.col("period") * 3600
    near = J.lookback(p, history, back)
    return near.withColumn("yhat", F.coalesce("nearest", "near_mean", "mean")).drop("nearest", "nearest_ts", "near_mean")


def snaive_interval(pred: DataFrame) -> DataFrame:
    half = F.col("mad") * 1.28
    return pred.withColumns({"q10": F.greatest(F.lit(0.0), F.col("yhat") - half), "q90": F.col("yhat") + half})


# --- trend and profile ----------------------------------------------------------------------

def profile_fit(df: DataFrame, col: str = "pm25") -> DataFrame:
    """Per station: mean, deviation and trend per row (0 with ten rows or fewer)."""
    i = F.row_number().over(Window.partitionBy("station_id").orderBy(TIME)) - 1
    rows = df.filter(F.col(col).isNotNull()).select("station_id", F.col(col).alias("y"), i.cast("double").alias("i"))
    slope = F.try_divide(F.covar_pop("i", "y"), F.var_pop("i"))
    return rows.groupBy("station_id").agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.when(F.count("*") > 10, slope).otherwise(0.0).alias("slope"))


def profile_predict(fit: DataFrame, profile: DataFrame, points: DataFrame) -> DataFrame:
    """Trend plus hour and weekday deviations, not below 0, with a band of 1.28 deviations."""
    def dev(kind: str) -> DataFrame:
        return profile.filter(F.col("kind") == kind).select("station_id", F.col("slot").alias(f"_{kind}"), F.col("deviation").alias(f"d_{kind}"))

    p = points.withColumns({"_hour": F.hour(TIME), "_dow": F.weekday(TIME)}).join(fit, "station_id")
    p = p.join(dev("hour"), ["station_id", "_hour"], "left").join(dev("dow"), ["station_id", "_dow"], "left")
    trend = F.col("mean") + F.col("slope") * (F.col("step") - 1)
    y = F.greatest(F.lit(0.0), trend + F.coalesce("d_hour", F.lit(0.0)) + F.coalesce("d_dow", F.lit(0.0)))
    half = F.col("std") * 1.28
    return p.select("station_id", "step", TIME, y.alias("yhat"), F.greatest(F.lit(0.0), y - half).alias("q10"), (y + half).alias("q90"))


# --- AR(1) ----------------------------------------------------------------------------------

def ar1_fit(df: DataFrame, col: str = "pm25") -> DataFrame:
    """Coefficient, intercept and residual deviation on the scaled series, with its last value and scale."""
    rows = df.filter(F.col(col).isNotNull())
    scale = rows.groupBy("station_id").agg(
        F.avg(col).alias("centre"), F.greatest(F.stddev_pop(col), F.lit(1e-6)).alias("scale"), F.max_by(col, TIME).alias("_last"))
    lag = F.lag(col).over(Window.partitionBy("station_id").orderBy(TIME))
    pairs = rows.select("station_id", F.col(col).alias("y"), lag.alias("x")).filter(F.col("x").isNotNull()).join(scale, "station_id")
    y, x = [(F.col(v) - F.col("centre")) / F.col("scale") for v in ("y", "x")]
    z = pairs.select("station_id", y.alias("y"), x.alias("x"))
    m = z.groupBy("station_id").agg(S.corr("x", "y").alias("r"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_pop("x").alias("vx"))
    c = F.when(F.col("vx") > 1e-10, F.coalesce("r", F.lit(0.0))).otherwise(0.0)
    fit = m.select("station_id", c.alias("coef"), (F.col("my") - c * F.col("mx")).alias("intercept"))
    res = z.join(fit, "station_id").groupBy("station_id").agg(
        F.stddev_pop(F.col("y") - F.col("intercept") - F.col("coef") * F.col("x")).alias("sigma"))
    last = ((F.col("_last") - F.col("centre")) / F.col("scale")).alias("last_value")
    return scale.join(fit, "station_id", "left").join(res, "station_id", "left").select(
        "station_id", "centre", "scale", last, F.coalesce("coef", F.lit(0.0)).alias("coef"), F.coalesce("intercept", F.lit(0.0)).alias("intercept"),
        F.coalesce("sigma", F.lit(1.0)).alias("sigma"))


def ar1_path(coef: Column, intercept: Column, last: Column, n: Column) -> Column:
    """Value after n steps in closed form."""
    power = F.pow(coef, n)
    series = F.coalesce(F.try_divide(1 - power, 1 - coef), n)
    return power * last + intercept * series


def ar1_predict(fit: DataFrame, points: DataFrame) -> DataFrame:
    p = points.join(fit, "station_id")
    y = ar1_path(F.col("coef"), F.col("intercept"), F.col("last_value"), F.col("step").cast("double")) * F.col("scale") + F.col("centre")
    half = F.col("sigma") * F.col("scale") * 1.64
    return p.select("station_id", "step", TIME, y.alias("yhat"), F.greatest(F.lit(0.0), y - half).alias("q10"), (y + half).alias("q90"))


# --- combining ------------------------------------------------------------------------------

def combine(forecasts: DataFrame, weights: DataFrame | None = None, keys: Sequence[str] = ("station_id", "target_ts"), default: float = DEFAULT_PM25) -> DataFrame:
    """Weighted mean over models; nulls are skipped, zero total weight gives the plain mean, no model the default."""
    f = forecasts.withColumn("_w", F.lit(1.0)) if weights is None else forecasts.join(
        weights.select("model", F.col("weight").alias("_w")), "model", "left").fillna(0.0, ["_w"])
    ok = F.col("yhat").isNotNull()
    w = F.sum(F.when(ok, F.col("_w")))
    mean = F.try_divide(F.sum(F.when(ok, F.col("_w") * F.col("yhat"))), w)
    return f.groupBy(*keys).agg(F.coalesce(mean, F.avg("yhat"), F.lit(default)).alias("combined"))


def inverse_error_weights(errors: DataFrame, eps: float = 0.001, keys: Sequence[str] = ()) -> DataFrame:
    """1 / (MAE + eps), normalised to 1."""
    m = errors.groupBy(*keys, "model").agg(F.avg(F.abs("err")).alias("mae"))
    inv = 1 / (F.col("mae") + eps)
    total = m.groupBy(*keys).agg(F.sum(inv).alias("_t"))
    j = m.join(total, list(keys)) if keys else with_scalar(m, total)
    return j.select(*keys, "model", "mae", (inv / F.col("_t")).alias("weight"))


def perf_weights(errors: DataFrame, tail_hours: int = 168) -> DataFrame:
    """Weights from each station's validation tail: the last hours, at most a quarter of its span; equal below 24 hours."""
    span = errors.groupBy("station_id").agg(F.min("target_ts").alias("_a"), F.max("target_ts").alias("_z"))
    hours = F.least(F.lit(tail_hours), F.floor((F.unix_timestamp("_z") - F.unix_timestamp("_a")) / 3600 / 4))
    tail = errors.join(span, "station_id").filter((hours >= 24) & (F.unix_timestamp("target_ts") > F.unix_timestamp("_z") - hours * 3600))
    fitted = inverse_error_weights(tail)
    names = errors.select("model").distinct()
    n = names.agg(F.count("*").alias("_n"))
    return with_scalar(names.join(fitted, "model", "left"), n).select("model", "mae", F.coalesce("weight", 1 / F.col("_n")).alias("weight"))


def quantile_rows(forecasts: DataFrame, half: float = 8.0) -> DataFrame:
    """Low, middle and high rows of each forecast, for combining by quantile."""
    parts = [(0.1, -half), (0.5, 0.0), (0.9, half)]
    rows = F.array(*[F.struct(F.lit(q).alias("quantile"), (F.col("yhat") + d).alias("v")) for q, d in parts])
    return forecasts.select("model", "station_id", "target_ts", F.explode(rows).alias("r")).select("model", "station_id", "target_ts", "r.quantile", F.col("r.v").alias("yhat"))


def _limited(raw: Column, over) -> Column:
    clipped = F.greatest(F.lit(WEIGHT_LIMITS[0]), F.least(F.lit(WEIGHT_LIMITS[1]), raw))
    return clipped / F.sum(clipped).over(over)


def dynamic_weights(errors: DataFrame, hours: int = 168, least: int = 24) -> DataFrame:
    """Weights by time from each model's mean error over the trailing hours.

    The score is 1 / (1 + MAE); a model with too few samples takes the lower limit, and with none every model
    counts the same.
    """
    per = errors.groupBy("model", "target_ts").agg(F.avg(F.abs("err")).alias("mae"))
    w = Window.partitionBy("model").orderBy(F.unix_timestamp("target_ts")).rangeBetween(-hours * 3600, 0)
    score = F.when(F.count("mae").over(w) >= least, 1 / (1 + F.avg("mae").over(w)))
    t = Window.partitionBy("target_ts")
    raw = per.select("model", "target_ts", score.alias("score")).withColumn(
        "raw", F.when(F.count("score").over(t) == 0, 1 / F.count("*").over(t)).otherwise(F.coalesce(F.col("score") / F.sum("score").over(t), F.lit(WEIGHT_LIMITS[0]))))
    return raw.select("model", "target_ts", "score", _limited(F.col("raw"), t).alias("weight"))


def _score_hours(errors: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per station and hour the score of each model, null where it has none."""
    return errors.groupBy("station_id", "target_ts").agg(*[F.avg(F.when(F.col("model") == m, 1 / (1 + F.abs("err")))).alias(m) for m in models])


def _unfold(df: DataFrame, models: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_w{i}").alias("weight")) for i, m in enumerate(models)])
    return df.select("station_id", F.explode(pairs).alias("p")).select("station_id", "p.model", "p.weight")


def adaptive_weights(errors: DataFrame, models: Sequence[str], rate: float = 0.1) -> DataFrame:
    """Final weights after each hour moved them by rate x (score - 0.5), limited and renormalised.

    Limits and shares of several weights at once compose to nothing simpler, so a station's hours pass by in order.
    """
    lo, hi = WEIGHT_LIMITS

    def step(ws, scores):
        moved = [max(lo, min(hi, w if s is None else w + (s - 0.5) * rate)) for w, s in zip(ws, scores)]
        total = sum(moved)
        return [w / total for w in moved]

    done = scan.in_order(_score_hours(errors, models), ["station_id"], ["target_ts"], models, [1.0 / len(models)] * len(models), step, [f"_w{i}" for i in range(len(models))])
    return _unfold(done, models)


def smooth_weights(errors: DataFrame, models: Sequence[str], factor: float = 0.3) -> DataFrame:
    """Final weights after smoothing each hour's score shares with the weights before; an hour without scores leaves them.

    Shares add up to one and so do weights: what smoothing gives needs no second share-out.
    """
    hours = _score_hours(errors, models)
    total = sum((F.coalesce(m, F.lit(0.0)) for m in models), F.lit(0.0))
    shares = hours.select("station_id", "target_ts", *[F.when(total > 0, F.coalesce(m, F.lit(0.0)) / total).alias(m) for m in models])
    names = [f"_w{i}" for i in range(len(models))]
    done = scan.fold(shares, ["station_id"], ["target_ts"], models, scan.Decay(factor, [1.0 / len(models)] * len(models)), names)
    equal = [F.coalesce(n, F.lit(1.0 / len(models))).alias(n) for n in names]
    return _unfold(hours.select("station_id").distinct().join(done, "station_id", "left").select("station_id", *equal), models)


def dynamic_forecast(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted forecast by time with a band of 1.96 deviations of the station's path."""
    j = forecasts.join(weights.select("model", "target_ts", "weight"), ["model", "target_ts"])
    path = j.groupBy("station_id", "target_ts").agg((F.sum(F.col("weight") * F.col("yhat")) / F.sum("weight")).alias("yhat"))
    dev = path.groupBy("station_id").agg(F.when(F.count("*") > 1, F.stddev_pop("yhat")).otherwise(1.0).alias("_d"))
    half = F.col("_d") * 1.96
    return path.join(dev, "station_id").select("station_id", "target_ts", "yhat", F.greatest(F.lit(0.0), F.col("yhat") - half).alias("lower"), (F.col("yhat") + half).alias("upper"))


def blend_spread(forecasts: DataFrame) -> DataFrame:
    """Mean and median over models with model disagreement, mean path deviation, and their joint bands."""
    own = forecasts.groupBy("model", "station_id").agg(F.stddev_pop("yhat").alias("_u"))
    g = forecasts.join(own, ["model", "station_id"]).groupBy("station_id", "target_ts").agg(
        F.avg("yhat").alias("mean"), F.percentile("yhat", 0.5).alias("median"), F.stddev_pop("yhat").alias("epistemic"), F.avg("_u").alias("aleatoric"))
    s = F.sqrt(F.col("epistemic") * F.col("epistemic") + F.col("aleatoric") * F.col("aleatoric"))
    m = F.col("mean")
    return g.select("station_id", "target_ts", "mean", "median", "epistemic", "aleatoric", (m - s).alias("lower_68"), (m + s).alias("upper_68"),
                    (m - s * 1.96).alias("lower_95"), (m + s * 1.96).alias("upper_95"))


def two_model_table(errors: DataFrame, a: str, b: str, rows: int = 48) -> DataFrame:
    """Both models side by side with the last value seen before and the mean residual of the last rows."""
    w = Window.partitionBy("station_id").orderBy("target_ts")
    side = lambda m, n: errors.filter(F.col("model") == m).select("station_id", "target_ts", "y", F.col("yhat").alias(n), F.abs("err").alias(f"e_{n}"))
    j = side(a, "fa").join(side(b, "fb").drop("y"), ["station_id", "target_ts"])
    past = w.rowsBetween(-rows, -1)
    return j.withColumns({"last_obs": F.lag("y").over(w), "ra": F.avg("e_fa").over(past), "rb": F.avg("e_fb").over(past)}).drop("e_fa", "e_fb")


def blend_two(pairs: DataFrame, distance=3.0, floor=0.25) -> DataFrame:
    """Blend two forecasts by their residuals where they are close, else take the one nearer the last observation.

    Residuals missing so far fall back to the distance from the last observation, and then to 0.6 / 0.4.
    ``distance`` and ``floor`` are numbers or columns.
    """
    d, f = (v if isinstance(v, Column) else F.lit(float(v)) for v in (distance, floor))
    ea, eb = F.abs(F.col("fa") - F.col("last_obs")), F.abs(F.col("fb") - F.col("last_obs"))
    ua, ub = F.coalesce("ra", ea), F.coalesce("rb", eb)
    total = ua + ub
    share = F.try_divide(ub, total)
    ca, cb = F.greatest(f, F.least(1 - f, share)), F.greatest(f, F.least(1 - f, 1 - share))
    wa = F.when(total > 1e-6, ca / (ca + cb)).otherwise(0.6)
    mix = wa * F.col("fa") + (1 - wa) * F.col("fb")
    close = (ea + eb > 1e-6) & (F.abs(F.col("fa") - F.col("fb")) <= d)
    picked = F.when(close, mix).when(eb < ea, F.col("fb")).otherwise(F.col("fa"))
    chosen = F.when(close, "blend").when(eb < ea, "b").otherwise("a")
    seen = F.col("last_obs").isNotNull()
    return pairs.withColumns({"yhat": F.when(seen, picked).otherwise(F.col("fa")), "chosen": F.when(seen, chosen).otherwise("a")})


def cv_band(forecasts: DataFrame, level: float) -> DataFrame:
    z = {0.95: 1.96, 0.9: 1.645}.get(level, 1.28)
    half = F.col("yhat") * (0.2 * z)
    return forecasts.withColumns({"lower": F.greatest(F.lit(0.0), F.col("yhat") - half), "upper": F.col("yhat") + half})


# --- bias -----------------------------------------------------------------------------------

def learn_bias(errors: DataFrame, keep: int = 336, least: int = 24, smoothing: float = 0.1, bound: float = 10.0, max_step: float = 0.8) -> DataFrame:
    """Bias per (model, station, hour of day) after folding its errors in time order."""
    alpha = max(0.05, min(0.2, smoothing))
    key = ["model", "station_id", "hour"]
    rows = errors.select("model", "station_id", F.hour("target_ts").alias("hour"), "target_ts", "err")

    def recent(d: DataFrame, keys: Sequence[str]) -> DataFrame:
        past = Window.partitionBy(*keys).orderBy("target_ts").rowsBetween(-(keep - 1), 0)
        return d.withColumns({"m": F.avg("err").over(past), "n": F.count("err").over(past)})

    steps = W.in_segments(rows, recent, keep - 1, segment_rows=max(SEGMENT, keep), bucket="month", keys=key, time="target_ts")
    done = scan.fold(steps.filter(F.col("n") >= least), key, ["target_ts"], ["m"], scan.Limited(alpha, max_step, bound), ["bias"])
    counts = rows.groupBy(*key).agg(F.count("*").alias("observations"))
    return counts.join(done.select(*key, "bias"), key, "left").select(*key, F.coalesce("bias", F.lit(0.0)).alias("bias"), "observations")


def apply_bias(forecasts: DataFrame, bias: DataFrame) -> DataFrame:
    j = forecasts.withColumn("hour", F.hour("target_ts")).join(bias.select("model", "station_id", "hour", "bias"), ["model", "station_id", "hour"], "left")
    return j.withColumn("corrected", F.greatest(F.lit(0.0), F.col("yhat") + F.coalesce("bias", F.lit(0.0)))).drop("hour", "bias")


def bias_summary(bias: DataFrame) -> DataFrame:
    return bias.groupBy("model", "station_id").agg(
        F.avg("bias").alias("mean_bias"), F.max("bias").alias("max_bias"), F.min("bias").alias("min_bias"), F.sum("observations").alias("observations"))


def mean_bias(errors: DataFrame) -> DataFrame:
    """Mean error per (model, station, hour): the value the learned bias tends to."""
    return errors.groupBy("model", "station_id", F.hour("target_ts").alias("hour")).agg(F.avg("err").alias("bias"), F.count("*").alias("observations"))


def offset_correct(forecasts: DataFrame, latest_error: DataFrame, bias: DataFrame) -> DataFrame:
    """0.7 x latest error + 0.3 x bias of the latest hour + 0.1 x bias of the target hour, not below 0."""
    b = bias.select("model", "station_id", "hour", "bias")
    now = latest_error.join(b, ["model", "station_id", "hour"], "left").select(
        "model", "station_id", (F.col("err") * 0.7 + F.coalesce("bias", F.lit(0.0)) * 0.3).alias("_off"))
    j = forecasts.withColumn("hour", F.hour("target_ts")).join(now, ["model", "station_id"], "left").join(b, ["model", "station_id", "hour"], "left")
    y = F.col("yhat") + F.coalesce("_off", F.lit(0.0)) + F.coalesce("bias", F.lit(0.0)) * 0.1
    return j.withColumn("corrected", F.greatest(F.lit(0.0), y)).drop("_off", "bias", "hour")


def latest_errors(errors: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("err", F.hour("target_ts").alias("hour")), "target_ts").alias("l")
    return errors.groupBy("model", "station_id").agg(last).select("model", "station_id", "l.err", "l.hour")


def adapt_rate(errors: DataFrame, start: float = 0.1) -> DataFrame:
    """Learning rate per (model, station, hour): up 10 % after an error above 5, down 5 % after one below 2."""
    key = ["model", "station_id", "hour"]
    e = F.abs("err")
    rows = errors.select("model", "station_id", F.hour("target_ts").alias("hour"), "target_ts", F.when(e > 5, 1.1).when(e < 2, 0.95).otherwise(1.0).alias("scale"))
    return scan.fold(rows, key, ["target_ts"], ["scale"], scan.Clamped(start, 0.05, 0.3), ["rate"]).select(*key, "rate")


def error_trend(errors: DataFrame) -> DataFrame:
    """Mean error of the last ten rows against the ten before, per model and station."""
    w = Window.partitionBy("model", "station_id").orderBy(F.desc("target_ts"))
    r = errors.select("model", "station_id", F.abs("err").alias("e"), F.row_number().over(w).alias("rn")).filter(F.col("rn") <= 20)
    g = r.groupBy("model", "station_id").agg(
        F.avg(F.when(F.col("rn") <= 10, F.col("e"))).alias("recent"), F.avg(F.when(F.col("rn") > 10, F.col("e"))).alias("older"), F.count("*").alias("n"))
    trend = (
        F.when(F.col("n") < 10, "insufficient_data").when(F.col("recent") < F.col("older") * 0.9, "improving")
        .when(F.col("recent") > F.col("older") * 1.1, "degrading").otherwise("stable")
    )
    return g.select("model", "station_id", "recent", "older", trend.alias("trend"))


# --- trees, bootstrap, model choice ---------------------------------------------------------

def predict_forest(df: DataFrame, cols: Sequence[str], target: str, split: str, **kw) -> DataFrame:
    """Fit on the rows before the split, predict those after it."""
    from hazewell.operators.select import fit_forest

    cut = F.lit(split).cast("timestamp")
    model, va = fit_forest(df.filter(F.col(TIME) < cut), cols, target, **kw)
    return model.transform(va.transform(df.filter(F.col(TIME) >= cut))).select("station_id", TIME, F.col(target).alias("y"), F.col("prediction").alias("yhat"))


def std_quantiles(forecasts: DataFrame, levels: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Quantile rows from the deviation of all forecasts of a station: value + deviation x 2 (level - 0.5)."""
    dev = forecasts.groupBy("model", "station_id").agg(F.stddev_pop("yhat").alias("_d"))
    rows = F.array(*[F.struct(F.lit(q).alias("quantile"), (F.col("yhat") + F.col("_d") * (2 * (q - 0.5))).alias("value")) for q in levels])
    return forecasts.join(dev, ["model", "station_id"]).select("model", "station_id", "target_ts", F.explode(rows).alias("r")).select(
        "model", "station_id", "target_ts", "r.*")


def poisson_weight(replica: Column, *key: Column) -> Column:
    """How often a row enters a bootstrap replica: Poisson(1) from a hash of row key and replica, the same on every retry."""
    u = F.pmod(F.xxhash64(*key, replica), F.lit(replicas_.UNIT)) / float(replicas_.UNIT)
    out = F.lit(0)
    for c in replicas_.CUTS:
        out = out + F.when(u >= c, 1).otherwise(0)
    return out


def bootstrap_forecast(df: DataFrame, replicas: int = 100, col: str = "pm25") -> DataFrame:
    """Hour-of-day forecast of every replica, then mean, deviation and quantiles over replicas, per station and hour.

    A group is one hour of the day of one station, a row a day; its replicas are one product of weights and values.
    """
    rows = df.filter(F.col(col).isNotNull()).select("station_id", F.hour(TIME).alias("hour"), F.xxhash64("station_id", TIME).alias("key"), F.col(col).cast("double").alias("y"))

    def run(table):
        import numpy as np
        import pyarrow as pa

        y = table.column("y").to_numpy()
        sums = replicas_.weighted_sums(table.column("key").to_numpy(), np.column_stack([y, np.ones(len(y))]), replicas)
        f = sums[sums[:, 1] > 0]
        f = f[:, 0] / f[:, 1]
        found = [f.mean(), f.std(), *np.quantile(f, [0.1, 0.9])] if len(f) else [None] * 4
        return pa.table([table.column("station_id").slice(0, 1), table.column("hour").slice(0, 1), *[pa.array([v], pa.float64()) for v in found]], ["station_id", "hour", "yhat", "std", "q10", "q90"])

    return rows.groupBy("station_id", "hour").applyInArrow(run, "station_id long, hour int, yhat double, std double, q10 double, q90 double")


def performance_records(errors: DataFrame, half: float = 20.0) -> DataFrame:
    """Daily record per model: MAE, RMSE, coverage of a fixed band."""
    return errors.groupBy("model", F.date_trunc("day", "target_ts").alias("day")).agg(
        F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.avg((F.abs("err") <= half).cast("int")).alias("coverage"))


def recommend_model(records: DataFrame, condition_factor: float = 1.0, previous: DataFrame | None = None, decay: float = 0.95) -> DataFrame:
    """Three choices per model table: lowest MAE, lowest MAE x trend x condition, highest decayed inverse-MAE weight.

    The trend is the mean MAE of the last three records over the first three.
    """
    first, last = Window.partitionBy("model").orderBy("day"), Window.partitionBy("model").orderBy(F.desc("day"))
    r = records.withColumns({"_f": F.row_number().over(first), "_l": F.row_number().over(last)})
    m = r.groupBy("model").agg(
        F.avg("mae").alias("mae"), F.count("*").alias("n"), F.avg(F.when(F.col("_l") <= 3, F.col("mae"))).alias("_r"), F.avg(F.when(F.col("_f") <= 3, F.col("mae"))).alias("_o"))
    trend = F.when((F.col("n") >= 3) & (F.col("_o") > 0), F.try_divide("_r", "_o")).otherwise(1.0)
    m = m.withColumns({"trend": trend, "adaptive": F.col("mae") * trend * condition_factor, "inv": 1 / (F.col("mae") + 1e-6)})
    w = with_scalar(m, m.agg(F.sum("inv").alias("_t"))).withColumn("weight", F.col("inv") / F.col("_t"))
    if previous is not None:
        w = w.join(previous.select("model", F.col("weight").alias("_prev")), "model", "left").withColumn(
            "weight", F.coalesce(F.col("_prev") * decay + F.col("weight") * (1 - decay), F.col("weight")))
    best = w.agg(F.min_by("model", F.struct("mae", "model")).alias("best"), F.min_by("model", F.struct("adaptive", "model")).alias("best_adaptive"),
                 F.min_by("model", F.struct(-F.col("weight"), F.col("model"))).alias("best_ensemble"))
    return with_scalar(w.select("model", "mae", "trend", "adaptive", "weight"), best)


def optimise_weights(records: DataFrame, previous: DataFrame | None = None, rate: float = 0.1) -> DataFrame:
    """(1 / MAE) x (1 - |coverage - 0.9|), normalised, mixed into earlier weights at a rate."""
    m = records.groupBy("model").agg(F.avg("mae").alias("mae"), F.avg("coverage").alias("coverage"))
    raw = m.withColumn("raw", 1 / (F.col("mae") + 1e-6) * (1 - F.abs(F.col("coverage") - 0.9)))
    w = with_scalar(raw, raw.agg(F.sum("raw").alias("_t"))).withColumn("optimal", F.col("raw") / F.col("_t"))
    if previous is None:
        return w.select("model", "optimal", F.col("optimal").alias("weight"))
    j = w.join(previous.select("model", F.col("weight").alias("_p")), "model", "left")
    return j.select("model", "optimal", F.coalesce(F.col("_p") * (1 - rate) + F.col("optimal") * rate, F.col("optimal")).alias("weight"))
