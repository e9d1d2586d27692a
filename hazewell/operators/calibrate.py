"""Interval calibration: conformal, quantile, adaptive, temporal, multi-target and ensemble forms.

Thresholds are a few numbers per model; residual tables can be large, so their quantiles come from
``exact_quantiles``.  Online rules fold over one series in time order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.functions import scalars as S
from hazewell.operators import moving, scan
from hazewell.operators import windows as W
from hazewell.operators.quantiles import exact_quantiles, quantile_columns
from hazewell.operators.replicas import weighted_sums
from hazewell.operators.scalars_on import with_scalar
from hazewell.session import bounded_broadcast

ALPHA = 0.1
SERIES = ("model", "station_id")
#: Rows of a series that one task composes at a time.
STRETCH = 8_192
MOVING_ROWS = 200_000


def _scores(errors: DataFrame) -> DataFrame:
    return errors.withColumn("score", F.abs("err"))


def conformal_fit(errors: DataFrame, alpha: float = ALPHA, finite_sample: bool = False) -> DataFrame:
    """Threshold per model: the 1 - alpha quantile of the absolute residuals.

    ``finite_sample`` takes the ceil((n + 1)(1 - alpha))-th smallest score instead. Null scores are left out.
    """
    s = _scores(errors).filter(F.col("score").isNotNull())
    if not finite_sample:
        return quantile_columns(s, "score", {"threshold": 1 - alpha}, ["model"])
    placed = W.ordered_position(s, "score", ["station_id", "target_ts"], ["model"], name="_p")
    n = s.groupBy("model").agg(F.count("score").alias("_n"))
    want = F.least(F.ceil((F.col("_n") + 1) * (1 - alpha)), F.col("_n")) - 1
    return placed.join(bounded_broadcast(n), "model").filter(F.col("_p") == want).select("model", F.col("score").alias("threshold"))


def conformal_apply(forecasts: DataFrame, fit: DataFrame) -> DataFrame:
    j = forecasts.join(bounded_broadcast(fit), "model")
    return j.withColumns({"lower": F.col("yhat") - F.col("threshold"), "upper": F.col("yhat") + F.col("threshold")}).drop("threshold")


def conformal_norm(errors: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Threshold on residuals scaled by each series' own deviation; the half width is threshold x deviation."""
    sd = errors.groupBy(*SERIES).agg(F.stddev_pop("err").alias("sigma"))
    s = errors.join(sd, list(SERIES)).withColumn("score", F.when(F.col("sigma") > 0, F.try_divide(F.abs("err"), F.col("sigma"))).otherwise(F.abs("err")))
    q = quantile_columns(s, "score", {"threshold": 1 - alpha}, ["model"])
    half = F.col("threshold") * F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)
    return sd.join(q, "model").select(*SERIES, "sigma", "threshold", half.alias("half_width"))


def conformal_update(old: DataFrame, new: DataFrame, alpha: float = ALPHA, window: int | None = None) -> DataFrame:
    """Threshold after new scores: all old scores, or the most recent ``window`` of each model, with the new ones."""
    kept = _scores(old) if window is None else W.last_n(_scores(old), window, ["target_ts", "station_id"], ["model"])
    return quantile_columns(kept.select("model", "score").unionByName(_scores(new).select("model", "score")), "score", {"threshold": 1 - alpha}, ["model"])


def jackknife_fit(errors: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Quantile of each absolute residual less the mean of all the others."""
    s = _scores(errors)
    t = s.groupBy("model").agg(F.sum("score").alias("_s"), F.count("score").alias("_n"))
    j = s.join(t, "model").withColumn("loo", F.col("score") - F.try_divide(F.col("_s") - F.col("score"), F.col("_n") - 1))
    return quantile_columns(j, "loo", {"threshold": 1 - alpha}, ["model"])


def quantile_calibrate(errors: DataFrame, levels: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Offset per model and level: the residual quantile."""
    return exact_quantiles(errors, "err", levels, ["model"]).select("model", F.col("prob").alias("level"), F.col("quantile").alias("offset"))


def quantile_apply(forecasts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Calibrated bounds and median from the outermost and middle offsets."""
    o = offsets.groupBy("model").agg(
        F.min_by("offset", "level").alias("_lo"), F.max_by("offset", "level").alias("_hi"), F.max(F.when(F.col("level") == 0.5, F.col("offset"))).alias("_mid"))
    j = forecasts.join(o, "model")
    return j.withColumns({"median": F.col("yhat") + F.coalesce("_mid", F.lit(0.0)), "lower": F.col("yhat") + F.col("_lo"), "upper": F.col("yhat") + F.col("_hi")}).drop("_lo", "_hi", "_mid")


def quantile_quality(errors: DataFrame, offsets: DataFrame) -> DataFrame:
    """Share of values at or below each calibrated level, for every level."""
    j = errors.select("model", "err").join(offsets, "model")
    c = F.avg((F.col("err") <= F.col("offset")).cast("int"))
    return j.groupBy("model", "level").agg(c.alias("coverage")).withColumn("coverage_error", F.abs(F.col("coverage") - F.col("level")))


def online_quantile(errors: DataFrame, q: float = 0.9, rate: float = 0.01, legacy: bool = False) -> DataFrame:
    """Running quantile: first score, then up by rate x q above the estimate and down by rate x (1 - q) below. Null scores are left out.

    ``legacy`` swaps the two steps, which then tends to the 1 - q quantile. After p more rows the estimate is the first
    score + p x up - rate x k, k of them being not above it, so whole numbers k are folded: a row adds one to k while k is
    below a bound that its place and score give.
    """
    up = rate * (1 - q) if legacy else rate * q
    s = _scores(errors).filter(F.col("score").isNotNull()).select(*SERIES, "target_ts", "score")
    first = bounded_broadcast(s.groupBy(*SERIES).agg(F.min(F.struct("target_ts", "score")).alias("_f")).select(*SERIES, F.col("_f.score").alias("_s0")))
    placed = W.ordered_position(s, "target_ts", ["score"], SERIES, name="_p").join(first, list(SERIES))
    below = (F.col("_s0") + (F.col("_p") - 1) * up - F.col("score")) / rate
    # a hair's breadth takes up the rounding of sums: a score equal to the estimate is not above it
    bound = F.when(F.col("_p") == 0, -1).otherwise(F.floor(below + 1e-9) + 1)
    rows = placed.withColumns({"_bound": bound, "_cut": F.floor(F.col("_p") / STRETCH)})
    done = scan.fold(rows, SERIES, ["_p"], ["_bound"], scan.Counted(), ["_k"], by_stretch="_cut").join(first, list(SERIES))
    return done.select(*SERIES, (F.col("_s0") + (F.col("rows") - 1) * up - F.col("_k") * rate).alias("threshold"))


def online_moments(errors: DataFrame, rate: float = 0.01) -> DataFrame:
    """Exponential mean and variance of the scores, starting at 0 and 1; the variance moves from the second score on. Null scores are left out."""
    return scan.fold(_scores(errors), SERIES, ["target_ts", "score"], ["score"], scan.Moments(rate), ["mean", "variance"]).drop("rows")


def _batches(errors: DataFrame, size: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*SERIES).orderBy("target_ts")) - 1
    return _scores(errors).withColumn("batch", F.floor(rn / size))


def batch_adapt(errors: DataFrame, start: float, size: int = 50, rate: float = 0.1, alpha: float = ALPHA) -> DataFrame:
    """Threshold after mixing in the quantile of every full batch."""
    b = _batches(errors, size).groupBy(*SERIES, "batch").agg(F.percentile("score", 1 - alpha).alias("q"), F.count("*").alias("n")).filter(F.col("n") == size)
    return scan.fold(b, SERIES, ["batch"], ["q"], scan.Decay(rate, [start]), ["threshold"]).withColumnRenamed("rows", "batches")


def sliding_threshold(errors: DataFrame, rows: int = 1000, least: int = 100, alpha: float = ALPHA, segment_rows: int = MOVING_ROWS) -> DataFrame:
    """Quantile of the most recent scores at every step, once enough were seen.

    A segment of a series, with the rows that its first frames reach back to, is worked off by ``moving.quantiles``: the
    cost of a row grows with the logarithm of the segment, whatever the frame.
    """
    s = _scores(errors).select(*SERIES, "target_ts", "score")

    def op(d: DataFrame, keys: Sequence[str]) -> DataFrame:
        schema = T.StructType([*d.schema.fields, T.StructField("threshold", T.DoubleType())])

        def run(table):
            import pyarrow as pa

            table = table.sort_by("target_ts")
            found = moving.quantiles(table.column("score").to_numpy(), rows, 1 - alpha, least)
            return table.append_column("threshold", pa.array(found, mask=np.isnan(found)))

        return d.groupBy(*keys).applyInArrow(run, schema)

    done = W.in_segments(s, op, rows - 1, segment_rows=max(segment_rows, rows), bucket="month", keys=SERIES, time="target_ts")
    return done.select(*SERIES, "target_ts", "threshold")


def coverage_monitor(errors: DataFrame, fit: DataFrame, size: int = 50, target: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Coverage of every batch and whether it is off the target."""
    b = _batches(errors, size).join(bounded_broadcast(fit), "model")
    c = b.groupBy(*SERIES, "batch").agg(F.avg((F.col("score") <= F.col("threshold")).cast("int")).alias("coverage"), F.max("target_ts").alias("until"))
    return c.withColumns({"coverage_error": F.abs(F.col("coverage") - target), "off": F.abs(F.col("coverage") - target) > tolerance})


# --- temporal -------------------------------------------------------------------------------

def _slot(kind: str, bins: int = 6) -> Column:
    return {"bin": F.floor(F.hour("target_ts") / (24 // bins)), "hour": F.hour("target_ts").cast("bigint"), "dow": F.weekday("target_ts").cast("bigint")}[kind]


def temporal_calibration(errors: DataFrame, bins: int = 6) -> DataFrame:
    """Mean, deviation and count of the scores by hour bin, hour and weekday."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _slot(k, bins).alias("slot")) for k in ("bin", "hour", "dow")])).alias("k")
    return _scores(errors).select("score", kinds).groupBy("k.kind", "k.slot").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n"))


def temporal_apply(forecasts: DataFrame, fit: DataFrame, tables: DataFrame, bins: int = 6) -> DataFrame:
    """Half width scaled by the time factors: 0.1 for hour and weekday, 0.05 for hour bin and weekday again."""
    slots = {k: tables.filter(F.col("kind") == k).select(F.col("slot").alias(f"_{k}"), F.col("mean").alias(f"m_{k}")) for k in ("bin", "hour", "dow")}
    j = conformal_half(forecasts, fit)
    for k, tab in slots.items():
        j = j.withColumn(f"_{k}", _slot(k, bins)).join(tab, f"_{k}", "left")

    def factor(k: str, w: float) -> Column:
        return F.coalesce((F.col(f"m_{k}") - 1) * w + 1, F.lit(1.0))

    half = F.col("half_width") * factor("hour", 0.1) * factor("dow", 0.1) * factor("bin", 0.05) * factor("dow", 0.05)
    return j.select(*forecasts.columns, half.alias("half_width"), (F.col("yhat") - half).alias("lower"), (F.col("yhat") + half).alias("upper"))


def conformal_half(forecasts: DataFrame, fit: DataFrame) -> DataFrame:
    return forecasts.join(bounded_broadcast(fit.select("model", F.col("threshold").alias("half_width"))), "model")


def decay_weights(errors: DataFrame, decay: float = 0.99) -> DataFrame:
    """Normalised exponential weights of a series, the latest the heaviest."""
    rn = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("target_ts"))) - 1
    w = errors.select(*SERIES, "target_ts", F.pow(F.lit(decay), rn.cast("double")).alias("_w"))
    return w.select(*SERIES, "target_ts", (F.col("_w") / F.sum("_w").over(Window.partitionBy(*SERIES))).alias("weight"))


# --- several targets ------------------------------------------------------------------------

def target_errors(raw: DataFrame) -> DataFrame:
    """Hourly mean of each parameter per station with its one-step error, as a long table."""
    h = raw.filter(F.col("value").between(0, 1000)).groupBy("station_id", "datetime_utc", F.col("parameter").alias("target")).agg(F.avg("value").alias("y"))
    prev = F.lag("y").over(Window.partitionBy("station_id", "target").orderBy("datetime_utc"))
    return h.withColumn("yhat", prev).filter(F.col("yhat").isNotNull()).withColumn("score", F.abs(F.col("y") - F.col("yhat")))


def multi_target(te: DataFrame, targets: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Threshold and weight (1 / threshold, normalised) per target, and the joint threshold on the mean score of hours with all targets."""
    own = quantile_columns(te, "score", {"threshold": 1 - alpha}, ["target"])
    joint = te.groupBy("station_id", "datetime_utc").agg(F.avg("score").alias("score"), F.count_distinct("target").alias("_k")).filter(F.col("_k") == len(targets))
    both = with_scalar(own, own.agg(F.sum(1 / F.col("threshold")).alias("_t")))
    return with_scalar(both, quantile_columns(joint, "score", {"joint_threshold": 1 - alpha})).select(
        "target", "threshold", (1 / F.col("threshold") / F.col("_t")).alias("weight"), "joint_threshold")


def target_corr(te: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Correlation of every two targets over hours with both."""
    wide = te.groupBy("station_id", "datetime_utc").pivot("target", list(targets)).agg(F.max("y"))
    from hazewell.operators.select import corr_pairs

    return corr_pairs(wide, targets, least=-1.0)


# --- ensembles ------------------------------------------------------------------------------

def ensemble_members(forecasts: DataFrame) -> DataFrame:
    """Mean, median, deviation and quartile distance over models per station and hour, with the score of the mean."""
    g = forecasts.groupBy("station_id", "target_ts").agg(
        F.max("y").alias("y"), F.avg("yhat").alias("mean"), F.percentile("yhat", 0.5).alias("median"), F.stddev_pop("yhat").alias("sigma"),
        (F.percentile("yhat", 0.75) - F.percentile("yhat", 0.25)).alias("iqr"))
    return g.withColumn("score", F.abs(F.col("y") - F.col("mean")) / (F.col("sigma") + 1e-8))


def ensemble_calibrate(members: DataFrame, alpha: float = ALPHA, levels: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """Bands from score quantiles, the conformal threshold, and the Beta-adjusted deviation."""
    q = quantile_columns(members, "score", {"_lo": levels[0], "_hi": levels[1], "_c": 1 - alpha})
    b = members.agg((F.count_if(F.col("score") <= 1) + 1).alias("_a"), (F.count_if(F.col("score") > 1) + 1).alias("_b"))
    a, bb = F.col("_a"), F.col("_b")
    var = a * bb / (F.pow(a + bb, 2) * (a + bb + 1))
    adj = F.col("sigma") * (1 + F.sqrt(var)) * 1.96
    j = with_scalar(with_scalar(members, q), b)
    m, s = F.col("mean"), F.col("sigma")
    return j.select(
        "station_id", "target_ts", "y", "mean", "median", "sigma", "iqr", (m - s * F.col("_lo")).alias("q_lower"), (m + s * F.col("_hi")).alias("q_upper"),
        (m - s * F.col("_c")).alias("c_lower"), (m + s * F.col("_c")).alias("c_upper"), (m - adj).alias("b_lower"), (m + adj).alias("b_upper"), (a / (a + bb)).alias("b_mean"))


def ensemble_eval(cal: DataFrame, alpha: float = ALPHA) -> DataFrame:
    cov = lambda p: F.avg(F.col("y").between(F.col(f"{p}_lower"), F.col(f"{p}_upper")).cast("int"))
    e = F.col("y") - F.col("mean")
    return cal.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.col("y") >= F.col("q_lower")).cast("int")).alias("q_lower_coverage"),
        F.avg((F.col("y") <= F.col("q_upper")).cast("int")).alias("q_upper_coverage"), cov("c").alias("c_coverage"), cov("b").alias("b_coverage"),
        F.abs(cov("c") - (1 - alpha)).alias("c_error"), F.abs(cov("b") - 0.95).alias("b_error"))


# --- scoring --------------------------------------------------------------------------------

def winkler(alpha: float) -> Column:
    y, lo, hi = F.col("y"), F.col("lower"), F.col("upper")
    return hi - lo + (F.greatest(F.lit(0.0), lo - y) + F.greatest(F.lit(0.0), y - hi)) * (2 / alpha)


def calibration_metrics(bands: DataFrame, target: float = 0.9, keys: Sequence[str] = ("model",)) -> DataFrame:
    c = F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("int"))
    w = F.avg(F.col("upper") - F.col("lower"))
    err = F.abs(c - target)
    return bands.groupBy(*keys).agg(
        c.alias("coverage"), err.alias("coverage_error"), w.alias("width"), F.try_divide(F.lit(1.0), w).alias("sharpness"),
        F.avg(winkler(1 - target)).alias("winkler"), (err + F.try_divide(w, F.stddev_pop("y"))).alias("interval_score"))


def bootstrap_metrics(bands: DataFrame, replicas: int = 1000, target: float = 0.9, level: float = 0.95, coverage_error: bool = False, blocks: int = 4096) -> DataFrame:
    """Mean and bounds of coverage, width and Winkler score, and if asked of the distance of coverage from the target, over replicas.

    The table is read once: rows are added up in blocks, dealt by a hash of their key, and replicas weigh blocks. Up to
    about ``blocks`` rows a model nearly every row is its own block; beyond, blocks are independent groups of rows of about
    equal size, whose weighted means spread as those of rows do. A model's blocks, at most ``blocks`` rows, are one group.
    """
    names = ["coverage", "width", "winkler", *["coverage_error"] * coverage_error]
    rows = bands.select("model", F.pmod(F.xxhash64("station_id", "target_ts"), F.lit(blocks)).alias("block"), F.col("y").between(F.col("lower"), F.col("upper")).cast("double").alias("c"),
                        (F.col("upper") - F.col("lower")).alias("w"), winkler(1 - target).alias("k"))
    sums = rows.groupBy("model", "block").agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in "cwk"], F.count("*").alias("n")).withColumn("key", F.xxhash64("block"))
    half = (1 - level) / 2

    def run(table):
        import pyarrow as pa

        values, n = (np.column_stack([table.column(x).to_numpy().astype(float) for x in some]) for some in ("cwk", "n"))
        centre = values.sum(axis=0) / n.sum()  # what replicas have in common is not summed again and again
        made = weighted_sums(table.column("key").to_numpy(), np.column_stack([values - centre * n, n]), replicas)
        made = made[made[:, 3] > 0]
        per = centre + made[:, :3] / made[:, 3:]
        per = np.column_stack([per, np.abs(per[:, 0] - target)])[:, : len(names)]
        # differences from one replica: what doesn't vary stays exactly that
        found = [per[0] + x for x in ((per - per[0]).mean(axis=0), *np.quantile(per - per[0], [half, 1 - half], axis=0))] if len(per) else [[None] * len(names)] * 3
        return pa.table([pa.array([table.column("model")[0].as_py()] * len(names), pa.string()), pa.array(names), *[pa.array(list(f), pa.float64()) for f in found]], ["model", "metric", "mean", "low", "high"])

    return sums.groupBy("model").applyInArrow(run, "model string, metric string, mean double, low double, high double")


def calibration_check(bands: DataFrame) -> DataFrame:
    """Rows that break the input rules: null, infinite, crossed bounds."""
    cols = ["y", "yhat", "lower", "upper"]
    null, inf = F.lit(False), F.lit(False)
    for c in cols:
        null, inf = null | F.col(c).isNull(), inf | (F.abs(c) == float("inf"))
    m = bands.agg(F.count("*").alias("n_rows"), F.count_if(null).alias("null_rows"), F.count_if(inf).alias("infinite_rows"), F.count_if(F.col("upper") < F.col("lower")).alias("crossed_rows"))
    return m.withColumn("valid", (F.col("null_rows") == 0) & (F.col("infinite_rows") == 0) & (F.col("crossed_rows") == 0))


def calibration_drift(monitor: DataFrame, window: int = 5, limit: float = 0.1) -> DataFrame:
    """Mean coverage of the recent batches against the same number before them."""
    w = Window.partitionBy(*SERIES).orderBy("batch")
    r, o = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(2 * window - 1), -window)
    d = F.abs(F.col("recent") - F.col("before"))
    m = monitor.select(*SERIES, "batch", F.avg("coverage").over(r).alias("recent"), F.when(F.count("*").over(o) == window, F.avg("coverage").over(o)).alias("before"))
    return m.filter(F.col("before").isNotNull()).withColumns({"drift": d, "severity": F.when(d > 0.2, "critical").when(d > limit, "warning").otherwise("none")})


def wrap_intervals(forecasts: DataFrame, fit: DataFrame) -> DataFrame:
    """Low, middle and high quantile rows of a base forecast from its conformal threshold."""
    parts = F.array(*[F.struct(F.lit(q).alias("quantile"), (F.col("yhat") + F.col("threshold") * k).alias("value")) for q, k in ((0.1, -1.0), (0.5, 0.0), (0.9, 1.0))])
    return forecasts.join(bounded_broadcast(fit), "model").select("model", "station_id", "target_ts", F.explode(parts).alias("r")).select("model", "station_id", "target_ts", "r.*")
