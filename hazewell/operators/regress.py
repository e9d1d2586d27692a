"""Regressions per station from sums of products: additive models, autoregressions with moving-average terms, unit-root tests.

Tasks add up the products of the columns of a design, key by key and batch by batch; a key's sums meet as one small matrix a
task, and its fit is one solution of normal equations. No task holds a series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.session import stored

TIME = "datetime_utc"
#: Numbers of matrices that a task holds before it passes them on.
HELD = 2_000_000


def gram(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], design: Callable[[np.ndarray], np.ndarray], finish: Callable, schema: str) -> DataFrame:
    """``finish(key row, sums of products, rows)`` for every key: an Arrow table made of the matrix D'D, D being
    ``design(inputs)`` of all its rows. Rows with a null input are left out. ``keys`` hold what ``finish`` needs to know of a key."""
    k = len(keys)

    def run(batches):
        held: dict = {}

        def out():
            names, made = list(held), list(held.values())
            columns = [pa.array([n[i] for n in names], types[i]) for i in range(k)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in made]), pa.array([m.ravel() for _, m in made], pa.list_(pa.float64()))], [*keys, "n", "m"])

        types = None
        for batch in batches:
            types = types or [batch.column(i).type for i in range(k)]
            if not len(batch):
                continue
            x = batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(inputs))
            table = pa.table({**{f"k{i}": batch.column(i) for i in range(k)}, "row": pa.array(np.arange(len(batch)))})
            for group in table.group_by([f"k{i}" for i in range(k)]).aggregate([("row", "list")]).to_pylist():
                d = design(x[group["row_list"]])
                key = tuple(group[f"k{i}"] for i in range(k))
                n, m = held.get(key, (0, 0.0))
                held[key] = (n + len(d), m + d.T @ d)
            if sum(m.size for _, m in held.values()) > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    def solve(table):
        m = np.sum([np.asarray(v.as_py()) for v in table.column("m")], axis=0)
        side = int(round(len(m) ** 0.5))
        return finish(table.select(list(keys)).slice(0, 1), m.reshape(side, side), int(np.sum(table.column("n").to_numpy())))

    # one array: a filter on each of many columns makes the optimizer weigh all their combinations
    rows = df.select(*keys, F.array(*[F.col(c).cast("double") for c in inputs]).alias("_in")).filter(~F.exists("_in", F.isnull))
    sums = T.StructType([*[rows.schema[c] for c in keys], T.StructField("n", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, sums).groupBy(*keys).applyInArrow(solve, schema)


def solved(m: np.ndarray, target: int, use: Sequence[int], penalty: np.ndarray | float = 0.0):
    """Coefficients of the columns ``use`` for the column ``target``, the residual sum of squares, and the inverse; columns that others determine get the least coefficients."""
    use = list(use)
    a = m[np.ix_(use, use)] + np.diag(np.broadcast_to(penalty, len(use)).astype(float))
    inverse = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
    coef = inverse @ m[use, target]
    rss = m[target, target] - 2 * coef @ m[use, target] + coef @ m[np.ix_(use, use)] @ coef
    return coef, max(float(rss), 0.0), inverse


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + ", " + more


# --- additive model -------------------------------------------------------------------------

DAY, WEEK, YEAR = 86_400.0, 604_800.0, 31_557_600.0


class Additive:
    """Trend with changes of slope, and daily, weekly and yearly waves.

    Changes lie evenly over the first ``reach`` of a station's span. Waves are sums of ``daily``, ``weekly``, ``yearly``
    sines and cosines; a period that the span doesn't hold twice has none. Scales are those of normal priors: slope changes
    near 0 unless the data say otherwise. ``regressors`` are columns of the table, taken as they are.
    """

    def __init__(self, changes: int = 25, reach: float = 0.8, daily: int = 4, weekly: int = 3, yearly: int = 10, change_scale: float = 0.05, wave_scale: float = 10.0, regressors: Sequence[str] = ()):
        self.changes, self.reach, self.waves = changes, reach, [(DAY, daily), (WEEK, weekly), (YEAR, yearly)]
        self.change_scale, self.wave_scale, self.regressors = change_scale, wave_scale, tuple(regressors)

    @property
    def width(self) -> int:
        return 2 + self.changes + 2 * sum(n for _, n in self.waves) + len(self.regressors)

    def design(self, t: np.ndarray, seconds: np.ndarray, span: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Columns for rows at share ``t`` of the span (seconds) and unix time ``seconds``."""
        at = np.arange(1, self.changes + 1) / max(self.changes, 1) * self.reach
        parts = [np.ones((len(t), 1)), t[:, None], np.maximum(0.0, t[:, None] - at[None])]
        for period, n in self.waves:
            angle = 2 * np.pi * (seconds[:, None] / period) * np.arange(1, n + 1)[None]
            there = (span >= 2 * period)[:, None]
            parts += [np.where(there, np.sin(angle), 0.0), np.where(there, np.cos(angle), 0.0)]
        return np.concatenate([*parts, more], axis=1)

    def penalty(self, noise: float) -> np.ndarray:
        """Weights of squared coefficients against squared errors of scaled values, for errors of this variance."""
        waves = 2 * sum(n for _, n in self.waves)
        scales = np.concatenate([np.full(2, np.inf), np.full(self.changes, self.change_scale), np.full(waves, self.wave_scale), np.full(len(self.regressors), np.inf)])
        return np.where(np.isinf(scales), 0.0, noise / scales**2)


def _seconds(col: str = TIME) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp")) / 1e6


def additive_fit(df: DataFrame, form: Additive, col: str = "pm25", rounds: int = 3) -> DataFrame:
    """station_id, start and span (seconds), unit (values are divided by it), coef, sigma, n: one row for each station with rows.

    The error variance that weighs the priors is found in ``rounds`` solutions of the same sums.
    """
    rows = df.select("station_id", F.col(col).cast("double").alias("_y"), _seconds().alias("_s"), *form.regressors).filter(F.col("_y").isNotNull())
    scale = rows.groupBy("station_id").agg(F.min("_s").alias("start"), F.greatest(F.max("_s") - F.min("_s"), F.lit(1.0)).alias("span"), F.greatest(F.max(F.abs("_y")), F.lit(1e-9)).alias("unit"))
    keys = ["station_id", "start", "span", "unit"]
    j = rows.join(scale, "station_id").withColumns({"_t": (F.col("_s") - F.col("start")) / F.col("span"), "_v": F.col("_y") / F.col("unit"), "_w": F.col("span")})

    def design(x):
        return np.concatenate([form.design(x[:, 0], x[:, 1], x[:, 2], x[:, 4:]), x[:, 3:4]], axis=1)

    def finish(key, m, n):
        noise = 0.0
        for _ in range(max(1, rounds)):
            coef, rss, _ = solved(m, form.width, range(form.width), form.penalty(noise))
            noise = rss / max(n, 1)
        unit = key.column("unit")[0].as_py()
        return key.append_column("coef", pa.array([coef], pa.list_(pa.float64()))).append_column("sigma", pa.array([noise**0.5 * unit])).append_column("n", pa.array([n]))

    return gram(j, keys, ["_t", "_s", "_w", "_v", *form.regressors], design, finish, _schema(j, keys, "coef array<double>, sigma double, n long"))


def additive_predict(fit: DataFrame, points: DataFrame, form: Additive, floor: float | None = 0.0, z: float = 1.28) -> DataFrame:
    """station_id, datetime_utc, trend, yhat, q10, q90 for points (station_id, datetime_utc, regressors).

    Beyond the data the trend may change as often as before, by as much as its changes were on average: that widens the band.
    """
    j = points.join(fit, "station_id").select("station_id", TIME, "start", "span", "unit", "sigma", "coef", _seconds().alias("_s"), *[F.col(c).cast("double") for c in form.regressors])

    def run(batches):
        for batch in batches:
            start, span, unit, sigma = (batch.column(i).to_numpy() for i in range(2, 6))
            coef = batch.column(6).flatten().to_numpy().reshape(len(batch), form.width)
            s = batch.column(7).to_numpy()
            more = np.column_stack([np.zeros((len(batch), 0)), *[batch.column(8 + i).to_numpy(zero_copy_only=False) for i in range(len(form.regressors))]])
            t = (s - start) / span
            d = form.design(t, s, span, more) * coef * unit[:, None]
            y, trend = d.sum(axis=1), d[:, : 2 + form.changes].sum(axis=1)
            size = np.abs(coef[:, 2 : 2 + form.changes]).mean(axis=1) if form.changes else np.zeros(len(t))
            ahead = np.maximum(0.0, t - 1.0)
            drift = 2 * size**2 * (form.changes / max(form.reach, 1e-9)) * ahead**3 / 3 * unit**2
            half = z * np.sqrt(sigma**2 + drift)
            least = -np.inf if floor is None else floor
            out = [np.maximum(least, v) for v in (y, y - half, y + half)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trend), *map(pa.array, out)], ["station_id", TIME, "trend", "yhat", "q10", "q90"])

    kinds = T.StructType([T.StructField(c, points.schema[c].dataType) for c in ("station_id", TIME)] + [T.StructField(c, T.DoubleType()) for c in ("trend", "yhat", "q10", "q90")])
    return j.mapInArrow(run, kinds)


# --- autoregression with moving-average terms -------------------------------------------------

def _lags(df: DataFrame, col: str, n: int, prefix: str, keys: Sequence[str] = ("station_id",), time: str = TIME) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumns({f"{prefix}{i}": F.lag(col, i).over(w) for i in range(1, n + 1)})


def arma_fit(df: DataFrame, p: int = 3, q: int = 2, regressors: Sequence[str] = (), col: str = "pm25", long: int = 24) -> DataFrame:
    """Per station: order (ar, ma), intercept, phi (p), theta (q), beta, sigma, n, criterion, and the last values and errors.

    Two regressions: a long autoregression gives errors; then values meet their own lags, lags of these errors, and the
    regressors. All orders up to (p, q) are solved from the same sums, and the least n ln(rss / n) + k ln(n) is taken. Lags are rows
    of the hourly contract; rows without a value are left out first.
    """
    rows = df.filter(F.col(col).isNotNull()).select("station_id", TIME, F.col(col).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in regressors])
    first = _lags(rows, "_y", long, "_l")
    names = [f"_l{i}" for i in range(1, long + 1)]
    one = lambda x: np.concatenate([np.ones((len(x), 1)), x], axis=1)

    def stage_one(key, m, n):
        coef, *_ = solved(m, long + 1, range(long + 1))
        return key.append_column("c", pa.array([coef], pa.list_(pa.float64())))

    fit1 = gram(first, ["station_id"], [*names, "_y"], one, stage_one, _schema(rows, ["station_id"], "c array<double>"))
    guess = F.aggregate(F.zip_with(F.slice("c", 2, long), F.array(*names), lambda a, b: a * b), F.col("c")[0], lambda a, b: a + b)  # null where a lag is
    errors = stored(first.join(fit1, "station_id").select("station_id", TIME, "_y", (F.col("_y") - guess).alias("_e"), *regressors), "arma-errors")
    second = _lags(_lags(errors, "_y", p, "_a"), "_e", q, "_m")
    lags = [*[f"_a{i}" for i in range(1, p + 1)], *[f"_m{i}" for i in range(1, q + 1)]]
    x = len(regressors)
    target = 1 + p + q + x

    def stage_two(key, m, n):
        best = None
        for a in range(p + 1):
            for b in range(q + 1):
                use = [0, *range(1, 1 + a), *range(1 + p, 1 + p + b), *range(1 + p + q, target)]
                coef, rss, _ = solved(m, target, use)
                score = n * np.log(max(rss / n, 1e-300)) + len(use) * np.log(n)
                if best is None or score < best[0] - 1e-9:
                    best = (score, a, b, coef, rss)
        score, a, b, coef, rss = best
        phi, theta = np.zeros(p), np.zeros(q)
        phi[:a], theta[:b] = coef[1 : 1 + a], coef[1 + a : 1 + a + b]
        values = [a, b, coef[0], phi, theta, coef[1 + a + b :], (rss / max(n - len(coef), 1)) ** 0.5, n, score]
        kinds = [pa.int32(), pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.int64(), pa.float64()]
        for name, v, kind in zip(("ar", "ma", "intercept", "phi", "theta", "beta", "sigma", "n", "criterion"), values, kinds):
            key = key.append_column(name, pa.array([v], kind))
        return key

    out = "ar int, ma int, intercept double, phi array<double>, theta array<double>, beta array<double>, sigma double, n long, criterion double"
    fit2 = gram(second, ["station_id"], [*lags, *regressors, "_y"], one, stage_two, _schema(rows, ["station_id"], out))
    # the newest values and errors, newest first: at most p and q of a station
    newest = F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc(TIME)))
    last = errors.withColumn("_r", newest).filter(F.col("_r") <= max(p, q, 1)).groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("_r", "_y", "_e"))).alias("_l"))
    return fit2.join(last, "station_id").select(
        "station_id", "ar", "ma", "intercept", "phi", "theta", "beta", "sigma", "n", "criterion", F.transform("_l", lambda r: r["_y"]).alias("values"), F.transform("_l", lambda r: r["_e"]).alias("errors"))


def arma_path(intercept: float, phi, theta, sigma: float, values, errors, drive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and their deviations step by step; ``drive`` is what regressors add to each step."""
    phi, theta = np.asarray(phi, float), np.asarray(theta, float)
    past, shocks, n = list(values), list(errors), len(drive)
    y, weight = np.empty(n), np.zeros(n)
    for h in range(n):
        y[h] = intercept + drive[h] + sum(c * v for c, v in zip(phi, past)) + sum(c * e for c, e in zip(theta, shocks))
        past, shocks = [y[h], *past][: max(len(phi), 1)], [0.0, *shocks][: max(len(theta), 1)]
        # weight of a shock h steps back
        weight[h] = 1.0 if h == 0 else (theta[h - 1] if h <= len(theta) else 0.0) + sum(phi[i] * weight[h - 1 - i] for i in range(min(len(phi), h)))
    return y, sigma * np.sqrt(np.cumsum(weight**2))


def arma_predict(fit: DataFrame, points: DataFrame, regressors: Sequence[str] = (), z: float = 1.64) -> DataFrame:
    """station_id, step, datetime_utc, yhat, q10, q90 for points (station_id, step from 1 on without gaps, datetime_utc, regressors); a missing regressor counts as 0."""
    rows = points.select("station_id", F.col("step").cast("long").alias("step"), TIME, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in regressors])

    def run(left, right):
        if not len(left) or not len(right):
            return left.slice(0, 0).select(["station_id", "step", TIME]).append_column("yhat", pa.array([], pa.float64())).append_column("q10", pa.array([], pa.float64())).append_column("q90", pa.array([], pa.float64()))
        left = left.sort_by("step")
        f = right.to_pylist()[0]
        drive = np.zeros(len(left))
        for c, b in zip(regressors, f["beta"]):
            drive += b * left.column(c).to_numpy()
        y, dev = arma_path(f["intercept"], f["phi"], f["theta"], f["sigma"], f["values"], f["errors"], drive)
        out = left.select(["station_id", "step", TIME])
        for name, v in (("yhat", y), ("q10", np.maximum(0.0, y - z * dev)), ("q90", y + z * dev)):
            out = out.append_column(name, pa.array(v))
        return out

    kinds = T.StructType([T.StructField("station_id", points.schema["station_id"].dataType), T.StructField("step", T.LongType()), T.StructField(TIME, points.schema[TIME].dataType)]
                         + [T.StructField(c, T.DoubleType()) for c in ("yhat", "q10", "q90")])
    return rows.groupBy("station_id").cogroup(fit.groupBy("station_id")).applyInArrow(run, kinds)


# --- unit root --------------------------------------------------------------------------------

#: Five per cent points of the unit-root statistic with a constant, as a polynomial in 1 / n.
FIVE_PERCENT = (-2.86154, -2.8903, -4.234, -40.04)


def unit_root(errors: DataFrame, keys: Sequence[str] = ("model", "station_id"), value: str = "err", time: str = "target_ts", most_lags: int = 12) -> DataFrame:
    """Augmented unit-root test per series: statistic, lags, n, critical (5 %), stationary.

    Changes are regressed on a constant, the level before, and lagged changes; the number of lags, up to ``most_lags``, is the
    one with the least n ln(rss / n) + 2 k, all from one set of sums over the rows that have all lags. Null values are left
    out first. A series too short or without variation has null results.
    """
    rows = errors.filter(F.col(value).isNotNull()).select(*keys, time, F.col(value).cast("double").alias("_y"))
    w = Window.partitionBy(*keys).orderBy(time)
    rows = rows.withColumn("_level", F.lag("_y").over(w)).withColumn("_d", F.col("_y") - F.col("_level"))
    rows = _lags(rows, "_d", most_lags, "_d", keys, time)
    one = lambda x: np.concatenate([np.ones((len(x), 1)), x], axis=1)
    target = 2 + most_lags

    def finish(key, m, n):
        best = None
        for lags in range(most_lags + 1):
            use = range(2 + lags)
            coef, rss, inverse = solved(m, target, use)
            score = n * np.log(max(rss / n, 1e-300)) + 2 * len(use)
            if n > len(use) and rss > 0 and (best is None or score < best[0]):
                best = (score, lags, float(coef[1] / np.sqrt(rss / (n - len(use)) * inverse[1, 1])))
        critical = sum(c / n**i for i, c in enumerate(FIVE_PERCENT))
        found = [None] * 2 if best is None or not np.isfinite(best[2]) else [best[2], best[1]]
        values = [*found, n, critical, None if found[0] is None else found[0] < critical]
        for name, v, kind in zip(("statistic", "lags", "n", "critical", "stationary"), values, (pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_())):
            key = key.append_column(name, pa.array([v], kind))
        return key

    inputs = ["_level", *[f"_d{i}" for i in range(1, most_lags + 1)], "_d"]
    return gram(rows, list(keys), inputs, one, finish, _schema(rows, keys, "statistic double, lags int, n long, critical double, stationary boolean"))
