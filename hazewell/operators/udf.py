"""User functions: window functions, per-station models, metrics and a row generator.

Prefer column expressions; these are for logic they cannot hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.operators import windows as W


def rolling_apply(df: DataFrame, col: str, rows: int, fn: Callable[[np.ndarray], float], least: int = 1, name: str = "value") -> DataFrame:
    """A user function over the non-null values of a trailing frame (at most ``rows`` of them), in Arrow batches."""
    @F.pandas_udf(T.DoubleType())
    def call(frames: pd.Series) -> pd.Series:
        return pd.Series([float(fn(np.asarray(v, dtype=float))) if v is not None and len(v) >= least else None for v in frames], dtype="float64")

    return df.withColumn(name, call(F.collect_list(col).over(W.trailing(rows))))


MODELS: dict[str, tuple[Callable, Callable]] = {}


def register_model(name: str, fit: Callable[[pd.DataFrame], object], predict: Callable[[object, pd.DataFrame], np.ndarray]) -> None:
    """Add a model: ``fit(history)`` and ``predict(state, points)`` on one station's hours."""
    MODELS[name] = (fit, predict)


def run_model(name: str, history: DataFrame, points: DataFrame, col: str = "pm25") -> DataFrame:
    """Fit and predict per station.  A group is one station's hourly rows, bounded by the length of the record."""
    fit, predict = MODELS[name]

    def per_station(key, hist: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        if hist.empty or pts.empty:
            return pd.DataFrame({"station_id": [], "datetime_utc": [], "yhat": []}).astype({"station_id": "int64", "yhat": "float64", "datetime_utc": "datetime64[ns]"})
        pts = pts.sort_values("datetime_utc")
        yhat = predict(fit(hist.sort_values("datetime_utc")), pts)
        return pd.DataFrame({"station_id": key[0], "datetime_utc": pts["datetime_utc"].to_numpy(), "yhat": np.asarray(yhat, dtype=float)})

    h = history.select("station_id", "datetime_utc", col).groupBy("station_id")
    p = points.select("station_id", "datetime_utc").groupBy("station_id")
    return h.cogroup(p).applyInPandas(per_station, "station_id BIGINT, datetime_utc TIMESTAMP, yhat DOUBLE")


METRICS: dict[str, Callable[[], Column]] = {}


def register_metric(name: str, fn: Callable[[], Column]) -> None:
    """Add a metric as an aggregate column over ``y``, ``yhat`` and ``err``; it then combines before the shuffle."""
    METRICS[name] = fn


def run_metrics(errors: DataFrame, names: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    return errors.groupBy(*keys).agg(*[METRICS[n]().alias(n) for n in names])


@F.udtf(returnType="step: int, target_ts: timestamp")
class ForecastRows:
    """Hours after a start time, as a table function for SQL: ``LATERAL forecast_rows(start, hours)``."""

    def eval(self, start, hours):
        for i in range(1, int(hours) + 1):
            yield i, start + pd.Timedelta(hours=i)


def forecast_rows(df: DataFrame, hours: int) -> DataFrame:
    """Next hours of every station through the table function."""
    spark = df.sparkSession
    spark.udtf.register("forecast_rows", ForecastRows)
    last = df.groupBy("station_id").agg(F.max("datetime_utc").alias("start"))
    return spark.sql(f"SELECT s.station_id, f.step, f.target_ts FROM {{last}} s, LATERAL forecast_rows(s.start, {int(hours)}) f", last=last)
