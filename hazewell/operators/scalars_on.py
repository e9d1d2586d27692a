"""Table forms of scalar functions that need a scalar, a share or a fixed key list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.functions import scalars as S
from hazewell.operators.quantiles import exact_quantiles

KINDS = ["multiplicative", "ratio", "difference", "polynomial", "log_ratio"]


def with_scalar(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row; the broadcast side is one row by construction."""
    return df.crossJoin(F.broadcast(scalars))


def with_start(df: DataFrame) -> DataFrame:
    return with_scalar(df, df.agg(F.min("datetime_utc").alias("series_start")))


def distance_weights(stations: DataFrame, lat: float, lon: float) -> DataFrame:
    """Share of each station in its country, by weight and distance to a point.

    The country totals are a map-side aggregate joined back, so a country that holds most
    stations is never one task.
    """
    km = S.haversine(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))
    raw = stations.select("station_id", "country", S.distance_weight(F.col("weight"), km).alias("w"))
    total = raw.groupBy("country").agg(F.sum("w").alias("total"))
    return raw.join(total, "country").select("station_id", "country", (F.col("w") / F.col("total")).alias("share"))


def interactions(df: DataFrame, a: str, b: str, keys, kinds=tuple(KINDS)) -> DataFrame:
    """All pair features; gaps take the column median."""
    made = df.select(*keys, *[S.interact(F.col(a), F.col(b), k).alias(k) for k in kinds])
    long = made.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("x")) for k in kinds])).alias("c")).select("c.*")
    q = exact_quantiles(long, "x", [0.5], ["kind"])
    meds = q.agg(*[F.max(F.when(F.col("kind") == k, F.col("quantile"))).alias(f"med_{k}") for k in kinds])
    return with_scalar(made, meds).select(*keys, *[F.coalesce(k, f"med_{k}", F.lit(0.0)).alias(k) for k in kinds])


def daily_paths(df: DataFrame) -> DataFrame:
    """One ordered array of values per station and day (at most 24 values)."""
    row = F.struct("datetime_utc", "pm25")
    return df.groupBy("station_id", F.date_trunc("day", "datetime_utc").alias("day")).agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda r: r["pm25"]).alias("path")
    )


def one_hot(df: DataFrame, col: str, values: list, keys) -> DataFrame:
    return df.select(*keys, *[S.flag(F.col(col) == v).alias(f"{col}_{v}") for v in values])
