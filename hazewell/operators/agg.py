"""Grouped summaries. Every one is a partial aggregate, so a hot key sends one row per task to the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazewell.functions.rules import season_name
from hazewell.operators.scalars_on import with_scalar
from hazewell.sources import landing

TIME = "datetime_utc"

# Accepted spellings of each key parameter, in lower case.
PARAMETER_ALIASES = {
    "pm25": ["pm25", "pm2.5"],
    "pm10": ["pm10", "pm1.0"],
    "no2": ["no2"],
    "o3": ["o3", "ozone"],
    "so2": ["so2"],
    "co": ["co"],
    "temperature": ["temperature", "temp"],
    "humidity": ["humidity", "rh"],
    "pressure": ["pressure", "bp"],
}


def resample_hourly(half: DataFrame) -> DataFrame:
    """Half hours to hours: rain adds up, pixel counts average, empty hours stay with a sum of 0."""
    hours = landing.calendar(landing.span_of(half), "1 HOUR", "hour").withColumnRenamed("slot", TIME)
    summed = half.groupBy(F.date_trunc("hour", TIME).alias(TIME)).agg(
        F.sum("precipitation_mm_30min").alias("precipitation_mm_hourly"),
        F.avg("valid_pixels").alias("valid_pixels"),
        F.avg("total_pixels").alias("total_pixels"),
    )
    return hours.join(summed, TIME, "left").fillna(0.0, ["precipitation_mm_hourly"])


def first_per_hour(df: DataFrame) -> DataFrame:
    """Reading of the lowest station number in each hour."""
    return df.groupBy(TIME).agg(F.min(F.struct("station_id", "pm25")).alias("r")).select(TIME, "r.*")


def station_profile(raw: DataFrame) -> DataFrame:
    v = F.col("value")
    return raw.groupBy("station_id").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count("*").alias("n"), F.avg(v.isNull().cast("int")).alias("null_share"),
        F.min_by("latitude", "event_id").alias("latitude"), F.min_by("longitude", "event_id").alias("longitude"),
    )


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values per column, exact or by a sketch (relative error 1 %)."""
    f = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])


def value_counts(df: DataFrame, col: str, top: int) -> DataFrame:
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return with_scalar(n, total).select(col, "n", (F.col("n") * 100 / F.col("_t")).alias("percent")).orderBy(F.desc("n"), col).limit(top)


def param_summary(sensors: DataFrame) -> DataFrame:
    return sensors.groupBy("parameter", "unit").agg(
        F.count("sensor_id").alias("sensors"), F.min_by("country", F.struct("location_id", "sensor_id")).alias("first_country")
    )


def location_summary(locations: DataFrame) -> DataFrame:
    lat, lon = F.col("coordinates.latitude"), F.col("coordinates.longitude")
    return locations.groupBy(F.col("country.name").alias("country")).agg(
        F.count("*").alias("locations"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"),
        F.max(lon).alias("lon_max"), F.count_if("isMobile").alias("mobile"), F.count_if(~F.col("isMobile")).alias("fixed"),
    )


def readiness(sensors: DataFrame) -> DataFrame:
    """Sensors per key parameter (by any accepted spelling) and the share of key parameters present."""
    name = F.lower("parameter")
    counts = sensors.agg(*[F.count_if(name.isin(*alias)).alias(k) for k, alias in PARAMETER_ALIASES.items()])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("parameter"), F.col(k).alias("sensors")) for k in PARAMETER_ALIASES])).alias("p")).select("p.*")
    share = long.agg((F.count_if(F.col("sensors") > 0) * 100 / len(PARAMETER_ALIASES)).alias("completeness"))
    return with_scalar(long, share)


def artifact_rollup(a: DataFrame) -> DataFrame:
    return a.groupingSets([["source"], ["stage"], []], "source", "stage").agg(
        F.count("*").alias("n"), (F.sum("size_bytes") / 1048576).alias("size_mb"), F.sum("records").alias("records")
    )


def alert_rollup(a: DataFrame) -> DataFrame:
    keys = ["severity", "category", "station_id"]
    return a.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("active"), F.count_if("resolved").alias("resolved")
    )


def lineage_rollup(log: DataFrame) -> DataFrame:
    return log.groupingSets([["kind"], ["station_id"], []], "kind", "station_id").agg(
        F.count("*").alias("n"), F.sum("record_count").alias("records"), F.avg("record_count").alias("mean_records")
    )


def error_cube(errors: DataFrame) -> DataFrame:
    """MAE by model, season and hour of day with all subtotals."""
    return errors.select("model", season_name(F.col("target_ts")).alias("season"), F.hour("target_ts").alias("hour"), "err").cube(
        "model", "season", "hour").agg(F.avg(F.abs("err")).alias("mae"), F.count("*").alias("n"))


def error_rollup_sets(errors: DataFrame) -> DataFrame:
    return errors.rollup("model", "station_id", "horizon").agg(F.avg(F.abs("err")).alias("mae"), F.count("*").alias("n"))


def seasonal_profile(df: DataFrame, col: str = "pm25") -> DataFrame:
    """Hour-of-day and day-of-week deviations from the station mean."""
    mean = df.groupBy("station_id").agg(F.avg(col).alias("_m"))
    both = F.array(F.struct(F.lit("hour").alias("kind"), F.hour(TIME).alias("slot")), F.struct(F.lit("dow").alias("kind"), F.weekday(TIME).alias("slot")))
    slots = df.select("station_id", col, F.explode(both).alias("s")).groupBy("station_id", "s.kind", "s.slot").agg(F.avg(col).alias("_a"))
    return slots.join(mean, "station_id").select("station_id", "kind", "slot", (F.col("_a") - F.col("_m")).alias("deviation"))


def seasonal_strength(df: DataFrame, period: int, col: str = "pm25") -> DataFrame:
    """Variance of the phase means over the total variance, at most 1; 0 with fewer than two full periods."""
    pos = F.row_number().over(Window.partitionBy("station_id").orderBy(TIME)) - 1
    rows = df.select("station_id", F.col(col).alias("y"), (pos % period).alias("phase"))
    per = rows.groupBy("station_id", "phase").agg(F.avg("y").alias("pm"))
    tot = rows.groupBy("station_id").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.count("y").alias("n"))
    s = per.join(tot, "station_id").groupBy("station_id").agg(
        F.avg(F.pow(F.col("pm") - F.col("m"), 2)).alias("sv"), F.first("v").alias("v"), F.first("n").alias("n"))
    ok = (F.col("n") >= 2 * period) & (F.col("v") > 0)
    return s.select("station_id", F.when(ok, F.least(F.lit(1.0), F.col("sv") / F.col("v"))).otherwise(0.0).alias("strength"))


def mad(df: DataFrame, col: str = "pm25") -> DataFrame:
    mean = df.groupBy("station_id").agg(F.avg(col).alias("_m"))
    return df.join(mean, "station_id").groupBy("station_id").agg(F.avg(F.abs(F.col(col) - F.col("_m"))).alias("mad"))


def notification_rollup(alerts: DataFrame, channels: Sequence[str] = ("missing", "stale", "outlier")) -> DataFrame:
    """Per user: sent, failed, success share, last time, and a column per channel."""
    return alerts.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if("resolved").alias("sent"), F.count_if(~F.col("resolved")).alias("failed"),
        F.avg(F.col("resolved").cast("int")).alias("success_share"), F.max("ts").alias("last_ts"),
        *[F.count_if(F.col("category") == c).alias(f"ch_{c}") for c in channels],
    )


def channel_pivot(alerts: DataFrame, channels: Sequence[str] = ("missing", "stale", "outlier")) -> DataFrame:
    return alerts.groupBy("user_id").pivot("category", list(channels)).agg(F.count(F.lit(1)))


def quality_rollup(alerts: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Per station over the last hours: mean score and status counts."""
    recent = alerts.filter(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.groupBy("station_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("low", "medium", "high", "critical")],
        F.max("ts").alias("last_ts"),
    )


def performance_rollup(errors: DataFrame, as_of: str, days: int) -> DataFrame:
    """Per model over a trailing window: MAE, RMSE, samples and rating."""
    recent = errors.filter(F.col("target_ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    out = recent.groupBy("model").agg(
        F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.count("*").alias("samples"))
    return out.withColumn("rating", F.when(F.col("mae") < 10, "excellent").when(F.col("mae") < 20, "good").otherwise("retrain"))


def throughput_rollup(runs: DataFrame) -> DataFrame:
    rate = F.when(F.col("seconds") > 0, F.col("records") / F.col("seconds"))
    return runs.groupBy("job").agg(
        F.count("*").alias("operations"), F.avg("seconds").alias("mean_seconds"), F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"), F.avg(rate).alias("mean_rate"), F.sum("records").alias("records"))


def importance_pivot(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    return scores.groupBy("feature").pivot("method", list(methods)).agg(F.max("score"))


def file_quality_rollup(q: DataFrame) -> DataFrame:
    """One row: files, rows, mean score of scored files and class counts."""
    s = F.col("score")
    return q.agg(
        F.count("*").alias("files"), F.sum("n_rows").alias("total_rows"), F.avg(F.when(s > 0, s)).alias("mean_score"),
        F.count_if(s >= 0.8).alias("excellent"), F.count_if((s >= 0.6) & (s < 0.8)).alias("good"),
        F.count_if((s >= 0.4) & (s < 0.6)).alias("fair"), F.count_if(s < 0.4).alias("poor"))


def most_frequent(df: DataFrame, items: str, top: int, name: str = "item") -> DataFrame:
    """Most frequent entries of an array column."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(top)


def availability(log: DataFrame) -> DataFrame:
    """Days checked, successful days, percent, mean response time."""
    return log.agg(
        F.count("*").alias("days_checked"), F.count_if("ok").alias("days_ok"),
        F.round(F.avg(F.col("ok").cast("int")) * 100, 1).alias("percent"), F.avg("response").alias("mean_response"))
