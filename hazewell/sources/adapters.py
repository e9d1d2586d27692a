"""Air-quality tables derived from the supplied parquet tables.

The supplied data holds no station readings, so each table of the data model is a
declared query over ``events`` (time series), ``supplier`` (stations) or ``orders``
(artifact log).  Everything is lazy; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazewell.functions import scalars as S
from hazewell.operators import forecast as fc

STATION_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
# Divisors that keep derived values off decimal rounding ties, so two engines round them alike.
GAIN = 1.0007
WIND_SCALE = 9.7
RAIN_SCALE = 49.3

POLLUTANTS = ["pm25", "pm10", "no2"]


def station_code(event_type: Column) -> Column:
    out = F.lit(6)
    for name, code in STATION_CODES.items():
        out = F.when(event_type == name, code).otherwise(out)
    return out.cast("bigint")


def _slot(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


class Tables:
    """Lazy tables of the data model over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return (
            self.table("events")
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("k", k)
            .withColumn("station", station_code(F.col("event_type")))
            .withColumn("hour_ts", F.date_trunc("hour", "ts"))
        )

    @cached_property
    def readings(self) -> DataFrame:
        """Dense hourly series of a few stations."""
        return (
            self.events.groupBy(F.col("station").alias("station_id"), F.col("hour_ts").alias("datetime_utc"))
            .agg((F.avg("value") / GAIN).alias("pm25"))
        )

    @cached_property
    def sparse(self) -> DataFrame:
        """Hourly series with long gaps; the number of stations grows with the data."""
        return (
            self.events.groupBy(F.col("user_id").alias("station_id"), F.col("hour_ts").alias("datetime_utc"))
            .agg((F.avg("value") / GAIN).alias("pm25"))
        )

    @cached_property
    def holed(self) -> DataFrame:
        """Readings with nulls where the hourly mean is low."""
        return self.readings.withColumn("pm25", F.when(F.col("pm25") >= 25, F.col("pm25")))

    @cached_property
    def weather(self) -> DataFrame:
        base = self.events.groupBy(F.col("hour_ts").alias("datetime_utc")).agg(
            (F.avg(F.col("user_id") % 100) / WIND_SCALE - 5).alias("u10"),
            (F.avg("value") / WIND_SCALE - 5).alias("v10"),
            (5 + (F.count("*") * 7) % 30).cast("double").alias("t2m_celsius"),
            (100 + 40 * F.count("*")).cast("double").alias("blh"),
        )
        return base.select(
            "*",
            S.wind_speed(F.col("u10"), F.col("v10")).alias("wind_speed"),
            S.wind_direction(F.col("u10"), F.col("v10")).alias("wind_direction"),
        )

    @cached_property
    def met(self) -> DataFrame:
        """Readings with the weather of their hour."""
        return self.readings.join(self.weather, "datetime_utc")

    @cached_property
    def rain_half(self) -> DataFrame:
        return self.events.groupBy(_slot(F.col("ts"), 1800).alias("datetime_utc")).agg(
            (F.avg("value") / RAIN_SCALE).alias("precipitation_mm_30min"),
            F.count("*").alias("valid_pixels"),
            (F.count("*") + 3).alias("total_pixels"),
        )

    @cached_property
    def rain(self) -> DataFrame:
        return self.rain_half.groupBy(F.date_trunc("hour", "datetime_utc").alias("datetime_utc")).agg(
            F.sum("precipitation_mm_30min").alias("precipitation_mm_hourly"),
            F.avg("valid_pixels").alias("valid_pixels"),
            F.avg("total_pixels").alias("total_pixels"),
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Long measurements with missing, negative and repeated values."""
        value = (
            F.when(F.col("k") == 0, F.lit(None).cast("double"))
            .when(F.col("k") == 1, -F.col("value"))
            .when(F.col("k") == 2, F.col("value") + 1000)
            .otherwise(F.col("value"))
        )
        return self.events.select(
            "event_id",
            F.col("station").alias("station_id"),
            F.col("user_id").alias("sensor_id"),
            F.element_at(F.array(*map(F.lit, POLLUTANTS)), (F.col("k") % 3 + 1).cast("int")).alias("parameter"),
            value.alias("value"),
            F.lit("ug/m3").alias("unit"),
            F.col("hour_ts").alias("datetime_utc"),
            F.round(27.7 + F.col("station") * 0.01, 4).alias("latitude"),
            F.round(85.3 + F.col("station") * 0.01, 4).alias("longitude"),
            F.when(F.col("k") % 10 == 0, "suspect").otherwise("valid").alias("quality_flag"),
            F.when(F.col("k") % 4 == 0, "synthetic").otherwise("real").alias("data_source"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Long weather grid: one row per hour and cell."""
        lat = F.round(27.4 + (F.col("user_id") % 7) * 0.1, 4)
        lon = F.round(84.8 + (F.col("user_id") % 9) * 0.1, 4)
        return self.events.groupBy(F.col("hour_ts").alias("time"), lat.alias("latitude"), lon.alias("longitude")).agg(
            (F.avg("value") / WIND_SCALE - 5).alias("u10"),
            (F.avg("k") / 19.3 - 2.5).alias("v10"),
            (F.avg("value") / 4.9 + 280).alias("t2m"),
            (F.avg("k") * 9.7 + 100).alias("blh"),
            F.when(F.max("k") % 5 == 0, -9999.9).otherwise(F.avg("value") / RAIN_SCALE).alias("precipitation"),
        )

    @cached_property
    def stations(self) -> DataFrame:
        """Station register: one row per supplier, with the measured span of the series of the same number."""
        seen = self.sparse.groupBy("station_id").agg(
            F.min("datetime_utc").alias("first_measurement"),
            F.max("datetime_utc").alias("last_measurement"),
            F.count("*").alias("n_readings"),
        )
        key = F.col("s_suppkey")
        reg = self.table("supplier").join(
            self.table("nation").select("n_nationkey", F.col("n_name").alias("country")),
            F.col("s_nationkey") == F.col("n_nationkey"),
        ).select(
            key.alias("station_id"),
            F.col("s_name").alias("name"),
            "country",
            F.round(26.5 + ((key * 37) % 300) / 100, 4).alias("latitude"),
            F.round(80 + ((key * 53) % 800) / 100, 4).alias("longitude"),
            (F.abs("s_acctbal") / 9973).alias("weight"),
        )
        n = F.coalesce("n_readings", F.lit(0))
        return reg.join(seen, "station_id", "left").select(
            *reg.columns,
            "first_measurement",
            "last_measurement",
            n.alias("n_readings"),
            F.datediff("last_measurement", "first_measurement").cast("bigint").alias("data_span_days"),
            (100 * (1 - F.least(F.lit(1.0), n / 80))).alias("missingness_pct"),
            F.least(F.lit(1.0), n / 75).alias("quality_score"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """Three simple forecasts of each reading, joined to what was measured."""
        return fc.simple_forecasts(self.readings)

    @cached_property
    def errors(self) -> DataFrame:
        return self.forecasts.select("*", (F.col("y") - F.col("yhat")).alias("err"))

    @cached_property
    def runs(self) -> DataFrame:
        """Run log of jobs: one row per event."""
        return self.events.select(
            F.col("event_type").alias("job"),
            F.col("event_id").alias("run_id"),
            "ts",
            (F.col("k") % 4 != 0).alias("ok"),
            F.col("value").alias("seconds"),
            F.col("k").alias("records"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """Alert log."""
        severity = (
            F.when(F.col("value") > 150, "critical").when(F.col("value") > 55, "high").when(F.col("value") > 35, "medium")
        ).otherwise("low")
        category = F.element_at(F.array(*map(F.lit, ["missing", "stale", "outlier"])), (F.col("k") % 3 + 1).cast("int"))
        return self.events.select(
            F.col("event_id").alias("alert_id"),
            "ts",
            F.col("station").alias("station_id"),
            "user_id",
            severity.alias("severity"),
            category.alias("category"),
            (F.col("k") % 2 == 0).alias("resolved"),
            "value",
        )

    @cached_property
    def lineage(self) -> DataFrame:
        """Lineage log: a tree of events by number."""
        kind = F.element_at(
            F.array(*map(F.lit, ["extract", "transform", "validate", "load"])), (F.col("k") % 4 + 1).cast("int")
        )
        return self.events.select(
            "event_id",
            "ts",
            kind.alias("kind"),
            F.col("event_type").alias("source"),
            F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3)).alias("parent_event_id"),
            F.col("station").alias("station_id"),
            F.col("k").alias("record_count"),
            (F.col("value") / 500).alias("quality"),
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        """Artifact log from orders."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("artifact_id"),
            F.concat(F.lit("store/"), F.col("o_custkey").cast("string")).alias("path"),
            F.col("o_orderstatus").alias("stage"),
            F.col("o_orderpriority").alias("source"),
            (F.col("o_custkey") % 50).alias("station_id"),
            F.col("o_totalprice").alias("size_bytes"),
            (F.col("o_orderkey") % 1000).alias("records"),
            F.date_format("o_orderdate", "yyyy-MM").alias("partition"),
            F.col("o_orderdate").cast("timestamp").alias("created"),
        )

    @cached_property
    def users(self) -> DataFrame:
        """User profiles: one row per customer."""
        key, seg, bal = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
        return self.table("customer").select(
            key.alias("user_id"),
            (key % 5 + 1).alias("station_id"),
            F.when(seg == "BUILDING", "child").when(seg == "HOUSEHOLD", "elderly").otherwise("adult").alias("age_group"),
            F.when(seg == "AUTOMOBILE", "asthma").when(seg == "MACHINERY", "heart_disease").otherwise("none").alias("condition"),
            F.when(bal > 5000, "high").otherwise("normal").alias("sensitivity"),
            F.when(bal < 2000, "active").otherwise("calm").alias("activity"),
            (F.col("c_nationkey") % 24).alias("quiet_start"),
            (F.col("c_nationkey") * 7 % 24).alias("quiet_end"),
            (key % 2 == 0).alias("email"),
            (key % 3 == 0).alias("sms"),
            (key % 5 == 0).alias("push"),
        )

    @cached_property
    def outlook(self) -> DataFrame:
        """Current value and the path ahead, one row per station and day."""
        path = F.transform(
            F.array_sort(F.collect_list(F.struct("datetime_utc", "pm25"))), lambda r: r["pm25"]
        )  # at most 24 hours
        days = self.readings.groupBy("station_id", F.date_trunc("day", "datetime_utc").alias("day")).agg(path.alias("p"))
        return days.filter(F.size("p") > 1).select(
            "station_id", "day", F.element_at("p", 1).alias("current"), F.slice("p", 2, 24).alias("path")
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Score of each feature under each method."""
        return self.events.groupBy(
            F.col("event_type").alias("method"), F.concat(F.lit("f"), F.col("user_id")).alias("feature")
        ).agg((F.avg("value") / 497).alias("score"))

    @cached_property
    def locations(self) -> DataFrame:
        """Nested location JSON: one text per station with its sensors."""
        sensor = F.struct(
            F.col("user_id").alias("id"),
            F.concat(F.lit("s"), F.col("user_id")).alias("name"),
            F.struct(F.col("event_type").alias("name"), F.lit("ug/m3").alias("units")).alias("parameter"),
        )
        per = self.events.select("user_id", "event_type").distinct()
        grouped = per.groupBy((F.col("user_id")).alias("id")).agg(F.sort_array(F.collect_list(sensor)).alias("sensors"))
        return grouped.select(
            F.to_json(
                F.struct(
                    "id",
                    F.concat(F.lit("loc"), F.col("id")).alias("name"),
                    F.struct(F.concat(F.lit("C"), F.col("id") % 4).alias("name")).alias("country"),
                    F.struct(
                        F.round(26.5 + (F.col("id") % 300) / 100, 4).alias("latitude"),
                        F.round(80 + (F.col("id") % 800) / 100, 4).alias("longitude"),
                    ).alias("coordinates"),
                    (F.col("id") % 3 == 0).alias("isMobile"),
                    "sensors",
                )
            ).alias("doc")
        )
