"""Health summaries, advice, threshold alerts, delivery rules and run monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazewell.functions import scalars as S
from hazewell.operators.scalars_on import with_scalar
from hazewell.operators.windows import last_n

# Fixed values.
RISK_LEVELS = [(12, "low"), (35, "moderate"), (55, "high"), (150, "very_high")]
ADVICE_LEVELS = [(12, ("good air", 1)), (35, ("moderate air", 2)), (55, ("unhealthy for sensitive groups", 3)), (150, ("unhealthy air", 3))]
HAZARD = ("hazardous air", 4)
EMERGENCY = 200.0
EXPIRY_HOURS = {"critical": 24, "high": 12}
DEFAULT_CHANNELS = ["email"]


def peak(path: str = "path") -> tuple[Column, Column]:
    """Greatest value of a path and its 0-based hour."""
    top = F.array_max(path)
    return top, F.array_position(path, top) - 1


def health_summary(outlook: DataFrame) -> DataFrame:
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    trend = F.when(last > first * 1.2, "worsening").when(last < first * 0.8, "improving").otherwise("stable")
    return outlook.select(
        "station_id", "day", "current", S.ladder(F.col("current"), RISK_LEVELS, "critical").alias("risk"), trend.alias("trend"), peak()[0].alias("peak"))


def advice(outlook: DataFrame, users: DataFrame, most: int = 10) -> DataFrame:
    """Advice rows per user, most urgent first: level, forecast peak, improvement, and profile rules.

    Rules of a user form one short array in the row; it is ordered and cut there, without a shuffle.
    """
    top, _ = peak()
    x = F.col("current")

    def rule(cond: Column, title: str, priority: int) -> Column:
        return F.when(cond, F.struct(F.lit(-priority).alias("order"), F.lit(title).alias("title")))

    level, low = [], None
    for edge, (title, p) in [*ADVICE_LEVELS, (None, HAZARD)]:
        cond = F.lit(True) if low is None else x > low
        level.append(rule(cond if edge is None else cond & (x <= edge), title, p))
        low = edge
    rules = F.array(
        *level,
        rule(top > 55, "poor air ahead", 3),
        rule(F.element_at("path", -1) < F.element_at("path", 1) * 0.8, "air improves", 1),
        rule((F.col("sensitivity") == "high") & (x > 25), "high sensitivity", 3),
        rule(F.col("activity") == "active", "active lifestyle", 2),
        rule(F.col("age_group") == "child", "child safety", 3),
        rule(F.col("age_group") == "elderly", "elderly health", 3),
        rule(F.col("condition") == "asthma", "asthma management", 3),
        rule(F.col("condition") == "heart_disease", "heart precautions", 3),
    )
    j = users.join(outlook, "station_id")
    listed = F.slice(F.array_sort(F.array_compact(rules)), 1, most)
    return j.select("user_id", "station_id", F.posexplode(listed).alias("pos", "r")).select(
        "user_id", "station_id", (F.col("pos") + 1).alias("rank"), F.col("r.title").alias("title"), (-F.col("r.order")).alias("priority"))


def _fired(df: DataFrame, rules: Sequence[tuple[str, str, Column, Column, Column]], keys: Sequence[str]) -> DataFrame:
    made = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(sev).alias("severity"), value.alias("value"), hour.cast("bigint").alias("hour"))) for kind, sev, cond, value, hour in rules]))
    return df.select(*keys, F.explode(made).alias("a")).select(*keys, "a.*")


def emergencies(outlook: DataFrame, limit: float = EMERGENCY) -> DataFrame:
    top, hour = peak()
    return _fired(outlook, [
        ("emergency", "critical", F.col("current") >= limit, F.col("current"), F.lit(0)),
        ("forecast_emergency", "high", top >= limit, top, hour)], ["station_id", "day"])


def threshold_alerts(outlook: DataFrame, warning: float = 35.0, critical: float = 55.0, emergency: float = 150.0) -> DataFrame:
    """At most one alert for the value now and one for the peak ahead, the highest step that holds."""
    x, (top, hour) = F.col("current"), peak()
    return _fired(outlook, [
        ("emergency", "critical", x >= emergency, x, F.lit(0)),
        ("critical", "high", (x >= critical) & (x < emergency), x, F.lit(0)),
        ("warning", "medium", (x >= warning) & (x < critical), x, F.lit(0)),
        ("forecast_emergency", "high", top >= emergency, top, hour),
        ("forecast_critical", "medium", (top >= critical) & (top < emergency), top, hour)], ["station_id", "day"])


def alert_expiry(alerts: DataFrame, as_of: str) -> DataFrame:
    """Expiry time by severity and whether it has passed."""
    hours = F.lit(6)
    for s, h in EXPIRY_HOURS.items():
        hours = F.when(F.col("severity") == s, h).otherwise(hours)
    at = F.timestamp_micros(F.unix_micros("ts") + hours.cast("bigint") * 3_600_000_000)
    return alerts.withColumn("expires", at).withColumn("expired", F.col("expires") < F.lit(as_of).cast("timestamp"))


def alert_channels(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """A row per alert and channel of its user, or the default channels for a user without preferences."""
    prefs = users.select("user_id", F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("email", "sms", "push")])).alias("_own"))
    j = alerts.join(prefs, "user_id", "left")
    return j.select("alert_id", "user_id", F.explode(F.coalesce("_own", F.array(*map(F.lit, DEFAULT_CHANNELS)))).alias("channel"))


def in_quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """Start is inside, end is outside; a start after the end wraps over midnight."""
    return F.when(start <= end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def quiet_hours(alerts: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select("user_id", "quiet_start", "quiet_end")
    return alerts.join(u, "user_id").select("alert_id", "user_id", in_quiet_hours(F.hour("ts"), F.col("quiet_start"), F.col("quiet_end")).alias("quiet"))


def rate_limit(alerts: DataFrame, per_hour: int = 10, per_day: int = 50) -> DataFrame:
    """Alerts that may be sent: first ones of each user and hour, then of each user and day.

    Both limits are rank filters, which the optimizer applies below the shuffle, so a flood of one user shrinks first.
    """
    order = [F.col("ts"), F.col("alert_id")]
    h = alerts.withColumn("_h", F.row_number().over(Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy(*order))).filter(F.col("_h") <= per_hour)
    d = h.withColumn("_d", F.row_number().over(Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy(*order))).filter(F.col("_d") <= per_day)
    return d.drop("_h", "_d")


def run_metrics(runs: DataFrame, recent: int = 100) -> DataFrame:
    """Per job: runs, success percent, mean seconds of the last runs, failures since the last success."""
    base = runs.groupBy("job").agg(
        F.count("*").alias("runs"), (F.avg(F.col("ok").cast("int")) * 100).alias("uptime"),
        F.max(F.when(F.col("ok"), F.struct("ts", "run_id"))).alias("_last_ok"), F.max("ts").alias("last_run"))
    tail = last_n(runs, recent, ["ts", "run_id"], ["job"]).groupBy("job").agg(F.avg("seconds").alias("mean_seconds"))
    marks = base.select("job", "_last_ok")
    streak = runs.join(marks, "job").filter(F.col("_last_ok").isNull() | (F.struct("ts", "run_id") > F.col("_last_ok"))).groupBy("job").agg(
        F.count("*").alias("failures_in_row"))
    return base.join(tail, "job").join(streak, "job", "left").select(
        "job", "runs", "uptime", "mean_seconds", F.coalesce("failures_in_row", F.lit(0)).alias("failures_in_row"), "last_run")


def run_insights(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Fired rules: three failures in a row, uptime below 80 %, and more than 10 % failures of all recent runs."""
    m = run_metrics(runs)
    rules = F.array_compact(F.array(
        F.when(F.col("failures_in_row") >= 3, F.struct(F.lit("failures").alias("rule"), F.lit("high").alias("severity"), F.col("failures_in_row").cast("double").alias("value"))),
        F.when(F.col("uptime") < 80, F.struct(F.lit("uptime").alias("rule"), F.lit("medium").alias("severity"), F.col("uptime").alias("value")))))
    per = m.select("job", F.explode(rules).alias("r")).select("job", "r.*")
    recent = runs.filter(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")).agg((1 - F.avg(F.col("ok").cast("int"))).alias("value"))
    whole = recent.filter(F.col("value") > 0.1).select(F.lit("all").alias("job"), F.lit("failure_share").alias("rule"), F.lit("high").alias("severity"), "value")
    return per.unionByName(whole)
