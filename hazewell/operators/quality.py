"""Completeness, gaps, validity scores, alerts and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.functions import scalars as S
from hazewell.operators import celltree
from hazewell.operators import joins as J
from hazewell.operators.scalars_on import with_scalar

TIME = "datetime_utc"

# Fixed values.
VARIABLE_BOUNDS = {
    "u10": (-50, 50),
    "v10": (-50, 50),
    "wind_speed": (0, 50),
    "wind_direction": (0, 360),
    "t2m_celsius": (-60, 60),
    "t2m": (200, 330),
    "blh": (10, 5000),
    "precipitation_mm_hourly": (0, 100),
    "precipitation_mm_30min": (0, 50),
}
DIMENSION_WEIGHTS = {"completeness": 0.25, "consistency": 0.20, "accuracy": 0.25, "validity": 0.15, "timeliness": 0.15}
DIMENSION_LIMITS = {
    "completeness": (0.95, 0.8),
    "consistency": (0.9, 0.7),
    "accuracy": (0.85, 0.7),
    "validity": (0.95, 0.8),
    "timeliness": (0.9, 0.7),
}
RELAX_STEPS = (
    [(0.3, 30.0)]
    + [(q, 30.0) for q in (0.25, 0.2, 0.15, 0.1)]
    + [(0.3, m) for m in (35.0, 40.0, 45.0, 50.0)]
    + [(q, m) for q in (0.2, 0.15, 0.1) for m in (40.0, 50.0)]
)
CRITICAL_VARIABLES = ["t2m", "t2m_celsius", "precipitation_mm_hourly"]


# --- completeness and gaps ------------------------------------------------------------------

def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def completeness(df: DataFrame, start: str, end: str) -> DataFrame:
    """Expected, actual and percent of hours per station in a closed interval; a station without rows in it has 0."""
    expected = (F.unix_timestamp(_at(end)) - F.unix_timestamp(_at(start))) / 3600 + 1
    inside = F.count_if(F.col(TIME).between(_at(start), _at(end)))
    return df.groupBy("station_id").agg(inside.alias("actual")).select(
        "station_id", F.floor(expected).alias("expected"), "actual", (F.col("actual") * 100 / F.floor(expected)).alias("percent"))


def gaps(df: DataFrame, start: str, end: str) -> DataFrame:
    """Runs of missing hours per station: start, end, slots and hours (span plus one step).

    Gaps are read off the distance between neighbouring rows with one row before the start and one after
    the end, so the missing hours themselves are never listed.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    inside = df.filter(F.col(TIME).between(_at(start), _at(end))).select("station_id", TIME)
    edges = df.select("station_id").distinct().select(
        "station_id", F.explode(F.array(_at(start) - hour, _at(end) + hour)).alias(TIME))
    w = Window.partitionBy("station_id").orderBy(TIME)
    step = inside.unionByName(edges).withColumn("_prev", F.lag(TIME).over(w))
    slots = (F.unix_timestamp(TIME) - F.unix_timestamp("_prev")) / 3600 - 1
    return step.withColumn("slots", slots.cast("bigint")).filter(F.col("slots") > 0).select(
        "station_id", (F.col("_prev") + hour).alias("gap_start"), (F.col(TIME) - hour).alias("gap_end"), "slots",
        F.col("slots").cast("double").alias("hours"))


def classify_gaps(g: DataFrame, variables: Sequence[str] = ()) -> DataFrame:
    """Length class and impact; a critical variable raises low and medium impact by one level."""
    h = F.col("hours")
    impact = S.ladder(h, [(3, "low"), (12, "medium"), (48, "high")], "critical")
    if set(variables) & set(CRITICAL_VARIABLES):
        impact = S.ladder(h, [(3, "medium"), (48, "high")], "critical")
    return g.withColumns({"gap_class": S.ladder(h, [(6, "short"), (24, "medium"), (72, "long")], "critical"), "impact": impact})


def grade(c: DataFrame, classified: DataFrame) -> DataFrame:
    """A to F per station by percent, lowered for critical gaps or more than two high ones."""
    n = classified.groupBy("station_id").agg(
        F.count_if(F.col("impact") == "critical").alias("n_critical"), F.count_if(F.col("impact") == "high").alias("n_high"))
    j = c.join(n, "station_id", "left").fillna(0, ["n_critical", "n_high"])
    p = F.col("percent")
    base = F.when(p >= 98, "A").when(p >= 95, "B").when(p >= 90, "C").when(p >= 80, "D").otherwise("F")
    hard = F.when(p >= 95, "C").when(p >= 90, "D").otherwise("F")
    soft = F.when(p >= 98, "B").when(p >= 95, "C").when(p >= 90, "D").otherwise("F")
    g = F.when(F.col("n_critical") > 0, hard).when(F.col("n_high") > 2, soft).otherwise(base)
    return j.select("station_id", "percent", "n_critical", "n_high", g.alias("grade"))


def fill_strategy(g: DataFrame) -> DataFrame:
    plan = S.ladder(F.col("hours"), [(3, "linear_interpolation"), (12, "seasonal_interpolation"), (48, "historical_averaging")], "external_data_source")
    return g.select(F.concat(F.lit("gap_"), F.date_format("gap_start", "yyyyMMdd_HHmm")).alias("gap_id"), "station_id", "hours", plan.alias("strategy"))


def diff_gaps(df: DataFrame, hours: float) -> DataFrame:
    """Steps between neighbouring rows longer than a limit."""
    prev = F.lag(TIME).over(Window.partitionBy("station_id").orderBy(TIME))
    length = (F.unix_timestamp(TIME) - F.unix_timestamp("_prev")) / 3600
    return df.select("station_id", TIME, prev.alias("_prev")).select(
        "station_id", F.col("_prev").alias("gap_from"), F.col(TIME).alias("gap_to"), length.alias("hours")).filter(F.col("hours") > hours)


# --- validity -------------------------------------------------------------------------------

def check_schema(df: DataFrame, expected: dict[str, T.DataType]) -> DataFrame:
    """Status of each expected and each extra column, with the number of values it holds (one aggregate)."""
    kinds = {T.LongType: "int", T.IntegerType: "int", T.DoubleType: "float", T.FloatType: "float", T.StringType: "text",
             T.TimestampType: "time", T.TimestampNTZType: "time"}
    have = {f.name: kinds.get(type(f.dataType), f.dataType.simpleString()) for f in df.schema.fields}

    def row(name: str, want: str | None, got: str | None, status: str) -> Column:
        values = F.count(name) if got is not None else F.lit(0)
        return F.struct(F.lit(name).alias("column"), F.lit(want).alias("expected"), F.lit(got).alias("found"), F.lit(status).alias("status"), values.alias("n_values"))

    rows = []
    for name, t in expected.items():
        want, got = kinds.get(type(t), t.simpleString()), have.get(name)
        rows.append(row(name, want, got, "missing" if got is None else "ok" if got == want else "wrong type"))
    rows += [row(n, None, k, "extra") for n, k in have.items() if n not in expected]
    one = df.agg(*[r.alias(f"_{i}") for i, r in enumerate(rows)])
    return one.select(F.explode(F.array(*[f"_{i}" for i in range(len(rows))])).alias("r")).select("r.*")


def record_quality(raw: DataFrame, low: float = 0, high: float = 1000, keys: Sequence[str] = ()) -> DataFrame:
    """One row of record counts, or one for each value of ``keys``, columns that follow from station and time: null cells
    of the critical columns, duplicates, out of range, valid.

    Rows of one key are first counted per key, so duplicates need no ordering inside a hot key: a key with
    n rows has n - 1 duplicates, and the first row by event_id is the one kept.
    """
    crit = ["station_id", "value", TIME, "parameter"]
    nulls = F.lit(0)
    for c in crit:
        nulls = nulls + F.col(c).isNull().cast("int")
    out = F.coalesce((F.col("parameter") == "pm25") & ((F.col("value") < low) | (F.col("value") > high)), F.lit(False))
    good = (nulls == 0) & ~out
    per = raw.groupBy("station_id", TIME, "parameter", *[k for k in keys if k != "station_id"]).agg(
        F.count("*").alias("n"), F.sum(nulls).alias("nulls"), F.count_if(out).alias("outliers"), F.min_by(good, "event_id").alias("first_good"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("nulls").alias("missing"), F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("outliers").alias("outliers"), F.count_if("first_good").alias("valid"))


def quality_score(m: DataFrame) -> DataFrame:
    """0.4 completeness + 0.3 present + 0.2 unique + 0.1 in range, limited to 0..1."""
    n = F.col("total")
    s = F.col("valid") / n * 0.4 + (1 - F.col("missing") / n) * 0.3 + (1 - F.col("duplicates") / n) * 0.2 + (1 - F.col("outliers") / n) * 0.1
    return m.withColumn("score", F.coalesce(S.clip(s, 0.0, 1.0), F.lit(0.0)))


def temporal_consistency(df: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Share of steps of exactly one hour per key."""
    step = F.unix_timestamp(TIME) - F.unix_timestamp(F.lag(TIME).over(Window.partitionBy(*keys).orderBy(TIME)))
    d = df.select(*keys, step.alias("_s"))
    return d.groupBy(*keys).agg(F.coalesce(F.avg((F.col("_s") == 3600).cast("int")), F.lit(0.0)).alias("temporal"), F.count_if(F.col("_s") > 3600).alias("gaps"))


def hourly_steps(df: DataFrame) -> DataFrame:
    """The same share for one unkeyed hourly series, without ordering the whole table: hours that have the hour before."""
    prev = df.select((F.col(TIME) + F.expr("INTERVAL 1 HOUR")).alias(TIME), F.lit(1).alias("_has"))
    j = df.select(TIME).join(prev, TIME, "left")
    return j.agg(F.count("*").alias("n"), F.count("_has").alias("ok")).select(
        F.when(F.col("n") > 1, F.col("ok") / (F.col("n") - 1)).otherwise(0.0).alias("temporal"), (F.col("n") - 1 - F.col("ok")).alias("gaps"))


def physical_bounds(df: DataFrame) -> DataFrame:
    """Share of non-null values inside the fixed bounds, over all known variables of the table."""
    known = [(c, VARIABLE_BOUNDS[c]) for c in df.columns if c in VARIABLE_BOUNDS]
    ok, n = F.lit(0), F.lit(0)
    for c, (lo, hi) in known:
        ok, n = ok + F.count_if(F.col(c).between(lo, hi)), n + F.count(c)
    return df.agg(ok.alias("_ok"), n.alias("_n")).select(F.when(F.col("_n") > 0, F.col("_ok") / F.col("_n")).otherwise(1.0).alias("physical"))


def wind_consistency_check(df: DataFrame) -> DataFrame:
    ok = F.abs(S.wind_speed(F.col("u10"), F.col("v10")) - F.col("wind_speed")) <= F.abs("wind_speed") * 0.01
    return df.agg(F.avg(ok.cast("int")).alias("spatial"))


def rain_physics(rain: DataFrame, col: str = "precipitation_mm_hourly") -> DataFrame:
    lo, hi = VARIABLE_BOUNDS[col]
    inside, light = F.avg(F.col(col).between(lo, hi).cast("int")), F.avg((F.col(col) <= 5).cast("int"))
    return rain.agg(F.when(light >= 0.8, inside).otherwise(inside * 0.8).alias("physical"))


def iqr_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values outside 1.5 quartile distances per variable (0 with fewer than four values)."""
    from hazewell.operators.quantiles import quantile_columns

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])).alias("v")).select("v.*")
    long = long.filter(F.col("x").isNotNull())
    q = quantile_columns(long, "x", {"a": 0.25, "b": 0.75}, ["variable"])
    iqr = F.col("b") - F.col("a")
    out = (F.col("x") < F.col("a") - 1.5 * iqr) | (F.col("x") > F.col("b") + 1.5 * iqr)
    return long.join(q, "variable").groupBy("variable").agg(
        F.when(F.count("*") >= 4, F.count_if(out)).otherwise(0).alias("outliers"), F.count("*").alias("n"))


def met_quality(weather: DataFrame) -> DataFrame:
    """One row: the three scores of the weather series and their mean."""
    parts = with_scalar(with_scalar(hourly_steps(weather), physical_bounds(weather)), wind_consistency_check(weather))
    return parts.withColumn("overall", (F.col("temporal") + F.col("physical") + F.col("spatial")) / 3)


# --- alerts ---------------------------------------------------------------------------------

def data_alerts(raw: DataFrame, as_of: str, previous: DataFrame | None = None, stations: DataFrame | None = None) -> DataFrame:
    """Fired rules per station: no data, stale, missing values, outliers, score drop, low volume.

    ``previous`` holds (station_id, previous_score, current_score); ``stations`` lists the stations expected.
    """
    v = F.col("value")
    agg = raw.groupBy("station_id").agg(
        F.count("*").alias("n"), F.max(TIME).alias("latest"), F.avg(v.isNull().cast("int")).alias("null_share"),
        (F.count_if((v < 0) | (v > 500)) / F.greatest(F.count(v), F.lit(1))).alias("outlier_share"))
    if stations is not None:
        agg = stations.select("station_id").distinct().join(agg, "station_id", "left")
    drop = F.lit(None).cast("double")
    if previous is not None:
        agg = agg.join(previous, "station_id", "left")
        drop = F.col("previous_score") - F.col("current_score")
    hours = (F.unix_timestamp(_at(as_of)) - F.unix_timestamp("latest")) / 3600

    def rule(name: str, category: str, cond: Column, severity: Column, value: Column) -> Column:
        fired = F.struct(F.lit(name).alias("rule"), F.lit(category).alias("category"), severity.alias("severity"), value.cast("double").alias("value"))
        return F.when(cond, fired)

    graded = lambda x, top: F.when(x < top, "medium").otherwise("high")
    n = F.col("n")
    rules = [
        rule("no_data", "missing_data", n.isNull(), F.lit("high"), F.lit(0)),
        rule("stale", "freshness", hours > 2, graded(hours, 24), hours),
        rule("missing_values", "missing_data", F.col("null_share") > 0.2, graded(F.col("null_share"), 0.5), F.col("null_share")),
        rule("outliers", "outliers", F.col("outlier_share") > 0.05, F.lit("medium"), F.col("outlier_share")),
        rule("score_drop", "poor_quality", drop > 0.2, F.lit("medium"), drop),
        rule("low_volume", "missing_data", n < 20, F.lit("low"), n),
    ]
    return agg.select("station_id", F.explode(F.array_compact(F.array(*rules))).alias("a")).select("station_id", "a.*")


def active_alerts(alerts: DataFrame, as_of: str, days: int, station_id: int | None = None, severity: str | None = None) -> DataFrame:
    out = alerts.filter(~F.col("resolved") & (F.col("ts") >= _at(as_of) - F.expr(f"INTERVAL {days} DAYS")))
    if station_id is not None:
        out = out.filter(F.col("station_id") == station_id)
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    return out.orderBy(F.desc("ts"), "alert_id")


def quality_dimensions(df: DataFrame, as_of: str, numeric: Sequence[str] = ("pm25", "temperature")) -> DataFrame:
    """Five scores per station with status.  The input follows the hourly contract, so quartiles per station are small."""
    cols = df.columns
    nulls = F.lit(0)
    for c in cols:
        nulls = nulls + F.col(c).isNull().cast("int")
    counted = df.groupBy(*cols).agg(F.count("*").alias("_c"))
    dup = counted.groupBy("station_id").agg(F.sum(F.col("_c") - 1).alias("dup"))
    q = df.groupBy("station_id").agg(*[e for c in numeric for e in (F.percentile(c, 0.25).alias(f"a_{c}"), F.percentile(c, 0.75).alias(f"b_{c}"))])
    odd = F.lit(0)
    for c in numeric:
        iqr = F.col(f"b_{c}") - F.col(f"a_{c}")
        odd = odd + S.flag((F.col(c) < F.col(f"a_{c}") - 1.5 * iqr) | (F.col(c) > F.col(f"b_{c}") + 1.5 * iqr))
    odd = odd + S.flag((F.col("pm25") < 0) | (F.col("pm25") > 1000)) + S.flag((F.col("temperature") < -50) | (F.col("temperature") > 60))
    age = (F.unix_timestamp(_at(as_of)) - F.unix_timestamp(TIME)) / 3600
    agg = df.join(q, "station_id").groupBy("station_id").agg(
        F.count("*").alias("n"), F.sum(nulls).alias("nulls"), F.sum(odd).alias("odd"), F.count_if(F.col("pm25") < 0).alias("neg"),
        F.avg((age <= 24).cast("int")).alias("fresh"), S.corr("pm25", "temperature").alias("r")).join(dup, "station_id")
    n = F.col("n")
    against = S.flag(F.col("r") < -0.8)
    scores = {
        "completeness": 1 - F.col("nulls") / (n * len(cols)),
        "consistency": 1 - (F.col("dup") + against) / (n + 1),
        "accuracy": 1 - F.col("odd") / (n * (2 + len(numeric))),
        "validity": 1 - F.col("neg") / (n + 2),
        "timeliness": F.col("fresh"),
    }
    parts = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), F.lit(DIMENSION_LIMITS[k][0]).alias("good"), F.lit(DIMENSION_LIMITS[k][1]).alias("warn"))
             for k, v in scores.items()]
    status = F.when(F.col("value") >= F.col("good"), "good").when(F.col("value") >= F.col("warn"), "warning").otherwise("critical")
    return agg.select("station_id", F.explode(F.array(*parts)).alias("m")).select("station_id", "m.*").select("station_id", "metric", "value", status.alias("status"))


def overall_quality(dims: DataFrame) -> DataFrame:
    weight = F.lit(0.1)
    for k, v in DIMENSION_WEIGHTS.items():
        weight = F.when(F.col("metric") == k, v).otherwise(weight)
    g = dims.groupBy("station_id").agg(
        (F.sum(F.col("value") * weight) / F.sum(weight)).alias("overall"), F.count_if(F.col("status") == "critical").alias("c"),
        F.count_if(F.col("status") == "warning").alias("w"))
    s = F.col("overall")
    status = F.when(F.col("c") > 0, "critical").when((F.col("w") > 0) & (s < 0.8), "warning").when(s >= 0.9, "good").when(s >= 0.7, "warning").otherwise("critical")
    return g.select("station_id", "overall", status.alias("status"))


def quality_advice(dims: DataFrame, overall: DataFrame) -> DataFrame:
    """A code (metric and status) for each metric that is not good, and one for the whole of each station; texts are the reader's matter."""
    per = dims.filter(F.col("status") != "good").select("station_id", "metric", F.concat_ws("-", "metric", "status").alias("advice"))
    o = F.col("overall")
    whole = F.when(o < 0.7, "overall-low").when(o < 0.9, "overall-fair").otherwise("overall-high")
    return per.unionByName(overall.select("station_id", F.lit("overall").alias("metric"), whole.alias("advice")))


# --- files, sensors, acceptance -------------------------------------------------------------

def file_quality(df: DataFrame, file: str, key: Sequence[str], value: str = "pm25") -> DataFrame:
    """Per file: null and duplicate share, span, gaps over two hours, negatives, outliers, and the 0.4/0.3/0.3 score."""
    cells = [c for c in df.columns if c != file]
    nulls = F.lit(0)
    for c in cells:
        nulls = nulls + F.col(c).isNull().cast("int")
    dup = df.groupBy(file, *cells).agg(F.count("*").alias("_c")).groupBy(file).agg(F.sum(F.col("_c") - 1).alias("dup"))
    from hazewell.operators.quantiles import quantile_columns

    q = quantile_columns(df, value, {"a": 0.25, "b": 0.75}, [file])
    iqr = F.col("b") - F.col("a")
    out = (F.col(value) < F.col("a") - 1.5 * iqr) | (F.col(value) > F.col("b") + 1.5 * iqr)
    base = df.join(q, file, "left").groupBy(file).agg(
        F.count("*").alias("n_rows"), (F.sum(nulls) * 100 / (F.count("*") * len(cells))).alias("null_pct"),
        F.datediff(F.max(TIME), F.min(TIME)).alias("span_days"), F.count_if(F.col(value) < 0).alias("negatives"),
        F.coalesce(F.when(F.max(iqr) > 0, F.count_if(out) * 100 / F.count(value)), F.lit(0.0)).alias("outlier_pct"))
    # gaps between distinct hours of a file: hours are de-duplicated first, so a file adds one row per hour
    hours = df.select(file, TIME).distinct()
    prev = F.lag(TIME).over(Window.partitionBy(file).orderBy(TIME))
    gap = hours.select(file, (F.unix_timestamp(TIME) - F.unix_timestamp(prev)).alias("_g")).groupBy(file).agg(F.count_if(F.col("_g") > 7200).alias("gaps"))
    m = base.join(dup, file).join(gap, file).withColumn("dup_pct", F.col("dup") * 100 / F.col("n_rows"))
    complete = F.greatest(F.lit(0.0), 1 - F.col("null_pct") / 100)
    consistent = F.greatest(F.lit(0.0), 1 - F.col("dup_pct") / 100 - F.least(F.lit(1.0), F.col("outlier_pct") / 20))
    span = F.least(F.lit(1.0), F.col("span_days") / 30) - F.least(F.lit(1.0), F.col("gaps") / 100)
    temporal = F.when(F.col("span_days") > 0, F.greatest(F.lit(0.0), span)).otherwise(0.0)
    return m.select(file, "n_rows", "null_pct", "dup_pct", "span_days", "gaps", "negatives", "outlier_pct",
                    (complete * 0.4 + consistent * 0.3 + temporal * 0.3).alias("score"))


def file_advice(q: DataFrame) -> DataFrame:
    """Number of files over each limit, with the advice for it."""
    rules = [
        ("completeness", F.col("null_pct") > 20), ("duplicates", F.col("dup_pct") > 10), ("gaps", F.col("gaps") > 50),
        ("negatives", F.col("negatives") > 0), ("low_score", F.col("score") < 0.6),
    ]
    counts = q.agg(*[F.count_if(cond).alias(name) for name, cond in rules])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("files")) for n, _ in rules])).alias("r")).select("r.*")
    return long.filter(F.col("files") > 0)


def sensor_coverage(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Expected and present hours of every sensor of the table; one without a value in the span misses all."""
    total = F.floor((F.unix_timestamp(_at(end)) - F.unix_timestamp(_at(start))) / 3600)
    inside = (F.col(TIME) >= _at(start)) & (F.col(TIME) < _at(end))
    missing = F.greatest(F.lit(0), total - F.col("actual"))
    return raw.groupBy("sensor_id").agg(F.count(F.when(inside, F.col("value"))).alias("actual")).select(
        "sensor_id", total.alias("expected"), "actual", (missing * 100 / total).alias("missing_pct"), (1 - missing / total).alias("score"))


def day_check(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Per day: distinct hours, variables with no value, and whether the day is whole."""
    day = df.groupBy(F.date_trunc("day", TIME).alias("day")).agg(
        F.count_distinct(F.hour(TIME)).alias("hours"), *[F.count(v).alias(f"_n_{v}") for v in variables])
    lost = F.concat_ws(",", *[F.when(F.col(f"_n_{v}") == 0, F.lit(v)) for v in variables])
    return day.select("day", "hours", lost.alias("missing"), (F.col("hours") == 24).alias("ok_hours"), ((F.col("hours") == 24) & (lost == "")).alias("ok"))


def acceptance(stations: DataFrame, days: DataFrame, rain_days: DataFrame, lat: float, lon: float, km: float = 25.0, min_stations: int = 3,
               min_days: int = 480, max_missing: float = 30.0, min_quality: float = 0.7, rain_needed: bool = False, min_rain_pct: float = 80.0) -> DataFrame:
    """One row of pass/fail: enough good stations near the point, whole weather days, rain availability.

    ``rain_days`` holds one row per day checked with a boolean ``ok``.
    """
    good = (F.col("data_span_days") >= min_days) & (F.col("missingness_pct") <= max_missing) & (F.col("quality_score") >= min_quality)
    st = J.within_radius(stations, lat, lon, km).agg(F.count("*").alias("stations_found"), F.count_if(good).alias("stations_qualified"))
    w = days.agg(F.count("*").alias("_n"), F.count_if("ok_hours").alias("_h"), F.count_if("ok").alias("_ok"), F.count_if(F.col("missing") == "").alias("_full"))
    r = rain_days.agg((F.count_if("ok") * 100 / F.count("*")).alias("rain_pct"))
    met = (F.col("_full") > 0) & (F.col("_h") >= F.floor(F.col("_n") / 2)) & (F.col("_ok") >= F.col("_n") * 0.5)
    rain = F.lit(True) if not rain_needed else F.col("rain_pct") >= min_rain_pct
    all_ = with_scalar(with_scalar(st, w), r)
    stations_ok = F.col("stations_qualified") >= min_stations
    return all_.select("stations_found", "stations_qualified", stations_ok.alias("stations_ok"), met.alias("weather_ok"), "rain_pct", rain.alias("rain_ok"),
                       (stations_ok & met & rain).alias("accepted"))


def update_quality(df: DataFrame) -> DataFrame:
    """0.3 present cells + 0.4 completeness over the span + 0.3 present targets, per station."""
    nulls = F.lit(0)
    for c in df.columns:
        nulls = nulls + F.col(c).isNull().cast("int")
    hours = (F.unix_timestamp(F.max(TIME)) - F.unix_timestamp(F.min(TIME))) / 3600
    agg = df.groupBy("station_id").agg(
        (F.sum(nulls) / (F.count("*") * len(df.columns))).alias("m"), (F.count("*") / F.greatest(hours, F.lit(1.0))).alias("c"),
        (F.count("pm25") / F.count("*")).alias("t"))
    s = (1 - F.col("m")) * 0.3 + F.least(F.col("c"), F.lit(1.0)) * 0.4 + F.col("t") * 0.3
    return agg.select("station_id", S.clip(s, 0.0, 1.0).alias("score"))


def join_quality(joined: DataFrame, matched: str, cols: Sequence[str]) -> DataFrame:
    """Matched share times one minus the mean null share of the joined columns."""
    null_share = sum([F.avg(F.col(c).isNull().cast("int")) for c in cols], F.lit(0.0)) / len(cols)
    return joined.agg(F.avg(F.col(matched).isNotNull().cast("int")).alias("matched"), null_share.alias("null_share")).withColumn(
        "quality", S.clip(F.col("matched") * (1 - F.col("null_share")), 0.0, 1.0))


# --- stations -------------------------------------------------------------------------------

def nearest_neighbour(stations: DataFrame) -> DataFrame:
    """Distance to the nearest other station, found in a tree of cells that are split where stations are dense."""
    return celltree.nearest(stations)


def network_audit(stations: DataFrame, as_of: str, lat: float, lon: float, radius_km: float = 25.0) -> DataFrame:
    """Named checks of a station network with status and value."""
    now = F.unix_timestamp(_at(as_of))
    age_days = (now - F.unix_timestamp("last_measurement")) / 86400
    km = S.haversine(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    m = stations.agg(
        F.count("*").alias("n"), F.avg("quality_score").alias("q"), (F.max("quality_score") - F.min("quality_score")).alias("qr"),
        ((F.max("latitude") - F.min("latitude")) * (F.max("longitude") - F.min("longitude")) / radius_km**2 * 100).alias("eff"),
        F.max(km).alias("far"), F.count_if(age_days < 7).alias("recent"), F.avg(F.coalesce("data_span_days", F.lit(0))).alias("span"),
        F.count_if(age_days * 24 > 6).alias("stale"))
    nn = nearest_neighbour(stations).agg(F.avg("km").alias("nn"), F.count_if(F.col("km") < 0.5).alias("close"))
    c = F.col

    def check(name: str, fail: Column, warn: Column, value: str) -> Column:
        status = F.when(fail, "fail").when(warn, "warning").otherwise("pass")
        return F.struct(F.lit(name).alias("check"), status.alias("status"), c(value).cast("double").alias("value"))

    never = F.lit(False)
    rows = [
        check("quality_distribution", c("n") == 0, (c("qr") < 0.1) | (c("q") < 0.4), "q"),
        check("geographic_coverage", c("n") < 3, (c("far") < radius_km * 0.2) | (c("eff") < 20), "eff"),
        check("temporal_coverage", c("recent") == 0, (c("recent") < c("n") * 0.7) | (c("span") < 60), "recent"),
        check("data_freshness", c("stale") == c("n"), c("stale") > 0, "stale"),
        check("station_clustering", never, (c("close") > c("n") * 0.5) | (c("nn") < 1), "nn"),
    ]
    return with_scalar(m, nn).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def health_score(audit: DataFrame) -> DataFrame:
    s = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warning", 0.7).otherwise(0.0)
    return audit.agg(F.avg(s).alias("health"))


def diversity(chosen: DataFrame) -> DataFrame:
    """Spatial diversity of each chosen station set (``set_id``), of any size.

    The mean distance of all members is part of the score and has no shorter form, so the cost is the square of a set's
    size; sets are meant to be short lists picked for a network.
    """
    member = F.struct("station_id", "latitude", "longitude")
    sized = chosen.groupBy("set_id").agg(F.count("*").alias("n"), F.avg("latitude").alias("clat"), F.avg("longitude").alias("clon"))
    cent = chosen.join(sized, "set_id").select("set_id", S.haversine(F.col("latitude"), F.col("longitude"), F.col("clat"), F.col("clon")).alias("d"))
    spread = cent.groupBy("set_id").agg(F.var_pop("d").alias("spread"))
    a = chosen.join(sized.select("set_id"), "set_id").select("set_id", member.alias("a"))
    b = chosen.select("set_id", member.alias("b"))
    km = S.haversine(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    d = a.join(b, "set_id").filter(F.col("a.station_id") < F.col("b.station_id")).select("set_id", km.alias("km")).groupBy("set_id").agg(
        F.min("km").alias("lo"), F.avg("km").alias("mid"), F.max("km").alias("hi"))

    def part(x: str, top: float) -> Column:
        return F.least(F.col(x) / top, F.lit(1.0))

    score = part("lo", 1.0) * 0.3 + part("mid", 3.0) * 0.3 + part("hi", 10.0) * 0.2 + part("spread", 2.0) * 0.2
    full = sized.join(spread, "set_id").join(d, "set_id", "left")
    return full.select("set_id", "n", F.when(F.col("n") < 2, 1.0).otherwise(F.least(F.when(F.col("lo") < 0.5, score * 0.3).otherwise(score), F.lit(1.0))).alias("diversity"))


def relax_thresholds(stations: DataFrame, required: int = 3) -> DataFrame:
    """First step of the ladder with enough stations, or the first step where none has: one aggregate with a count per step."""
    counts = stations.agg(*[
        F.count_if((F.col("quality_score") >= q) & (F.col("missingness_pct") <= m)).alias(f"s{i}") for i, (q, m) in enumerate(RELAX_STEPS)])
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(q).alias("min_quality"), F.lit(m).alias("max_missing"), F.col(f"s{i}").alias("stations"))
                      for i, (q, m) in enumerate(RELAX_STEPS)])
    enough = F.filter(steps, lambda s: s["stations"] >= required)
    return counts.select(F.coalesce(F.get(enough, F.lit(0)), F.get(steps, F.lit(0))).alias("b")).select("b.*")


def feature_report(df: DataFrame) -> DataFrame:
    """Rows and nulls of every column in one pass, as (column, n_rows, nulls)."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def station_score(stations: DataFrame, as_of: str) -> DataFrame:
    """Score from count and span, local form, and the mix with recency (30-day decay)."""
    n, d = F.col("n_readings"), F.coalesce("data_span_days", F.lit(0))
    one = F.lit(1.0)
    base = F.least(n / 1000, one) * F.least(d / 365, one)
    local = F.when((n >= 1000) & (d >= 60), F.least(n / 1500 * 0.8 + d / 180 * 0.2, one)).otherwise(0.5)
    days = F.floor((F.unix_timestamp(_at(as_of)) - F.unix_timestamp("last_measurement")) / 86400)
    recency = F.greatest(F.lit(0.0), 1 - days / 30)
    return stations.select("station_id", base.alias("score"), local.alias("local_score"), F.coalesce(base * 0.7 + recency * 0.3, base).alias("recent_score"))


def ready(df: DataFrame, split: str) -> DataFrame:
    """Named readiness checks over the whole table."""
    train = F.col(TIME) < _at(split)
    days = F.floor((F.unix_timestamp(F.max(TIME)) - F.unix_timestamp(F.min(TIME))) / 86400)
    m = df.agg(F.count_if(train).alias("train"), F.count_if(~train).alias("test"), F.count_distinct("station_id").alias("stations"),
               F.avg(F.col("pm25").isNull().cast("int")).alias("missing"), days.alias("days"),
               (F.count("*") / (F.count_distinct("station_id") * (F.unix_timestamp(F.max(TIME)) - F.unix_timestamp(F.min(TIME))) / 3600)).alias("coverage"))
    tests = [("train_rows", F.col("train") >= 1000, "train"), ("test_rows", F.col("test") >= 100, "test"), ("stations", F.col("stations") >= 2, "stations"),
             ("missing_share", F.col("missing") < 0.1, "missing"), ("days", F.col("days") >= 30, "days"), ("coverage", F.col("coverage") > 0, "coverage")]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), F.col(v).cast("double").alias("value")) for n, ok, v in tests])
    return m.select(F.explode(rows).alias("r")).select("r.*")
