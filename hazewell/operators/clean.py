"""Filters, de-duplication, filling, splitting and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazewell.operators import windows as W
from hazewell.operators.quantiles import exact_quantiles, quantile_columns
from hazewell.operators.scalars_on import with_scalar


def drop_incomplete(df: DataFrame, cols: Sequence[str] = ("value", "datetime_utc")) -> DataFrame:
    return df.dropna(subset=list(cols))


def valid_range(df: DataFrame, col: str = "pm25", low: float = 0.0, high: float = 1000.0) -> DataFrame:
    return df.filter(F.col(col).between(low, high))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order.

    ``min_by`` combines before the shuffle, so a key repeated a billion times costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*").select(*df.columns)


def dedupe_priority(df: DataFrame, keys: Sequence[str], source: str, priority: Sequence[str], order: Sequence[str]) -> DataFrame:
    """De-duplicate by key; sources earlier in the list win."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    return dedupe(df.withColumn("_rank", rank), keys, ["_rank", *order]).drop("_rank")


def recent_only(df: DataFrame, now: str, hours: int) -> DataFrame:
    return df.filter(F.col("datetime_utc") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def iqr_filter(df: DataFrame, col: str = "pm25", k: float = 3.0) -> DataFrame:
    """Rows inside the quartiles of the whole table, widened by k times their distance."""
    q = quantile_columns(df, col, {"_q1": 0.25, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    inside = F.col(col).between(F.col("_q1") - k * iqr, F.col("_q3") + k * iqr)
    return with_scalar(df, q).filter(inside).select(*df.columns)


def outlier_flags(df: DataFrame, method: str, col: str = "pm25") -> DataFrame:
    """Outlier flag per station: ``iqr`` (1.5) or ``zscore`` (3)."""
    x = F.col(col)
    if method == "iqr":
        s = df.groupBy("station_id").agg(F.percentile(x, 0.25).alias("a"), F.percentile(x, 0.75).alias("b"))
        iqr = F.col("b") - F.col("a")
        out = (x < F.col("a") - 1.5 * iqr) | (x > F.col("b") + 1.5 * iqr)
    elif method == "zscore":
        s = df.groupBy("station_id").agg(F.avg(x).alias("a"), F.stddev_samp(x).alias("b"))
        out = F.abs((x - F.col("a")) / F.col("b")) > 3
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return df.join(s, "station_id").select(*df.columns, F.coalesce(out, F.lit(False)).alias("outlier"))


def fill(df: DataFrame, method: str, col: str = "pm25") -> DataFrame:
    """Fill nulls ``forward``, ``backward`` or by the station ``mean``; what stays null takes the mean."""
    w = W.ordered()
    mean = F.avg(col).over(Window.partitionBy("station_id"))
    filled = {
        "forward": F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "backward": F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "mean": F.col(col),
    }[method]
    return df.withColumn(f"{col}_filled", F.coalesce(filled, mean))


def ffill_limit(df: DataFrame, n: int, col: str = "pm25") -> DataFrame:
    return df.withColumn(f"{col}_filled", F.last(col, ignorenulls=True).over(W.ordered().rowsBetween(-n, 0)))


def interpolate_limit(df: DataFrame, n: int, cols: Sequence[str], keys=("station_id",)) -> DataFrame:
    """Linear by row position; at most n rows after a value are filled, trailing nulls repeat it, leading nulls stay."""
    w = W.ordered(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(w))
    out = {}
    for c in cols:
        here = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        prev, nxt = F.last(here, ignorenulls=True).over(back), F.first(here, ignorenulls=True).over(ahead)
        dist = F.col("_i") - prev["i"]
        line = prev["v"] + (nxt["v"] - prev["v"]) * dist / (nxt["i"] - prev["i"])
        out[f"{c}_filled"] = F.coalesce(F.col(c), F.when(dist <= n, F.coalesce(line, prev["v"])))
    return df.withColumns(out).drop("_i")


def finalize(df: DataFrame, floats: Sequence[str], strings: Sequence[str]) -> DataFrame:
    """Fill what is still missing: median of a float column, most frequent text (smallest on a tie)."""
    out = df
    for c in floats:
        out = with_scalar(out, quantile_columns(df, c, {f"_m_{c}": 0.5}))
    for c in strings:
        n = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        out = with_scalar(out, n.agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(f"_m_{c}")))
    return out.select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in (*floats, *strings) else F.col(c) for c in df.columns])


def split_by_date(df: DataFrame, first: str, second: str) -> DataFrame:
    t = F.col("datetime_utc")
    part = F.when(t < F.lit(first).cast("timestamp"), "train").when(t < F.lit(second).cast("timestamp"), "validation")
    return df.withColumn("part", part.otherwise("test"))


def split_by_share(df: DataFrame, shares: Sequence[float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Chronological split by row share over the whole table."""
    placed = W.ordered_position(df.withColumn("_t", F.unix_timestamp("datetime_utc")), "_t", ["station_id"], name="_p")
    counted = with_scalar(placed, df.agg(F.count("*").alias("_n")))
    a, b = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * (shares[0] + shares[1]))
    part = F.when(F.col("_p") < a, "train").when(F.col("_p") < b, "validation").otherwise("test")
    return counted.select(*df.columns, part.alias("part"))


def match_moments(a: DataFrame, b: DataFrame, col: str = "pm25") -> DataFrame:
    """Rescale a to the per-station mean and deviation of b; stations without b or without spread stay as they are."""
    def moments(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("station_id").agg(F.avg(col).alias(f"_m{tag}"), F.stddev_samp(col).alias(f"_s{tag}"))

    z = (F.col(col) - F.col("_ma")) / F.col("_sa") * F.col("_sb") + F.col("_mb")
    joined = a.join(moments(a, "a"), "station_id").join(moments(b, "b"), "station_id", "left")
    return joined.withColumn("matched", F.coalesce(F.when(F.col("_sa") > 0, z), F.col(col))).select(*a.columns, "matched")


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """One row with the centre and scale of every column."""
    if kind == "standard":
        return df.agg(*[f(c).alias(n) for c in cols for f, n in ((F.avg, f"c_{c}"), (F.stddev_pop, f"s_{c}"))])
    if kind == "minmax":
        return df.agg(*[e for c in cols for e in (F.min(c).alias(f"c_{c}"), (F.max(c) - F.min(c)).alias(f"s_{c}"))])
    if kind == "robust":
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
        q = exact_quantiles(df.select(F.explode(cells).alias("c")).select("c.*"), "x", [0.25, 0.5, 0.75], ["feature"])
        at = lambda c, p: F.max(F.when((F.col("feature") == c) & (F.col("prob") == p), F.col("quantile")))
        return q.agg(*[e for c in cols for e in (at(c, 0.5).alias(f"c_{c}"), (at(c, 0.75) - at(c, 0.25)).alias(f"s_{c}"))])
    raise ValueError(f"unknown scaler {kind!r}")


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - centre) / scale; a scale of 0 divides by 1."""
    def scaled(c: str) -> Column:
        return (F.col(c) - F.col(f"c_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))

    return with_scalar(df, scaler).select(*df.columns, *[scaled(c).alias(f"{c}_scaled") for c in cols])


def recent_days(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last N days of each station."""
    last = df.groupBy("station_id").agg(F.max("datetime_utc").alias("_last"))
    return df.join(last, "station_id").filter(F.col("datetime_utc") >= F.col("_last") - F.expr(f"INTERVAL {days} DAYS")).select(*df.columns)
