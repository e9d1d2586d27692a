"""Row-frame features per station, rankings and top-k.

Size of a window group.  Tables here follow the hourly contract: one row per station and hour
(the sources aggregate or de-duplicate to it before any window), so a station adds at most
8,784 rows a year and one group stays small however many raw rows a station sends.  For
finer-grained tables ``in_segments`` splits a station into ordered segments of bounded length,
each with a copy of the neighbouring rows its frames reach into.
Whole-table orders never use a window without a key: see ``global_position``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.functions import scalars as S
from hazewell.operators.scalars_on import with_scalar
from hazewell.session import stored

KEYS = ("station_id",)
TIME = "datetime_utc"
SEGMENT_ROWS = 1_000_000
ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def ordered(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(TIME)


def trailing(rows: int, keys: Sequence[str] = KEYS) -> WindowSpec:
    return ordered(keys).rowsBetween(-(rows - 1), 0)


def enough(x: Column, frame: WindowSpec, least: int, value: Column) -> Column:
    """``value`` where the frame holds at least ``least`` non-null x."""
    return F.when(F.count(x).over(frame) >= least, value)


# --- lags, differences, rolling -------------------------------------------------------------

def lags(df: DataFrame, col: str, hours: Sequence[int], name: str | None = None, keys=KEYS) -> DataFrame:
    """Row lags: the value n rows back, whatever its time."""
    w = ordered(keys)
    return df.withColumns({f"{name or 'lag_' + col}_{h}": F.lag(col, h).over(w) for h in hours})


def time_lags(df: DataFrame, col: str, hours: Sequence[int], keys=KEYS) -> DataFrame:
    """Value exactly h hours back (null where that hour is missing), by a range frame."""
    sec = F.unix_timestamp(TIME)
    w = Window.partitionBy(*keys).orderBy(sec)
    return df.withColumns({f"tlag_{col}_{h}": F.max(col).over(w.rangeBetween(-h * 3600, -h * 3600)) for h in hours})


def diffs(df: DataFrame, col: str, steps: Sequence[int], name: str, per_hour: bool = False, keys=KEYS) -> DataFrame:
    w = ordered(keys)
    return df.withColumns(
        {f"{name}_{n}": (F.col(col) - F.lag(col, n).over(w)) / (n if per_hour else 1) for n in steps}
    )


def rolling(df: DataFrame, cols: Sequence[str], rows: Sequence[int], stats=tuple(ROLLING), least: Callable[[int], int] | None = None, keys=KEYS) -> DataFrame:
    """Trailing statistics, null until max(1, rows // 2) values were seen."""
    least = least or (lambda n: max(1, n // 2))
    out = {}
    for col in cols:
        for n in rows:
            frame = trailing(n, keys)
            for s in stats:
                out[f"{s}_{n}_{col}"] = enough(F.col(col), frame, least(n), ROLLING[s](col).over(frame))
    return df.withColumns(out)


def rolling_slope(df: DataFrame, col: str, rows: Sequence[int], keys=KEYS) -> DataFrame:
    """Least-squares slope over the non-null values of the frame, x counting those values."""
    seen = F.count(col).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_n", seen.cast("double"))
    out = {}
    for n in rows:
        frame = trailing(n, keys)
        out[f"slope_{n}"] = enough(F.col(col), frame, max(2, n // 2), F.regr_slope(F.col(col), F.col("_n")).over(frame))
    return df.withColumns(out).drop("_n")


def wind_consistency(df: DataFrame, col: str, rows: Sequence[int], keys=KEYS) -> DataFrame:
    """Length of the mean unit vector of the directions in the frame."""
    rad = F.radians(col)
    out = {}
    for n in rows:
        f = trailing(n, keys)
        length = F.sqrt(F.pow(F.avg(F.sin(rad)).over(f), 2) + F.pow(F.avg(F.cos(rad)).over(f), 2))
        out[f"consistency_{n}"] = enough(F.col(col), f, max(1, n // 2), length)
    return df.withColumns(out)


def sector_mode(df: DataFrame, col: str, rows: int = 24, least: int = 12, sectors: int = 16, keys=KEYS) -> DataFrame:
    """Most frequent sector of the frame, smallest on a tie: one running count per sector, no per-row list."""
    f = trailing(rows, keys)
    coded = [F.count_if(F.col(col) == s).over(f) * sectors + (sectors - 1 - s) for s in range(sectors)]
    best = (sectors - 1) - F.greatest(*coded) % sectors
    return df.withColumn("sector_mode", enough(F.col(col), f, least, best))


def temp_range(df: DataFrame, col: str, rows: Sequence[int] = (24, 48), keys=KEYS) -> DataFrame:
    out = {}
    for n in rows:
        f, k = trailing(n, keys), max(6, n // 4)
        out[f"range_{n}"] = enough(F.col(col), f, k, F.max(col).over(f) - F.min(col).over(f))
        out[f"amplitude_{n}"] = enough(F.col(col), f, k, F.col(col) - F.avg(col).over(f))
    return df.withColumns(out)


def centred_normalised(df: DataFrame, col: str, rows: int = 24, keys=KEYS) -> DataFrame:
    """Position between the least and greatest value of a centred frame (12 back, 11 ahead); flat or short frames give 0.5."""
    f = ordered(keys).rowsBetween(-(rows // 2), rows // 2 - 1)
    low, high = F.min(col).over(f), F.max(col).over(f)
    span = enough(F.col(col), f, rows // 2, high - low)
    return df.withColumn("normalised", F.when(span > 0, (F.col(col) - low) / span).otherwise(0.5))


def relative_pollution(df: DataFrame, col: str = "pm25", keys=KEYS) -> DataFrame:
    """Distance from the mean of 24 rows, per station."""
    f = trailing(24, keys)
    base = enough(F.col(col), f, 12, F.avg(col).over(f))
    return df.withColumn("relative_pollution", (F.col(col) - base) / (base + 1))


def regional_trend(df: DataFrame, col: str, keys=KEYS) -> DataFrame:
    return df.withColumns(
        {"trend_mean_24": F.avg(col).over(trailing(24, keys)), "accumulation_48": F.sum(col).over(trailing(48, keys))}
    )


def border_table(readings: DataFrame, south_id: int = 1, north_id: int = 2, lag_hours: int = 24) -> DataFrame:
    """Values of two source regions by hour with each value a day earlier (0 where missing)."""
    def side(station: int, name: str, shift: int = 0) -> DataFrame:
        at = F.col(TIME) + F.expr(f"INTERVAL {shift} HOURS")
        return readings.filter(F.col("station_id") == station).select(at.alias(TIME), F.col("pm25").alias(name))

    return (
        side(south_id, "south")
        .join(side(north_id, "north"), TIME)
        .join(side(south_id, "south_lag", lag_hours), TIME, "left")
        .join(side(north_id, "north_lag", lag_hours), TIME, "left")
        .fillna(0.0, ["south_lag", "north_lag"])
    )


def fill_both(df: DataFrame, cols: Sequence[str], keys=KEYS) -> DataFrame:
    """Forward, then backward fill per station."""
    w = ordered(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in cols}
    )


def sequence_features(df: DataFrame, col: str = "pm25", lag_rows=(1, 24, 168), rows=(3, 24, 168), keys=KEYS) -> DataFrame:
    """Lag, strict rolling and difference set of the sequence models, gaps filled both ways."""
    out = rolling(lags(df, col, lag_rows, keys=keys), [col], rows, least=lambda n: n, keys=keys)
    out = diffs(out, col, [1, 24], "diff", keys=keys)
    return fill_both(out, [c for c in out.columns if c not in df.columns], keys)


def sequences(df: DataFrame, col: str = "pm25", context: int = 96, horizon: int = 24, stride: int = 24) -> DataFrame:
    """Context and target arrays every ``stride`` rows.

    Each row is copied to the (context + horizon) / stride sequences it belongs to and grouped there,
    so no list is built for rows that start no sequence.
    """
    length = context + horizon
    pos = F.row_number().over(ordered()) - 1
    first = F.greatest(F.ceil((pos - length + 1) / stride), F.lit(0))
    rows = df.select("station_id", TIME, col, pos.alias("pos"), first.alias("first"), F.floor(pos / stride).alias("last"))
    rows = rows.select("station_id", TIME, col, "pos", F.explode(F.sequence("first", "last")).alias("seq"))
    start = F.col("seq") * stride
    cell = F.struct("pos", col)
    in_context = F.col("pos") < start + context
    grouped = rows.groupBy("station_id", "seq").agg(
        F.min(TIME).alias("start"),
        F.array_sort(F.collect_list(F.when(in_context, cell))).alias("c"),
        F.array_sort(F.collect_list(F.when(~in_context, cell))).alias("t"),
    )
    full = grouped.filter((F.size("c") == context) & (F.size("t") == horizon))
    return full.select(
        "station_id", "start", F.transform("c", lambda r: r[col]).alias("context"), F.transform("t", lambda r: r[col]).alias("target")
    )


def score_trend(df: DataFrame, col: str, rows: int = 100, keys=KEYS) -> DataFrame:
    f = trailing(rows, keys)
    return df.withColumns({"score_mean": F.avg(col).over(f), "score_std": F.stddev_pop(col).over(f)})


def pollution_regressors(df: DataFrame, col: str = "pm25", keys=KEYS) -> DataFrame:
    """Lagged values filled forward and then by the station mean, with day and week statistics."""
    w = ordered(keys)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy(*keys)
    mean, std = F.avg(col).over(all_rows), F.stddev_samp(col).over(all_rows)
    shifted = df.withColumns({f"l{h}": F.lag(col, h).over(w) for h in (1, 24, 168)})
    out = {f"lag_{h}": F.coalesce(F.last(f"l{h}", ignorenulls=True).over(past), mean) for h in (1, 24, 168)}
    out["mean_24"] = F.coalesce(F.avg(col).over(trailing(24, keys)), mean)
    out["std_24"] = F.coalesce(F.stddev_samp(col).over(trailing(24, keys)), std)
    out["mean_168"] = F.coalesce(F.avg(col).over(trailing(168, keys)), mean)
    return shifted.withColumns(out).drop("l1", "l24", "l168")


def time_since_start(df: DataFrame) -> DataFrame:
    span = df.agg(F.min(TIME).alias("s"), F.max(TIME).alias("e"))
    hours = S.hours_between(F.col(TIME), F.col("s"))
    total = S.hours_between(F.col("e"), F.col("s"))
    return with_scalar(df, span).select(
        *df.columns, hours.alias("hours_since_start"), F.when(total > 0, hours / total).otherwise(0.0).alias("share_of_span")
    )


# --- positions ------------------------------------------------------------------------------

def row_position(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.withColumn("position", F.row_number().over(ordered(keys)) - 1)


def ordered_position(df: DataFrame, value: str, ties: Sequence[str], keys: Sequence[str] = (), descending: bool = False, name: str = "position") -> DataFrame:
    """0-based position of every row in Spark's order of ``value`` (then ``ties``), per key or over the whole table.

    One range exchange on (keys, value, ties) deals the rows out in order, cut at sampled values of these very columns:
    one value or key that holds a third of the rows is split by its ties. The dealt rows are written once, so that the
    counts per range, which give the offsets, and the numbering inside each range see the same cuts.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc(), *[F.col(t).asc() for t in ties]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_b1", F.spark_partition_id()), "ordered")
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = dealt.groupBy(*keys, "_b1").agg(F.count("*").alias("_c"))
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b1").alias("_b0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b1").orderBy(*order)
    same = F.col("_b1") == F.col("_b0")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = dealt.withColumn("_rn", F.row_number().over(inside) - 1)
    return numbered.join(offsets, same).withColumn(name, F.col("_off") + F.col("_rn")).select(*df.columns, name)


def global_position(df: DataFrame) -> DataFrame:
    """Position over all stations in the order (station, time)."""
    return ordered_position(df, "station_id", [TIME], name="global_position")


def in_segments(df: DataFrame, op: Callable[..., DataFrame], back: int, ahead: int = 0, segment_rows: int = SEGMENT_ROWS, bucket: str = "day", keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Run a bounded-frame operator over ordered segments of each station (or other ``keys``).

    A row's exact position comes from counts per (keys, time bucket) and its rank in the bucket; rows near
    the edge of a segment are copied to the neighbours whose frames reach them and dropped from the result.
    """
    if max(back, ahead) > segment_rows:
        raise ValueError("a frame may not be longer than a segment")
    base = df.withColumn("_d", F.date_trunc(bucket, time))
    counts = base.groupBy(*keys, "_d").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_d", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_d").orderBy(time)) - 1
    placed = base.withColumn("_r", rank).join(offsets, [*keys, "_d"]).withColumn("_p", F.col("_off") + F.col("_r"))
    home = F.floor(F.col("_p") / segment_rows)
    first, last = F.floor((F.col("_p") - ahead) / segment_rows), F.floor((F.col("_p") + back) / segment_rows)
    copies = placed.withColumn("_home", home).withColumn("segment", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    copies = copies.drop("_d", "_c", "_off", "_r", "_p")
    done = op(copies, keys=(*keys, "segment"))
    return done.filter(F.col("segment") == F.col("_home")).drop("segment", "_home")


# --- ranking, top-k -------------------------------------------------------------------------

def rank_by(df: DataFrame, score: str, ties: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """1-based rank, best score first."""
    placed = ordered_position(df, score, ties, keys, descending=True, name="_p")
    return placed.withColumn("rank", F.col("_p") + 1).drop("_p")


def top_features(df: DataFrame, k: int, method: str = "method") -> DataFrame:
    """Best k per method; the rank limit is pushed below the shuffle by the optimizer."""
    w = Window.partitionBy(method).orderBy(F.desc("score"), "feature")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def select_top(df: DataFrame, k: int, floor: float = 0.1, fallback: int = 10) -> DataFrame:
    """Best k features at or above the floor; where none reaches it, the first ``fallback`` ones."""
    best = df.filter(F.col("score") >= floor).orderBy(F.desc("score"), "feature").limit(k)
    first = df.orderBy("feature").limit(fallback)
    any_best = best.agg((F.count("*") > 0).alias("any_best"))
    return best.unionByName(with_scalar(first, any_best).filter(~F.col("any_best")).drop("any_best"))


def last_n(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Most recent n rows per key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, col: str = "pm25", keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest non-null value per key, by a partial aggregate."""
    return df.filter(F.col(col).isNotNull()).groupBy(*keys).agg(
        F.max(TIME).alias(TIME), F.max_by(col, TIME).alias(col)
    )


def best_trial(df: DataFrame, params: Sequence[str], error: str = "mae") -> DataFrame:
    return df.agg(F.min(F.struct(error, *params)).alias("b")).select("b.*")


def best_stations(df: DataFrame, min_quality: float = 0.7, max_missing: float = 30.0, min_days: int = 20) -> DataFrame:
    keep = (F.col("quality_score") >= min_quality) & (F.col("missingness_pct") <= max_missing) & (F.col("data_span_days") >= min_days)
    return df.filter(keep).orderBy(F.desc("quality_score"), "station_id")


def sorted_output(df: DataFrame) -> DataFrame:
    return df.orderBy("station_id", TIME)
