"""Structured Streaming forms of the hourly operators.

Each builder takes a streaming table (``ts`` is an event-time timestamp) and returns a streaming
table; ``run_to_table`` drives one to completion with ``availableNow`` and reads what it wrote.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazewell.session import bounded_broadcast, shared_dir, stored

LATE = "1 hour"
#: 2200 and 2250: a watermark beyond the first says that the stream is at its end, where the second is the time of its closing row.
END_US = 7_258_118_400_000_000
CLOSING_US = 8_835_955_200_000_000


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Events of a folder as a stream; all files that are there make one micro-batch, or ``files_per_batch`` at a time.

    A micro-batch costs seconds whatever its rows, and moves the watermark: files read one after another must be in event order,
    or their rows are late and dropped.
    """
    path = f"{folder.rstrip('/')}/{name}"
    table = spark.read.parquet(path)
    if not table.inputFiles():
        raise ValueError(f"no data files in {path}")
    raw = spark.readStream.schema(table.schema)
    raw = raw if files_per_batch is None else raw.option("maxFilesPerTrigger", files_per_batch)
    # a stream reads a folder: the table's own, or for a table of one file the one it lies in
    single = len(table.inputFiles()) == 1 and table.inputFiles()[0].rstrip("/").endswith(f"/{name}")
    raw = raw.option("pathGlobFilter", name).parquet(folder) if single else raw.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, root: str) -> None:
    q = (
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available, exactly once, and read the result; output and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    root = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    _run(stream, root)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_to_end(build: Callable[[DataFrame], DataFrame], events: DataFrame, name: str) -> DataFrame:
    """As ``run_to_table`` for a keyed stream, with the rows that the last watermark has not passed.

    ``build`` makes the stream from events. Once all events are in, a closing row at the end of time comes in by a second
    source; its watermark lets every waiting row through. It has no key, and stays behind.
    """
    spark = events.sparkSession
    root = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    spark.createDataFrame([], events.schema).write.parquet(f"{root}/closing")
    stream = build(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{root}/closing")))
    _run(stream, root)
    values = {"ts": F.timestamp_micros(F.lit(CLOSING_US)), "value": F.lit(float("inf"))}  # no threshold keeps it out
    closing = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    closing.coalesce(1).write.mode("append").parquet(f"{root}/closing")
    _run(stream, root)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def last_rows(updates: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """The last row that a keyed stream gave for each key: it gives one for each micro-batch that has the key, with a running count."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), count).alias("_last")).select(*keys, "_last.*")


# --- windows --------------------------------------------------------------------------------

def stream_hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """Tumbling hourly means per station; an hour is final once the watermark passes its end."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(w, "station_id").agg(F.avg("value").alias("pm25"), F.count("*").alias("n")).select(
        "station_id", F.col("window.start").alias("datetime_utc"), "pm25", "n")


def stream_rolling(events: DataFrame, late: str = LATE) -> DataFrame:
    """Mean of 24 hours, every hour."""
    w = F.window("ts", "24 hours", "1 hour")
    return events.withWatermark("ts", late).groupBy(w, "station_id").agg(F.avg("value").alias("mean_24")).select(
        "station_id", F.col("window.start").alias("window_start"), "mean_24")


def stream_sessions(events: DataFrame, gap: str = "2 hours", late: str = LATE) -> DataFrame:
    """Stretches of activity per user without a gap longer than the limit."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


# --- joins ----------------------------------------------------------------------------------

def stream_enrich(events: DataFrame, weather: DataFrame) -> DataFrame:
    """Join each event to the weather of its hour (a static table)."""
    w = weather.select(F.col("datetime_utc").alias("hour"), "t2m_celsius", "blh")
    return events.withColumn("hour", F.date_trunc("hour", "ts")).join(w, "hour", "left").select("event_id", "station_id", "ts", "value", "t2m_celsius", "blh")


def stream_verify(forecasts: DataFrame, observations: DataFrame, hours: int = 3, late: str = LATE) -> DataFrame:
    """Match forecasts with observations of the same user made within the following hours; both sides are bounded in time, so state is dropped."""
    f = forecasts.withWatermark("ts", late).select(F.col("event_id").alias("forecast_id"), F.col("user_id").alias("f_user"), F.col("ts").alias("f_ts"), F.col("value").alias("yhat"))
    o = observations.withWatermark("ts", late).select("event_id", "user_id", "ts", F.col("value").alias("y"))
    bound = (F.col("user_id") == F.col("f_user")) & (F.col("ts") >= F.col("f_ts")) & (F.col("ts") <= F.col("f_ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return f.join(o, bound).select("forecast_id", "event_id", "user_id", "yhat", "y", (F.col("y") - F.col("yhat")).alias("err"))


def stream_dedupe(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """First event of each key within the watermark; state is dropped after it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


# --- keyed state ----------------------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_US = 3_600_000_000
#: Groups that the keys of a fold are dealt to by hash; rows of a group that are put in order at once, and least rows that wait as one part.
KEY_GROUPS = 256
BLOCK_ROWS = 200_000
PART_ROWS = 4_096
#: What stands for a missing time or event, which come first.
LEAST = -(2**63)


class EventOrder(StatefulProcessor):
    """Folds the rows of each key in event order, however they come in.

    Keys are dealt to groups by hash, and rows wait in parts of whole hours and some thousand rows, so that a call to the
    state serves many rows. A group's parts wait in map state until the watermark has passed their first hour; then they are
    folded in order of (time, event), up to the hour where the next part begins. In memory are one block of new rows, or
    the parts that overlap in time (one or two for each block that still waits), and the states of the group's keys. Late
    rows, which the watermark had passed when they came, are dropped by Spark. ``step(key, state, ts, event_id, value)`` takes microseconds and gives the new
    state (a tuple, None at first) and what to put out, a list of rows; ``idle`` says when, in microseconds, a state without
    further rows is done with (None: never), and what is put out then. With ``summary`` a row is put out for each key and
    release instead of for each step.
    """

    def __init__(self, columns, n_keys, step, idle=None, summary=None):
        self.columns, self.step, self.idle, self.summary = columns, step, idle, summary
        self.numbers = ["at", "event_id", "nulls", *[f"key{i}" for i in range(n_keys)]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour BIGINT, part BIGINT", "rows BINARY")
        self.parts = handle.getValueState("parts", "n BIGINT")
        self.folded = handle.getValueState("folded", "states BINARY")

    def table(self, out: list) -> pd.DataFrame:
        """Rows as pandas; whole numbers stay whole beside nulls."""
        kinds = {"BIGINT": "Int64", "TIMESTAMP": "datetime64[us]", "DOUBLE": "float64"}
        return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=kinds[kind]) for i, (c, kind) in enumerate(self.columns.items())})

    def blocks(self, rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """The rows as whole numbers (the value's bits last), ``BLOCK_ROWS`` or a little more at a time."""
        held, n = [], 0
        for frame in rows:
            held.append(np.column_stack([*[frame[c].to_numpy(np.int64) for c in self.numbers], frame["value"].to_numpy(np.float64).view(np.int64)]))
            n += len(frame)
            if n >= BLOCK_ROWS:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    def put(self, rows: np.ndarray, part: int) -> int:
        """Cut rows into parts that wait, numbered from ``part`` on; the next free number."""
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at = 0
        for cut in [*(np.flatnonzero(np.diff(rows[:, 0] // HOUR_US)) + 1).tolist(), len(rows)]:
            if cut - at >= PART_ROWS or cut == len(rows):
                self.waiting.updateValue((int(rows[at, 0] // HOUR_US), part), (rows[at:cut].tobytes(),))
                at, part = cut, part + 1
        return part

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part, first = (self.parts.get() or (0,))[0], None
        for block in self.blocks(rows):
            part = self.put(block, part)
            first = int(block[:, 0].min()) if first is None else min(first, int(block[:, 0].min()))
        if first is not None:
            self.parts.update((part,))
            self.handle.registerTimer(first // 1000)
        yield self.table([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.folded.get()
        states = pickle.loads(kept[0]) if kept else {}
        places: dict[int, list[int]] = {}
        for hour, part in self.waiting.keys():
            places.setdefault(hour, []).append(part)
        hours = sorted(places)
        due = [hour for hour in hours if hour * HOUR_US <= passed]
        out, stepped = [], {}
        held = np.zeros((0, len(self.numbers) + 1), np.int64)
        for i, hour in enumerate(due):
            held = np.concatenate([held, *[np.frombuffer(self.waiting.getValue((hour, part))[0], np.int64).reshape(-1, held.shape[1]) for part in sorted(places[hour])]])
            bound = passed if i + 1 == len(due) else hours[i + 1] * HOUR_US - 1
            now = held[:, 0] <= bound
            rows, held = held[now], held[~now]
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            for (ts, event, nulls, *who), value in zip(rows[:, :-1].tolist(), rows[:, -1].copy().view(np.float64).tolist()):
                one = tuple(None if nulls >> n & 1 else k for n, k in enumerate(who)) if nulls else tuple(who)
                states[one], some = self.step(one, states.get(one), ts, event, value)
                out += some
                stepped[one] = True
            if len(out) >= BLOCK_ROWS:
                yield self.table(out)
                out = []
        if len(due) == len(hours):
            self.waiting.clear()
        else:
            for hour in due:
                for part in places[hour]:
                    self.waiting.removeKey((hour, part))
        later = hours[len(due)] * HOUR_US if len(due) < len(hours) else None
        if len(held):
            self.parts.update((self.put(held, self.parts.get()[0]),))
            later = int(held[:, 0].min())
        if self.summary:
            out += [self.summary(one, states[one]) for one in stepped]
        if self.idle and passed < END_US:  # the end is no silence
            for one in list(states):
                over, last = self.idle(states[one])
                if over < passed:
                    out += last(one)
                    del states[one]
                else:
                    later = over if later is None else min(later, over)
        if states:
            self.folded.update((pickle.dumps(states),))
        else:
            self.folded.clear()
        if later is not None:
            self.handle.registerTimer(max(int(later) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.table(out)

    def close(self) -> None:
        pass


def event_order(events: DataFrame, keys: list[str], late: str, schema: str, step, idle=None, summary=None, groups: int = KEY_GROUPS) -> DataFrame:
    """The stream folded per key (whole numbers) in event order; see ``EventOrder``. Rows need ts, event_id and value."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one that holds map state and timers
    columns = dict(c.strip().split(" ") for c in schema.split(","))
    nulls = sum((F.col(k).isNull().cast("bigint") * 2**i for i, k in enumerate(keys)), F.lit(0).cast("bigint"))
    rows = events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), "ts", F.coalesce(F.unix_micros("ts"), F.lit(LEAST)).alias("at"),
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(LEAST)).alias("event_id"), F.col("value").cast("double").alias("value"), nulls.alias("nulls"),
        *[F.coalesce(F.col(k).cast("bigint"), F.lit(0)).alias(f"key{i}") for i, k in enumerate(keys)])
    return rows.groupBy("_group").transformWithStateInPandas(EventOrder(columns, len(keys), step, idle, summary), schema, "Append", "EventTime")


def _stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def stream_alerts(events: DataFrame, threshold: float = 55.0, cooldown_minutes: int = 30, late: str = LATE) -> DataFrame:
    """Alerts above the threshold, at most one per user and cool-down; a user's state goes when the watermark passes the cool-down."""
    cool = cooldown_minutes * 60_000_000

    def step(key, last, ts, event, value):
        if last is None or ts - last[0] >= cool:
            return (ts,), [(key[0], event, _stamp(ts), value)]
        return last, []

    return event_order(events.filter(F.col("value") >= threshold), ["user_id"], late, "user_id BIGINT, event_id BIGINT, ts TIMESTAMP, value DOUBLE", step,
                       idle=lambda last: (last[0] + cool, lambda key: []))


def stream_stale(events: DataFrame, hours: int = 2, late: str = LATE) -> DataFrame:
    """One row per silence longer than the limit: seen as a gap between events, or by the event-time timer when no event follows."""
    gap = hours * HOUR_US

    def step(key, last, ts, event, value):
        return (ts,), [(key[0], _stamp(last[0]))] if last is not None and ts - last[0] > gap else []

    return event_order(events.withColumn("value", F.lit(0.0)), ["user_id"], late, "user_id BIGINT, stale_since TIMESTAMP", step,
                       idle=lambda last: (last[0] + gap, lambda key: [(key[0], _stamp(last[0]))]))


def stream_bias(events: DataFrame, least: int = 24, alpha: float = 0.1, max_step: float = 0.8, bound: float = 10.0, late: str = LATE) -> DataFrame:
    """Learned bias of the last-value forecast per (station, hour of day): state holds last value, count, error sum and bias."""
    def step(key, state, ts, event, value):
        if state is None:
            return (value, 0, 0.0, 0.0), []
        last, n, total, bias = state
        n, total = n + 1, total + (value - last)
        if n >= least:
            move = min(max_step, max(-max_step, alpha * (total / n - bias)))
            bias = min(bound, max(-bound, bias + move))
        return (value, n, total, bias), []

    return event_order(events.withColumn("hour", F.hour("ts").cast("bigint")), ["station_id", "hour"], late, "station_id BIGINT, hour BIGINT, n BIGINT, bias DOUBLE",
                       step, summary=lambda key, state: (key[0], key[1], state[1], state[3]))


def stream_conformal(events: DataFrame, centre: float = 50.0, q: float = 0.9, rate: float = 0.5, late: str = LATE) -> DataFrame:
    """Running quantile of the distance from a centre per station, with the share it covered so far."""
    def step(key, state, ts, event, value):
        score = abs(value - centre)
        if state is None:
            return (1, 0, score), []
        n, inside, thr = state
        return (n + 1, inside + int(score <= thr), thr + rate * q if score > thr else thr - rate * (1 - q)), []

    return event_order(events, ["station_id"], late, "station_id BIGINT, n BIGINT, threshold DOUBLE, coverage DOUBLE", step,
                       summary=lambda key, state: (key[0], state[0], state[2], state[1] / max(state[0] - 1, 1)))


# --- refresh --------------------------------------------------------------------------------

SUMS = "station_id BIGINT, datetime_utc TIMESTAMP, total DOUBLE, n BIGINT, least DOUBLE, most DOUBLE"


class HourlyView:
    """Hourly sums, counts, least and greatest values in a store by day, kept up to date from batches of new events.

    A batch reads and writes only the days that it touches: ``day=D/epoch=E`` holds day D as of batch E. The log, one small
    table a batch, names the days of each batch that is done; the newest logged epoch of a day is its state. A batch that is
    run again after a failure starts from the states before it and overwrites its own; one that is logged is left out.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.days, self.log = spark, f"{root}/days", f"{root}/log"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def done(self, before: int | None = None) -> DataFrame:
        """Newest epoch of each day, of batches before the given one."""
        if not self._there(self.log):
            return self.spark.createDataFrame([], "day DATE, epoch BIGINT")
        rows = self.spark.read.schema("day DATE, epoch BIGINT, batch BIGINT").parquet(self.log)
        return (rows if before is None else rows.filter(F.col("batch") < before)).groupBy("day").agg(F.max("epoch").alias("epoch"))

    def paths(self, days: list, before: int) -> list[str]:
        """Where the states of these days lie; a day that has none yet is left out."""
        known = self.done(before).filter(F.col("day").isin(days)).collect() if days else []
        return [f"{self.days}/day={r['day']}/epoch={r['epoch']}" for r in known]

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Merge new events (station_id, ts, value) into the days that they touch."""
        if self._there(f"{self.log}/batch={epoch}/_SUCCESS"):
            return
        new = batch.groupBy("station_id", F.date_trunc("hour", "ts").alias("datetime_utc")).agg(
            F.sum("value").alias("total"), F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        new = stored(new, "refresh-new")  # read for its days, and once more to be merged
        days = [r["day"] for r in new.select(F.to_date("datetime_utc").alias("day")).distinct().collect()]  # calendar days of one batch
        old = self.paths(days, epoch)
        both = new.unionByName(self.spark.read.schema(SUMS).parquet(*old)) if old else new
        merged = both.groupBy("station_id", "datetime_utc").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        merged = merged.withColumns({"day": F.to_date("datetime_utc"), "epoch": F.lit(epoch).cast("long")})
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "epoch").parquet(self.days)
        log = self.spark.createDataFrame([(d, epoch) for d in days], "day DATE, epoch BIGINT")
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.log}/batch={epoch}")

    def read(self) -> DataFrame:
        """day, station_id, datetime_utc, pm25 (mean), n, least, most: the newest state of every day."""
        if not self._there(self.days):
            return self.spark.createDataFrame([], f"day DATE, {SUMS}").withColumn("pm25", F.lit(0.0)).drop("total")
        rows = self.spark.read.schema(f"{SUMS}, day DATE, epoch BIGINT").parquet(self.days)
        newest = bounded_broadcast(self.done())
        return rows.join(newest, ["day", "epoch"]).select("day", "station_id", "datetime_utc", F.try_divide("total", "n").alias("pm25"), "n", "least", "most")


def stream_refresh(events: DataFrame, name: str = "refresh") -> DataFrame:
    """Keep an hourly table up to date from a stream of events; see ``HourlyView``."""
    spark = events.sparkSession
    root = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    rows = events.select("station_id", "ts", "value")
    q = rows.writeStream.foreachBatch(lambda batch, epoch: HourlyView(batch.sparkSession, root).add(batch, epoch)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return HourlyView(spark, root).read()
