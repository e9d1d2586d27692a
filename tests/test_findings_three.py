"""Findings of round three: keyed streams over many keys and to their end, nearest times, memory of the draw."""

import collections
import datetime as dt
import random

import pandas as pd
import pytest

from hazewell.streaming import streams as X

HOUR = X.HOUR_US


class Value:
    def __init__(self):
        self.v = None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map:
    def __init__(self):
        self.rows, self.calls = {}, 0

    def keys(self):
        return list(self.rows)

    def getValue(self, k):
        self.calls += 1
        return self.rows[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.rows[k] = v

    def removeKey(self, k):
        self.calls += 1
        del self.rows[k]

    def clear(self):
        self.rows = {}


class Handle:
    """State of one group in memory."""

    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, ms):
        self.timers.append(ms)


class Passed:
    def __init__(self, us):
        self.ms = us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def group(step, **more):
    fold = X.EventOrder({"key": "BIGINT", "ts": "BIGINT", "event": "BIGINT", "n": "BIGINT"}, 1, step, **more)
    fold.init(Handle())
    return fold


def frame(rows):
    """(key, at, event) as a fold takes them."""
    return pd.DataFrame({"at": [r[1] for r in rows], "event_id": [r[2] for r in rows], "nulls": [int(r[0] is None) for r in rows], "key0": [r[0] or 0 for r in rows], "value": 1.0})


def count_step(key, state, ts, event, value):
    n = state[0] + 1 if state else 1
    return (n,), [(key[0], ts, event, n)]


def test_calls_to_the_state_grow_with_parts_not_with_rows():
    rnd = random.Random(3)
    rows = [(rnd.randrange(200), rnd.randrange(720 * HOUR), i) for i in range(5_000)]
    fold = group(count_step)
    list(fold.handleInputRows(None, iter([frame(rows[i : i + 500]) for i in range(0, 5_000, 500)]), Passed(0)))
    out = pd.concat(fold.handleExpiredTimer(None, Passed(720 * HOUR), None))
    assert len(out) == 5_000 and fold.waiting.calls < 20
    assert not fold.waiting.rows


def test_fold_by_groups_is_the_fold_by_keys(monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 64)
    monkeypatch.setattr(X, "PART_ROWS", 8)
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 0, 1, 2**60 + 1]), rnd.randrange(90 * HOUR), i) for i in range(900)]
    fold, out = group(count_step), []
    for i in range(0, 900, 300):
        late = i // 300 * 20 * HOUR  # what the watermark has passed is not sent any more
        list(fold.handleInputRows(None, iter([frame([r for r in rows[i : i + 300] if r[1] > late])]), Passed(late)))
        out += [tuple(None if pd.isna(v) else v for v in r) for f in fold.handleExpiredTimer(None, Passed(late + 20 * HOUR + 1_234_000), None) for r in f.itertuples(index=False)]
    sent = [r for i in range(0, 900, 300) for r in rows[i : i + 300] if r[1] > i // 300 * 20 * HOUR]
    left = 60 * HOUR + 1_234_000
    for f in fold.handleExpiredTimer(None, Passed(200 * HOUR), None):
        out += [tuple(None if pd.isna(v) else v for v in r) for r in f.itertuples(index=False)]
    seen, want = collections.Counter(), []
    # rows that the watermark had passed between two blocks come after what was folded before
    assert sorted((r[0] or -1, r[1], r[2]) for r in out) == sorted((r[0] or -1, r[1], r[2]) for r in sent)
    for key, ts, event in sorted([r for r in sent if r[1] > left], key=lambda r: (r[1], r[2])):
        want.append((key, ts, event))
    assert [r[:3] for r in out if r[1] > left] == want
    for r in out:
        seen[r[0]] += 1
        assert r[3] == seen[r[0]]


# --- to the end of the stream ------------------------------------------------------------------

DAY = dt.datetime(2024, 3, 1)


def whole(spark, folder, key, rows):
    """A query over events of (hours since midnight, user, value), checked against its SQL."""
    import duckdb

    from hazewell.plans import runnable
    from tests.oracle import compare

    table = pd.DataFrame([(i, DAY + dt.timedelta(hours=h), u, "view", v, '{"k": 1}') for i, (h, u, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    table.to_parquet(f"{folder}/events.parquet", coerce_timestamps="us", index=False)
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert compare(spark, con, key, str(folder))[0]
    return sorted(tuple(r) for r in runnable(key)(spark, str(folder)).collect())


@pytest.mark.parametrize("key", ["stream_alerts", "stream_stale"])
def test_files_in_any_order_of_time_lose_no_row(spark, tmp_path, key):
    """Events of every hour in files that begin with the latest: none is late, and all make one micro-batch."""
    import duckdb

    from hazewell.plans import runnable
    from tests.oracle import compare

    rows = [(i, DAY + dt.timedelta(hours=90 - i), i % 3, "view", 50.0 + i % 20, '{"k": 1}') for i in range(90)]
    (tmp_path / "events.parquet").mkdir()
    for n in range(3):
        table = pd.DataFrame(rows[30 * n : 30 * n + 30], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        table.to_parquet(f"{tmp_path}/events.parquet/part-{n}.parquet", coerce_timestamps="us", index=False)
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(spark, con, key, str(tmp_path))[0]
    assert runnable(key)(spark, str(tmp_path)).count() > 9


def test_alerts_of_the_last_hour(spark, tmp_path):
    got = whole(spark, tmp_path, "stream_alerts", [(0, 1, 60.0), (13, 1, 70.0), (13.2, 1, 80.0), (13.5, 2, 90.0), (13.4, 3, 54.0)])
    assert [(u, e) for u, e, _, _ in got] == [(1, 0), (1, 1), (2, 3)]


def test_silences_that_end_in_the_last_hour(spark, tmp_path):
    got = whole(spark, tmp_path, "stream_stale", [(0, 1, 1.0), (7.5, 1, 1.0), (10, 1, 1.0), (10.2, 2, 1.0), (7.9, 3, 1.0), (6, 4, 1.0)])
    assert [(u, (t - DAY).total_seconds() / 3600) for u, t in got] == [(1, 0), (1, 7.5), (4, 6)]


def test_bias_learns_from_the_last_hour(spark, tmp_path):
    got = whole(spark, tmp_path, "stream_bias", [(k / 60, 1, 10.0 + k) for k in range(30)] + [(5, 1, 1.0), (5.2, 2, 3.0)])
    assert [(s, h, n) for s, h, n, _ in got] == [(5, 0, 29), (5, 5, 1)]


def test_coverage_counts_the_last_hour(spark, tmp_path):
    got = whole(spark, tmp_path, "stream_conformal", [(0, 1, 60.0), (1, 1, 40.5), (4.5, 1, 75.0), (5, 2, 50.0)])
    assert [r[:2] for r in got] == [(5, 4)] and got[0][2] == pytest.approx(10 - 0.05 + 0.45 - 0.05) and got[0][3] == pytest.approx(2 / 3)


# --- nearest times -----------------------------------------------------------------------------

def test_nearest_times_have_no_shrinking_frames(spark):
    """Frames that shrink row by row are read anew for each row: quadratic in the rows of an hour."""
    from hazewell.operators import joins as J

    rnd = random.Random(5)
    a = [(i, DAY + dt.timedelta(seconds=rnd.randrange(0, 20_000))) for i in range(500)]
    b = [(DAY + dt.timedelta(seconds=s), float(s)) for s in sorted(rnd.sample(range(0, 20_000), 25))]
    near = J.asof_nearest(spark.createDataFrame(a, "id long, datetime_utc timestamp"), spark.createDataFrame(b, "datetime_utc timestamp, v double"), 300, "v")
    back = J.lookback(spark.createDataFrame([(1, t) for _, t in a], "station_id long, datetime_utc timestamp"), spark.createDataFrame([(1, t, v) for t, v in b], "station_id long, datetime_utc timestamp, pm25 double"), 60)
    for df in (near, back):
        assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().executedPlan().toString().lower()
    at = {i: (t - DAY).total_seconds() for i, t in a}
    for r in near.collect():
        gap, v = min((abs(v - at[r.id]), v) for _, v in b)
        assert (r.v_near, r.offset_seconds) == ((v, v - at[r.id]) if gap <= 300 else (None, None))
    for r in back.collect():
        t = (r.datetime_utc - DAY).total_seconds() - 60
        assert r.nearest == min((abs(v - t), v) for _, v in b)[1]
