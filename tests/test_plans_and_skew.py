"""Shape of the physical plans, and results under heavy skew."""

import datetime as dt
import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from hazewell.operators import clean
from hazewell.operators import windows as W
from hazewell.plans import QUERIES
from hazewell.sources.adapters import Tables

FOLDER = "/root/testdata/sf0.001"
# Results of a few rows (one per feature, model or day) may be gathered; tables of rows may not.
ROW_TABLES = ["global_position", "split_by_share", "rank_features", "target_lags", "target_rolling", "conformal_finite_sample", "nearest_within_tolerance"]


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", [k for k, q in QUERIES.items() if q.sql and not q.code.startswith(("ST", "U", "K11", "A1", "A2", "A4", "A6", "Q1"))][::6])
def test_no_row_python(spark, key):
    assert "BatchEvalPython" not in plan(QUERIES[key].build(Tables(spark, FOLDER)))


@pytest.mark.parametrize("key", ROW_TABLES)
def test_windows_over_rows_have_a_key(spark, key):
    """A window without a partition key gathers its input in one task: only bucket counts (``_b1``) may do that."""
    text = QUERIES[key].build(Tables(spark, FOLDER))._jdf.queryExecution().sparkPlan().toString()
    specs = re.findall(r"windowspecdefinition\(([^,]+),", text)
    assert specs
    for first in specs:
        assert " ASC" not in first and " DESC" not in first or first.startswith(("_b#", "_b1#")), first


def test_scan_prunes_columns_and_pushes_filters(spark):
    t = Tables(spark, FOLDER)
    text = plan(t.events.filter(F.col("event_type") == "view").select("value"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    assert "ReadSchema: struct<event_type:string,value:double>" in text


def test_feature_windows_share_one_exchange(spark):
    t = Tables(spark, FOLDER)
    df = W.rolling(W.lags(t.readings.cache(), "pm25", [1, 24]), ["pm25"], [6, 24])
    assert plan(df).count("Exchange hashpartitioning(station_id") <= 1


def test_hot_station_in_segments(spark):
    """A third of all rows in one station: segments give the same frames as the whole station."""
    start = dt.datetime(2024, 1, 1)
    hot = spark.range(6000).select(F.lit(1).cast("bigint").alias("station_id"), F.col("id"))
    rest = spark.range(12000).select((F.col("id") % 400 + 2).alias("station_id"), F.floor(F.col("id") / 400).alias("id"))
    df = hot.unionByName(rest).select(
        "station_id", F.timestamp_seconds(F.lit(int(start.timestamp())) + F.col("id") * 60).alias("datetime_utc"), F.pmod(F.xxhash64("station_id", "id"), F.lit(997)).cast("double").alias("pm25"))
    op = lambda d, keys: W.diffs(W.rolling(d, ["pm25"], [24], keys=keys), "pm25", [6], "d", keys=keys)
    whole = op(df, ("station_id",))
    parts = W.in_segments(df, op, back=24, segment_rows=250, bucket="hour")
    assert parts.count() == whole.count() == 18000
    assert whole.exceptAll(parts.select(*whole.columns)).count() == 0


def test_dedupe_of_a_hot_key(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("event_id"), (F.col("id") % 11).alias("v"))
    got = clean.dedupe(df, ["k"], ["event_id"])
    assert got.count() == df.select("k").distinct().count()
    assert got.filter("k = 7").first().event_id == 0
    assert "partial_min_by" in plan(got)


def test_ordered_position_with_a_hot_value(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 100.0).otherwise(F.pow(F.col("id") / 7.0, 3)).alias("x"), F.concat(F.lit("f"), "id").alias("name"))
    for ties in (["id"], ["name"]):
        got = [r.id for r in W.ordered_position(df, "x", ties).orderBy("position").collect()]
        assert got == [r.id for r in df.orderBy("x", *ties).collect()]
    down = [r.id for r in W.ordered_position(df, "x", ["id"], descending=True).orderBy("position").collect()]
    assert down == [r.id for r in df.orderBy(F.desc("x"), "id").collect()]


def test_top_k_limits_before_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    assert "WindowGroupLimit" in plan(W.last_n(t.sparse, 5, ["datetime_utc"]))
