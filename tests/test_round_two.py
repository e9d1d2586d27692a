"""Orders, neighbours, chains, streams and files where the earlier forms lost rows or gave another order."""

import random

import pytest
from pyspark.sql import functions as F

from hazewell.operators import joins, quality, quantiles, windows
from hazewell.sources import lineage, readers
from hazewell.streaming import streams


@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
@pytest.mark.parametrize("down", [False, True])
def test_positions_follow_the_order_of_the_values(spark, kind, down):
    """Common prefixes, nulls, integers above 2**53, NaN, and one value that holds half of the rows."""
    values = {"string": ["abcdefZ", "abcdefA", "abcdefM", None, "", "é"], "bigint": [2**53 + 1, 2**53, 2**53 + 2, None, -5, 7], "double": [float("nan"), 1.5, None, -0.5, float("inf"), 2.0]}[kind]
    rows = [(i, values[i % 6] if i % 2 else values[1]) for i in range(200)]
    df = spark.createDataFrame(rows, f"i long, v {kind}").repartition(7)
    got = windows.ordered_position(df, "v", ["i"], descending=down).orderBy("position").collect()
    want = df.orderBy(F.desc("v") if down else F.asc("v"), "i").collect()
    assert [r.i for r in got] == [r.i for r in want] and [r.position for r in got] == list(range(200))


def test_positions_per_key_need_one_range_exchange(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 101).alias("v"))
    out = windows.ordered_position(df, "v", ["id"], ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = out.collect()
    for key in {r.k for r in rows}:
        own = sorted((r.v, r.id, r.position) for r in rows if r.k == key)
        assert [p for *_, p in own] == list(range(len(own)))


@pytest.mark.parametrize("accuracy", [100, 100_000])
def test_quantiles_are_exact_on_both_sides_of_the_sketch(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rnd = random.Random(3)
    rows = [("a", rnd.choice([0.0, rnd.gauss(0, 1) ** 3])) for _ in range(6000)] + [("b", float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.2, 0.5, 0.9, 1.0]
    want = {(r.k, p): x for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect() for p, x in zip(probs, r.q)}
    got = {(r.k, r.prob): r.quantile for r in quantiles.exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def stations(spark, places):
    return spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(places)], "station_id long, latitude double, longitude double")


def test_neighbours_over_the_date_line_and_near_the_poles(spark):
    rnd = random.Random(1)
    places = [(0, 179.9), (0, -179.9), (80, 10), (80, 14.5), (89.95, 0), (89.95, 180), (-89.9, 30), (-89.9, -120), (-90, 0), (75, 179.99), (75, -179.0), (90, 77)]
    places += [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(80)] + [(rnd.uniform(84, 90), rnd.uniform(-180, 180)) for _ in range(20)]
    s = stations(spark, places).cache()
    from hazewell.functions import scalars as S

    b = s.selectExpr("station_id AS b_id", "latitude AS b_lat", "longitude AS b_lon")
    d = {(r.station_id, r.b_id): r.km for r in s.crossJoin(b).filter("station_id <> b_id").select("station_id", "b_id", S.haversine(F.col("latitude"), F.col("longitude"), F.col("b_lat"), F.col("b_lon")).alias("km")).collect()}
    for km in (20.0, 90.0, 800.0, 12_000.0):
        got = {(r.a_id, r.b_id) for r in joins.station_pairs(s, km).collect()}
        assert got == {(a, c) for (a, c), x in d.items() if a < c and x <= km}
    near = {r.station_id: r.km for r in quality.nearest_neighbour(s).collect()}
    assert len(near) == len(places) and all(abs(near[i] - min(x for (a, _), x in d.items() if a == i)) < 1e-6 for i in near)
    for i in (0, 1, 4, 8, 9, 11):
        got = {r.station_id for r in joins.within_radius(s, *map(float, places[i]), 400.0).collect()}
        assert got == {i} | {c for (a, c), x in d.items() if a == i and x <= 400.0}


def test_a_set_of_many_stations_has_a_diversity(spark):
    s = stations(spark, [(i * 0.1, i % 7) for i in range(500)]).withColumn("set_id", F.lit("all"))
    assert quality.diversity(s).first()["n"] == 500


def test_chains_of_any_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(41)] + [(100, 40), (101, 100)]
    log = spark.createDataFrame(rows, "event_id long, parent_event_id long")
    got = {(r.event_id, r.ancestor, r.depth) for r in lineage.lineage_chain(log, log.filter("event_id IN (101, 5)")).collect()}
    assert got == {(101, 100, 1)} | {(101, 40 - k, k + 2) for k in range(41)} | {(5, 5 - k, k) for k in range(1, 6)}
    loop = spark.createDataFrame([(1, 2), (2, 1)], "event_id long, parent_event_id long")
    with pytest.raises(ValueError):
        lineage.lineage_chain(loop, loop)


def test_stations_and_sensors_without_rows_in_the_span_miss_all(spark):
    df = spark.sql("SELECT id % 2 AS station_id, id % 2 AS sensor_id, 1.0D AS value, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(IF(id % 2 = 0, id, id + 5000) AS INT)) AS datetime_utc FROM range(10)")
    got = {r.station_id: (r.actual, float(r.percent)) for r in quality.completeness(df, "2024-01-01 00:00:00", "2024-01-01 09:00:00").collect()}
    assert got == {0: (5, 50.0), 1: (0, 0.0)}
    got = {r.sensor_id: (r.actual, float(r.missing_pct)) for r in quality.sensor_coverage(df, "2024-01-01 00:00:00", "2024-01-01 10:00:00").collect()}
    assert got == {0: (5, 50.0), 1: (0, 100.0)}


def test_streams_read_tables_of_several_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    out = streams.run_to_table(streams.event_stream(spark, str(tmp_path)).select("event_id"), "t")
    assert out.count() == events.count() == out.distinct().count()
    (tmp_path / "none.parquet").mkdir()
    with pytest.raises(Exception):
        streams.event_stream(spark, str(tmp_path), "none.parquet")


def test_files_are_looked_at_one_by_one(spark, tmp_path):
    spark.range(10).selectExpr("id AS event_id", "id AS ts").repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(0).write.parquet(f"{tmp_path}/empty.parquet")
    (tmp_path / "events.parquet" / "broken.parquet").write_bytes(b"PAR1 no footer")
    rows = readers.validate_dataset(spark, [f"{tmp_path}/events.parquet", f"{tmp_path}/empty.parquet"], {"events.parquet": ["event_id"]}).collect()
    assert sorted((r.table, r.valid) for r in rows) == [("empty.parquet", False), ("events.parquet", False), ("events.parquet", True), ("events.parquet", True)]
    assert sum(r.n_rows or 0 for r in rows) == 10
    missing = readers.validate_dataset(spark, [f"{tmp_path}/events.parquet"], {"events.parquet": ["event_id", "value"]})
    assert missing.filter("valid").count() == 0
    found = {r.path.rsplit("/", 1)[-1]: r for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert len(found) == 4 and not found["broken.parquet"].readable and found["broken.parquet"].length == 14
    import hashlib

    sums = {r.file: r.sha256 for r in readers.file_hash(spark, str(tmp_path), chunk=5).collect()}
    assert sums["broken.parquet"] == hashlib.sha256(b"PAR1 no footer").hexdigest()


def test_keyed_streams_over_several_files(spark, tmp_path):
    """Files in order of time, read one at a time: one row per key, the same as from one file; alerts keep their cool-down."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.orderBy("ts", "event_id").collect()
    for i in range(5):
        part = rows[i * len(rows) // 5 : (i + 1) * len(rows) // 5]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/many/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/one/events.parquet")

    def all_of(folder):
        stream = streams.event_stream(spark, f"{tmp_path}/{folder}").withColumn("station_id", F.length("event_type").cast("long"))
        out = [streams.last_rows(streams.run_to_table(streams.stream_bias(stream), "b"), ["station_id", "hour"])]
        out += [streams.last_rows(streams.run_to_table(streams.stream_conformal(stream), "c"), ["station_id"])]
        out += [streams.run_to_table(streams.stream_alerts(stream, cooldown_minutes=720), "a")]
        return [sorted(map(tuple, x.collect())) for x in out]

    many, one = all_of("many"), all_of("one")
    assert many == one and all(many)
