"""Lineage, artifact and error tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.session import stored
from hazewell.sources.readers import latest_per_key


def _since(as_of: str, days: int):
    return F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def log_lineage(events: DataFrame, path: str) -> None:
    """Append events, partitioned by kind."""
    events.write.mode("append").partitionBy("kind").parquet(path)


def lineage_for(log: DataFrame, station_id: int, as_of: str, days: int = 7) -> DataFrame:
    return log.filter((F.col("station_id") == station_id) & _since(as_of, days)).orderBy("ts", "event_id")


def lineage_chain(log: DataFrame, start: DataFrame) -> DataFrame:
    """Every ancestor of the start events with its distance, however deep.

    Pointers double: a round joins all ancestors found so far with pointers that reach as far as they do, so a chain of
    depth d takes log2(d) rounds of two equi-joins. Rounds are written once. A cycle raises an error.
    """
    jump = stored(log.filter(F.col("parent_event_id").isNotNull()).select(F.col("event_id").alias("_id"), F.col("parent_event_id").alias("_up")), "parents")
    edges, step = jump.count(), 1
    found = stored(start.filter(F.col("parent_event_id").isNotNull()).select("event_id", F.col("parent_event_id").alias("ancestor"), F.lit(1).alias("depth")), "ancestors")
    while True:
        more = stored(found.join(jump, F.col("ancestor") == F.col("_id")).select("event_id", F.col("_up").alias("ancestor"), (F.col("depth") + step).alias("depth")), "ancestors")
        if more.isEmpty():
            return found
        if step > edges:
            raise ValueError("the log has a cycle of parents")
        found, step = found.unionByName(more), 2 * step
        further = jump.select("_id", F.col("_up").alias("_mid")).join(jump.select(F.col("_id").alias("_mid"), "_up"), "_mid").select("_id", "_up")
        jump = stored(further, "parents")


def upsert_artifact(current: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row per (path, stage) of both tables."""
    return latest_per_key(current.unionByName(new), ["path", "stage"], ["created", "artifact_id"])


def find_artifacts(a: DataFrame, source: str | None = None, stage: str | None = None, station_id: int | None = None) -> DataFrame:
    for col, value in (("source", source), ("stage", stage), ("station_id", station_id)):
        if value is not None:
            a = a.filter(F.col(col) == value)
    return a


def stale_artifacts(a: DataFrame, files: DataFrame) -> DataFrame:
    """Artifacts whose file is not in the inventory."""
    return a.join(files.select("file"), a["path"] == files["file"], "left_anti")


def error_rollup(errors: DataFrame) -> DataFrame:
    """Counts by type and by operation with the share recovered."""
    return errors.groupingSets([["error_type"], ["operation"], []], "error_type", "operation").agg(
        F.count("*").alias("n"), F.count_if(~F.col("recovered")).alias("open"), F.avg(F.col("recovered").cast("int")).alias("recovery_rate"))


def recent_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    return errors.orderBy(F.desc("ts"), F.desc("error_id")).limit(n)
