"""Set operations on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.operators.windows import top_features


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Concatenate by column name; columns a source lacks are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_partitions(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("station_id", "partition").distinct()


def except_partitions(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersect_stations(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("station_id").intersect(b.select("station_id"))


def jaccard(scores: DataFrame, k: int = 5) -> DataFrame:
    """Overlap of the top-k feature sets of every two methods (one short row per method)."""
    sets = top_features(scores, k).groupBy("method").agg(F.collect_set("feature").alias("s"))
    a = sets.select(F.col("method").alias("a_method"), F.col("s").alias("x"))
    b = sets.select(F.col("method").alias("b_method"), F.col("s").alias("y"))
    share = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return a.join(b, F.col("a_method") < F.col("b_method")).select("a_method", "b_method", share.alias("jaccard"))
