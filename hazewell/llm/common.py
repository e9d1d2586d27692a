"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.session import stored

#: Rows of two or three numbers that every executor may hold: a few tens of MB.
MAX_BROADCAST_ROWS = 1_000_000

#: Words are runs of anything but these.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has ``most`` rows or fewer, else as it is, for a shuffled join. Pass a stored frame: its rows are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def trimmed(text) -> F.Column:
    """The text without white space at its ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def n_words(text) -> F.Column:
    """Number of words of a text; null has none."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WHITE_RUN))).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links ``a``, ``b``: one row (node, root) for every linked node, root being the smallest node reachable.

    Alternates two star contractions (each node passes its smallest neighbour on to its larger, then to its smaller
    neighbours), which takes a logarithmic number of rounds. Every round is a minimum per node, combined before the
    shuffle, and a join whose hot nodes adaptive execution may split. Rounds are written to the shared folder, so no
    lineage grows and a lost executor costs one round. Self links and null ends are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u != v")
    now, before = stored(edges.distinct(), "links"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stored(small_.select("e.*").filter("u != v").distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
