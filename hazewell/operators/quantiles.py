"""Exact quantiles of large groups.

``percentile`` keeps every distinct value of a group in one buffer, so it is used only where a
group is bounded (one station's hours).  For larger groups the quantile is bracketed first by a
bounded-size sketch, and only the values inside the bracket are counted and ordered; a group of
at most ``ACCURACY`` rows is its own bracket. Brackets, one row a group, are broadcast if they are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazewell.session import bounded_broadcast

ACCURACY = 100_000  # rank error of the sketch is at most n / ACCURACY


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, prob, quantile) with linear interpolation between neighbouring values."""
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    margin = 2.0 / ACCURACY
    lo_p = [max(0.0, p - margin) for p in probs]
    hi_p = [min(1.0, p + margin) for p in probs]
    br = data.groupBy(*keys).agg(
        F.percentile_approx("_v", [*lo_p, *hi_p], ACCURACY).alias("_b"), F.count("*").alias("_n")
    )
    joined = data.join(bounded_broadcast(br), list(keys)) if keys else data.crossJoin(F.broadcast(br))
    k = len(probs)
    slots = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when((F.col("_n") <= ACCURACY) | F.col("_v").between(F.col("_b")[i], F.col("_b")[k + i]), "in")
                .when(F.col("_v") < F.col("_b")[i], "below").alias("side"),
            )
            for i in range(k)
        ]
    )
    placed = joined.select(*keys, "_n", "_v", F.explode(F.filter(slots, lambda s: s["side"].isNotNull())).alias("_s"))
    counted = placed.groupBy(
        *keys, F.col("_s.i").alias("_i"), F.when(F.col("_s.side") == "in", F.col("_v")).alias("_v")
    ).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    ranked = counted.select(
        *keys, "_i", "_v", "_c", F.sum("_c").over(upto).alias("_cum"), prob.alias("prob"), (prob * (F.col("_n") - 1)).alias("_h")
    )
    low, high = F.floor("_h"), F.ceil("_h")
    def covers(idx):
        return F.col("_v").isNotNull() & (F.col("_cum") - F.col("_c") <= idx) & (idx < F.col("_cum"))
    ends = ranked.groupBy(*keys, "prob").agg(
        F.max(F.when(covers(low), F.col("_v"))).alias("_lo"),
        F.max(F.when(covers(high), F.col("_v"))).alias("_hi"),
        F.max("_h").alias("_h"),
    )
    return ends.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("quantile"))


def quantile_columns(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with a named column per quantile."""
    q = exact_quantiles(df, value, list(probs.values()), keys)
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name) for name, p in probs.items()]
    )
