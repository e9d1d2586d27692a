"""Mutual information from nearest neighbours.

Values become ranks, which changes no mutual information and makes both axes evenly filled: a strip of ranks on one axis
holds as many rows as it is wide. A row's k-th neighbour (by the larger of the two rank distances) is looked for in its
strip and the half strips beside it; rows for which a nearer one might lie outside, a few, are looked at again in strips
twice as wide. How many rows are nearer on one axis alone follows from the rank and the distance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.operators import windows as W
from hazewell.session import bounded_broadcast, stored

K = 3
#: A strip is this many times as wide as the root of the rows, at least LEAST: neighbours lie about one root away.
ROOTS = 8
LEAST = 1024
FAR = np.iinfo(np.int64).max


def kth_distance(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """For each wanted point the k-th smallest of max(|dx|, |dy|) to the others, FAR with fewer than k others.

    Points are passed in order of y, outwards from each one, until the step in y alone is as far as the k-th found.
    """
    order = np.argsort(y, kind="stable")
    xs, ys, n = x[order], y[order], len(x)
    at = np.flatnonzero(wanted[order])
    best = np.full((k, len(at)), FAR)
    live, j = np.arange(len(at)), 1
    while len(live):
        gap = np.full(len(live), FAR)
        for side in (-1, 1):
            to = at[live] + side * j
            here = np.flatnonzero((to >= 0) & (to < n))
            one, other, of = at[live[here]], to[here], live[here]
            dy = np.abs(ys[other] - ys[one])
            d = np.maximum(dy, np.abs(xs[other] - xs[one]))
            for r in range(k):
                best[r, of], d = np.minimum(best[r, of], d), np.maximum(best[r, of], d)
            gap[here] = np.minimum(gap[here], dy)
        live = live[gap < best[k - 1, live]]
        j += 1
    back = np.full(n, FAR)
    back[order[at]] = best[k - 1]
    return back[wanted]


def digamma(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1 on."""
    x = n.astype(float)
    out = np.zeros(len(x))
    for _ in range(12):
        small = x < 12
        out[small] -= 1.0 / x[small]
        x = np.where(small, x + 1, x)
    i = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def ranks(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """feature, rx, ry: places of each feature's and the target's values among the rows where both are there; equal values in a hashed order, another one on either axis."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(F.xxhash64(*keys).alias("id"), F.col(target).cast("double").alias("y"), F.explode(cells).alias("c")).select("id", "y", "c.*").filter(usable("x") & usable("y"))
    rows = rows.withColumns({"hx": F.xxhash64("id", F.lit("x")), "hy": F.xxhash64("id", F.lit("y"))})
    rows = W.ordered_position(rows, "x", ["hx", "hy"], ["feature"], name="rx")
    return W.ordered_position(rows.select("feature", "rx", "y", "hy"), "y", ["hy", "rx"], ["feature"], name="ry").select("feature", "rx", "ry")


def neighbour_distances(points: DataFrame, k: int = K) -> DataFrame:
    """feature, rx, ry, n, d: the rank distance d of each point's k-th neighbour among the feature's n points. ``points`` is a stored table."""
    sizes = points.groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") > k)
    width = F.greatest(F.lit(LEAST), F.ceil(F.sqrt("n") * ROOTS)).cast("long")
    points = points.join(bounded_broadcast(sizes.withColumn("width", width)), "feature")
    schema = "feature string, rx long, ry long, n long, width long, d long, done boolean"

    def run(table):
        rx, ry, strip, wanted = (table.column(c).to_numpy() for c in ("rx", "ry", "strip", "wanted"))
        n, width, s = (table.column(c)[0].as_py() for c in ("n", "now", "strip"))
        wanted = wanted & (rx // width == strip)
        d = kth_distance(rx, ry, wanted, k)
        low, high = s * width - width // 2, (s + 1) * width + width // 2 - 1
        own = rx[wanted]
        done = ((low <= 0) | (d <= own - low)) & ((high >= n - 1) | (d <= high - own))
        keep = table.filter(pa.array(wanted)).select(["feature", "rx", "ry", "n", "width"])
        return keep.append_column("d", pa.array(d)).append_column("done", pa.array(done))

    out, rest, wide = None, None, 1
    while True:
        now = points.withColumn("now", F.col("width") * wide)
        now = now.withColumn("wanted", F.lit(True)) if rest is None else now.join(rest.select("feature", "rx", F.lit(True).alias("wanted")), ["feature", "rx"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        half = F.floor(F.col("now") / 2)
        strips = F.sequence(F.greatest(F.lit(0), F.floor((F.col("rx") - half) / F.col("now"))), F.floor((F.col("rx") + half) / F.col("now")))
        found = stored(now.withColumn("strip", F.explode(strips)).groupBy("feature", "strip").applyInArrow(run, schema), "neighbours")
        done = found.filter("done").drop("done", "width")
        out = done if out is None else out.unionByName(done)
        rest = found.filter(~F.col("done"))
        if rest.isEmpty():
            return out
        wide *= 2


def mi_neighbours(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str], k: int = K) -> DataFrame:
    """feature, score: mutual information with the target in nats, not below 0, from each row's k-th neighbour. Rows where either is missing or infinite are left out; a feature with k rows or fewer gives no row."""
    points = stored(ranks(df, cols, target, keys), "ranks")

    def run(batches):
        for batch in batches:
            rx, ry, n, d = (batch.column(i).to_numpy() for i in range(1, 5))
            nearer = [np.minimum(n - 1, r + d - 1) - np.maximum(0, r - d + 1) for r in (rx, ry)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(digamma(nearer[0] + 1) + digamma(nearer[1] + 1))], ["feature", "n", "s"])

    terms = neighbour_distances(points, k).select("feature", "rx", "ry", "n", "d").mapInArrow(run, "feature string, n long, s double")
    per = terms.groupBy("feature", "n").agg((F.sum(F.col("s").cast("decimal(38,14)")).cast("double") / F.count("*")).alias("mean"))

    def finish(batches):
        for batch in batches:
            score = float(digamma(np.array([k]))[0]) + digamma(batch.column(1).to_numpy()) - batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.maximum(score, 0.0))], ["feature", "score"])

    return per.mapInArrow(finish, "feature string, score double")
