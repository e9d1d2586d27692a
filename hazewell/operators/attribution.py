"""Attributions of a fitted forest's predictions to its features, row by row.

A tree's leaf is a box: for each feature on its path an interval, and the share of training rows that went the leaf's way
at that feature's splits. With a set of features known, a leaf counts in full where the row's values lie in its
intervals, and by those shares for features not known. The attribution of a feature is its Shapley value in that game, exact
for every leaf; leaves, then trees, add up. So a row's attributions and the forest's mean give its prediction.

A row meets a leaf in one of 2^d ways, d features being on the leaf's path: the values for all of them are worked out once a
tree, and rows look them up in Arrow batches.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.session import shared_dir

#: Leaves that are broadcast at once: some tens of MB. A larger forest goes out in several parts, each in a pass of its own.
LEAVES = 200_000
#: Row-leaf pairs that are looked up at once.
PAIRS = 2_000_000


def tree_tables(spark: SparkSession, model) -> list[dict[str, np.ndarray]]:
    """The fitted forest's trees as arrays (left, right, feature, cut, value, rows), read from its stored form."""
    path = shared_dir(spark, f"forest-{uuid.uuid4().hex}")
    model.write().save(path)
    n = "nodeData"
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", f"{n}.id", f"{n}.leftChild", f"{n}.rightChild", f"{n}.split.featureIndex", F.get(f"{n}.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), f"{n}.prediction", f"{n}.rawCount",
        f"{n}.split.numCategories").orderBy("treeID", "id").toPandas()  # a model's nodes: it was fitted on the driver
    if (nodes["numCategories"] > 0).any():
        raise ValueError("splits by category are not attributed")
    return [{"left": t["leftChild"].to_numpy(), "right": t["rightChild"].to_numpy(), "feature": t["featureIndex"].to_numpy(), "cut": t["cut"].to_numpy(float),
             "value": t["prediction"].to_numpy(float), "rows": t["rawCount"].to_numpy(float)} for _, t in nodes.groupby("treeID")]


def leaves(tree: dict[str, np.ndarray], weight: float) -> dict[int, list[np.ndarray]]:
    """The tree's leaves by the number of features on their path: features, lower bounds (open), upper bounds, shares, and weighted values."""
    found: dict[int, list] = {}
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        if tree["left"][node] < 0:
            feats = sorted(path)
            row = (feats, [path[f][0] for f in feats], [path[f][1] for f in feats], [path[f][2] for f in feats], tree["value"][node] * weight)
            found.setdefault(len(feats), []).append(row)
            continue
        f, cut = int(tree["feature"][node]), tree["cut"][node]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((tree["left"][node], (low, min(high, cut))), (tree["right"][node], (max(low, cut), high))):
            stack.append((int(child), {**path, f: (*bounds, share * tree["rows"][child] / tree["rows"][node])}))
    return {d: [np.array([r[k] for r in rows], int if k == 0 else float) for k in range(5)] for d, rows in found.items()}


def shapley_table(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For leaves with ``d`` features: leaf x way x feature, the Shapley value of each feature for each of the 2^d ways in which a row's values can lie in the leaf's intervals (bit j: feature j does)."""
    n, d = share.shape
    inside = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1 == 1
    # e[s]: over sets of s known features, the product of what known and unknown ones count
    e = np.zeros((n, 1 << d, d + 1))
    e[..., 0] = 1.0
    for g in range(d):
        grown = e * share[:, g, None, None]
        grown[..., 1:] += e[..., :-1] * inside[None, :, g, None]
        e = grown
    size_weight = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
    out = np.empty((n, 1 << d, d))
    for f in range(d):
        z, here = share[:, f, None], inside[None, :, f]
        without = np.zeros((n, 1 << d, d))
        # take feature f out again: divide by (share + t) where it is inside, by the share where it isn't
        top = np.zeros((n, 1 << d))
        for s in range(d - 1, -1, -1):
            top = e[..., s + 1] - z * top if s < d - 1 else e[..., d]
            without[..., s] = np.where(here, top, e[..., s] / z)
        out[..., f] = value[:, None] * (here - z) * (without @ size_weight)
    return out


class Forest:
    """The leaves of some trees, and the mean that they add to."""

    def __init__(self, trees: list[dict[int, list[np.ndarray]]]):
        self.trees = trees
        self.mean = sum(float((value * share.prod(axis=1)).sum()) for t in trees for _, _, _, share, value in t.values())

    def attributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for tree in self.trees:
            for d, (feats, low, high, share, value) in tree.items():
                if not d:
                    continue
                table = shapley_table(share, value)
                at_leaf = np.arange(len(feats))
                to_feature = [np.eye(x.shape[1])[feats[:, j]] for j in range(d)]
                step = max(1, PAIRS // len(feats))
                for i in range(0, len(x), step):
                    part = x[i : i + step]
                    way = np.zeros((len(part), len(feats)), np.int64)
                    for j in range(d):
                        v = part[:, feats[:, j]]
                        way |= ((v > low[:, j]) & (v <= high[:, j])).astype(np.int64) << j
                    for j in range(d):
                        out[i : i + step] += table[at_leaf, way, j] @ to_feature[j]
        return out


def forest_attributions(model, df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long table of keys, feature, attribution and ``mean``, a row for each complete row and feature; attributions of a row and the mean add up to its prediction.

    Rows with a null in ``cols`` are left out, as the model leaves them out. ``keys`` may be any columns.
    """
    spark, cols = df.sparkSession, list(cols)
    tables = tree_tables(spark, model)
    weights = model.treeWeights
    total = sum(weights)
    parts, now, size = [], [], 0
    for table, w in zip(tables, weights):
        now.append(leaves(table, w / total))
        size += sum(len(v[4]) for v in now[-1].values())
        if size >= LEAVES:
            parts, now, size = [*parts, Forest(now)], [], 0
    parts += [Forest(now)] if now else []
    mean = sum(p.mean for p in parts)
    k = len(keys)
    rows = df.dropna(subset=cols).select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)], *[F.lit(0.0).alias(f"_a{i}") for i in range(len(cols))])
    for part in parts:
        shared = spark.sparkContext.broadcast(part)

        def add(batches, shared=shared):
            for batch in batches:
                x = np.column_stack([batch.column(k + i).to_numpy(zero_copy_only=False) for i in range(len(cols))])
                made = shared.value.attributions(x)
                sums = [pa.array(batch.column(k + len(cols) + i).to_numpy(zero_copy_only=False) + made[:, i]) for i in range(len(cols))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: k + len(cols)], *sums], batch.schema.names)

        rows = rows.mapInArrow(add, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_a{i}").alias("attribution")) for i, c in enumerate(cols)])).alias("_c")
    return rows.select(*keys, cells).select(*keys, "_c.feature", "_c.attribution", F.lit(mean).alias("mean"))
