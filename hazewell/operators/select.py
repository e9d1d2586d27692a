"""Feature statistics and selection.

Columns are many but few against rows, so every statistic is one expression of one aggregate over the
table and the result has one row per feature (or pair).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.functions import scalars as S
from hazewell.functions.scalars import interact
from hazewell.operators import pairs
from hazewell.operators.quantiles import exact_quantiles
from hazewell.operators.scalars_on import KINDS, with_scalar

CHUNK = 200  # expressions per aggregate


def per_feature(df: DataFrame, metrics: dict[str, dict[str, Column]], label: str = "feature") -> DataFrame:
    """One aggregate, turned to a row per label with its metrics."""
    names = list(metrics)
    out = None
    for i in range(0, len(names), CHUNK):
        part = names[i : i + CHUNK]
        row = df.agg(*[F.struct(F.lit(n).alias(label), *[e.alias(k) for k, e in metrics[n].items()]).alias(f"_{j}") for j, n in enumerate(part)])
        long = row.select(F.explode(F.array(*[f"_{j}" for j in range(len(part))])).alias("r")).select("r.*")
        out = long if out is None else out.unionByName(long)
    return out


def _null_share(c: str) -> Column:
    return F.avg(F.col(c).isNull().cast("int"))


def null_inf_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_feature(df, {c: {"null_share": _null_share(c), "infinite": F.count_if(F.abs(c) == float("inf"))} for c in cols})


def constant_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value: least equals greatest, or nothing but nulls."""
    flat = {c: {"constant": F.coalesce(F.min(c) == F.max(c), F.lit(True))} for c in cols}
    return per_feature(df, flat).filter("constant").select("feature")


def low_variance(df: DataFrame, cols: Sequence[str], limit: float = 0.001) -> DataFrame:
    return per_feature(df, {c: {"variance": F.var_samp(c)} for c in cols}).filter(F.col("variance") < limit)


def duplicate_cols(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Pairs of equal columns: equal fingerprints over (row key, value), then a count of differing rows."""
    prints = per_feature(df, {c: {"print": F.bit_xor(F.xxhash64(*keys, F.col(c).cast("double")))} for c in cols})
    groups = prints.groupBy("print").agg(F.sort_array(F.collect_list("feature")).alias("g")).filter(F.size("g") > 1)
    equal = [p for r in groups.select("g").collect() for p in combinations(sorted(r.g, key=list(cols).index), 2)]  # a few column names
    if not equal:
        return df.sparkSession.createDataFrame([], "a STRING, b STRING")
    diff = per_feature(df, {f"{a}|{b}": {"a": F.first(F.lit(a)), "b": F.first(F.lit(b)), "differ": F.count_if(~F.col(a).eqNullSafe(F.col(b)))} for a, b in equal})
    return diff.filter("differ = 0").select("a", "b")


def corr_pairs(df: DataFrame, cols: Sequence[str], least: float = 0.95) -> DataFrame:
    """Pairs of columns with an absolute correlation above the limit (rows where both are present); one scan for any number of columns."""
    return pairs.correlations(df, cols).filter(F.abs("r") > least)


def drop_correlated(df: DataFrame, cols: Sequence[str], least: float = 0.95) -> DataFrame:
    """Lower-variance member of each correlated pair (the second on a tie)."""
    v = per_feature(df, {c: {"v": F.var_samp(c)} for c in cols})
    p = corr_pairs(df, cols, least).join(v.select(F.col("feature").alias("a"), F.col("v").alias("va")), "a").join(
        v.select(F.col("feature").alias("b"), F.col("v").alias("vb")), "b")
    return p.select(F.when(F.col("va") < F.col("vb"), F.col("a")).otherwise(F.col("b")).alias("feature")).distinct()


def drop_sparse(df: DataFrame, cols: Sequence[str], limit: float = 0.5) -> DataFrame:
    return null_inf_profile(df, cols).filter(F.col("null_share") > limit).select("feature", "null_share")


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("x").isNotNull())


def feature_stats(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Mean, deviation, range, quartiles, skewness, excess kurtosis and correlation with the target."""
    m = per_feature(df, {c: {
        "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c).cast("double"), "max": F.max(c).cast("double"), "skewness": F.skewness(c),
        "kurtosis": F.kurtosis(c), "target_corr": F.coalesce(S.corr(c, target), F.lit(0.0))} for c in cols})
    q = exact_quantiles(_long(df, cols), "x", [0.25, 0.5, 0.75], ["feature"])
    wide = q.groupBy("feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    return m.join(wide, "feature")


def categorical_stats(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, most frequent value with count and share, entropy in bits."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    t = with_scalar(n, n.agg(F.sum("n").alias("t")))
    p = F.col("n") / F.col("t")
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("v")))
    return t.agg(F.count("*").alias("distinct_values"), best["v"].alias("mode"), F.max("n").alias("mode_count"), F.max(p).alias("mode_share"),
                 (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"))


def feature_quality(df: DataFrame, cols: Sequence[str], keys: Sequence[str], corr_limit: float = 0.95) -> DataFrame:
    """Score of a feature set: 1 less capped penalties for gaps, infinities, constant, duplicate and correlated columns."""
    n = len(cols)
    prof = null_inf_profile(df, cols).agg(F.avg("null_share").alias("missing"), F.sum("infinite").alias("infinite"))
    const = constant_cols(df, cols).agg(F.count("*").alias("constant"))
    dup = duplicate_cols(df, cols, keys).agg(F.count("*").alias("duplicate"))
    corr = corr_pairs(df, cols, corr_limit).agg(F.count("*").alias("correlated"))
    one = with_scalar(with_scalar(with_scalar(prof, const), dup), corr)

    def cap(limit: float, x: Column) -> Column:
        return F.least(F.lit(limit), x)

    s = 1 - cap(0.5, F.col("missing") * 2) - cap(0.2, F.col("infinite") * 0.05) - cap(0.2, F.col("constant") / n * 0.5) \
        - cap(0.1, F.col("duplicate") / n * 0.3) - cap(0.15, F.col("correlated") / n * 0.2)
    return one.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


# --- scores ---------------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return pd.Series(np.vectorize(math.erfc, otypes=[float])(x.to_numpy(dtype=float)))


def corr_score(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    return per_feature(df, {c: {"score": F.coalesce(F.abs(S.corr(c, target)), F.lit(0.0))} for c in cols})


def f_score(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """1 - p of the F test per feature.  p is the normal limit of the t statistic, taken on the one-row-per-feature result."""
    both = lambda c: F.col(c).isNotNull() & F.col(target).isNotNull()
    m = per_feature(df, {c: {"r": F.coalesce(S.corr(c, target), F.lit(0.0)), "n": F.count_if(both(c))} for c in cols})
    t = F.abs("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return m.withColumn("t", t).select("feature", "t", (1 - _erfc(F.col("t") / math.sqrt(2))).alias("score"))


def mi_score(df: DataFrame, cols: Sequence[str], target: str, bins: int = 8) -> DataFrame:
    """Mutual information with the target over equal-frequency bins (edges by exact quantiles)."""
    names = [*cols, target]
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(_long(df, names), "x", probs, ["feature"]).groupBy("feature").agg(F.array_sort(F.collect_list("quantile")).alias("e"))
    row = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "e"))).alias("edges"))  # bins - 1 numbers per column
    binned = with_scalar(df.select(*names), row)

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.col("edges")[c], lambda e: e < F.col(c)))

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), bin_of(c)).alias("bx")) for c in cols])
    joint = binned.filter(F.col(target).isNotNull()).select(bin_of(target).alias("by"), F.explode(cells).alias("c")).select("by", "c.*").filter(
        F.col("bx").isNotNull()).groupBy("feature", "bx", "by").agg(F.count("*").alias("n"))  # at most bins * bins rows per feature
    nx = F.sum("n").over(Window.partitionBy("feature", "bx"))
    ny = F.sum("n").over(Window.partitionBy("feature", "by"))
    nt = F.sum("n").over(Window.partitionBy("feature"))
    p = joint.withColumns({"nx": nx, "ny": ny, "nt": nt})
    return p.groupBy("feature").agg(F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("score"))


def fit_forest(df: DataFrame, cols: Sequence[str], target: str, trees: int = 100, depth: int = 10, seed: int = 42):
    """Random forest on complete rows; returns the fitted model and the assembler."""
    va = VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="skip")
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="prediction", numTrees=trees, maxDepth=depth, seed=seed).fit(
        va.transform(df.dropna(subset=[*cols, target])))
    return model, va


def tree_score(df: DataFrame, cols: Sequence[str], target: str, **kw) -> DataFrame:
    model, _ = fit_forest(df, cols, target, **kw)
    rows = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature STRING, score DOUBLE")


def combine_scores(scores: DataFrame) -> DataFrame:
    """Scores to 0..1 per method, then the mean per feature; a flat method gives 1 to positive scores."""
    lim = scores.groupBy("method").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    s = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise((F.col("score") > 0).cast("double"))
    return scores.join(lim, "method").groupBy("feature").agg(F.avg(s).alias("score"))


# --- interactions ---------------------------------------------------------------------------

def find_interactions(df: DataFrame, cols: Sequence[str], target: str, kinds: Sequence[str] = tuple(KINDS), least: float = 0.1, top: int = 20) -> DataFrame:
    """Best pair features by correlation with the target: |r| at least the limit, more than ten values, p below 0.05; one scan for all pairs and kinds."""
    r = F.abs("r")
    t = r * F.sqrt((F.col("n") - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    ok = (r >= least) & (F.col("n") > 10) & (t > 1.96) & (F.col("nulls") <= 0.5)
    found = pairs.interactions(df, cols, target, kinds)
    return found.filter(ok).select("a", "b", "kind", r.alias("score"), "n").orderBy(F.desc("score"), "a", "b", "kind").limit(top)


# Pairs with a physical meaning.
DOMAIN_PAIRS = [
    ("wind_speed", "blh", "multiplicative"),
    ("t2m_celsius", "wind_speed", "multiplicative"),
    ("wind_speed", "stability_indicator", "ratio"),
    ("blh", "t2m_celsius", "ratio"),
    ("lag_pm25_1", "lag_wind_speed_1", "multiplicative"),
]
KIND_WORD = {"multiplicative": "x", "ratio": "div", "difference": "minus"}


def domain_interactions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The physical pairs whose columns the table has."""
    have = [(a, b, k) for a, b, k in DOMAIN_PAIRS if a in df.columns and b in df.columns]
    return df.select(*keys, *[interact(F.col(a), F.col(b), k).alias(f"{a}_{KIND_WORD.get(k, k)}_{b}") for a, b, k in have])


def interaction_stats(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    return per_feature(df, {c: {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "missing": _null_share(c), "target_corr": S.corr(c, target)} for c in cols})


def select_n(df: DataFrame, cols: Sequence[str], target: str, n: int, method: str = "correlation") -> DataFrame:
    """First n features by absolute correlation or by variance."""
    expr = {"correlation": lambda c: F.abs(S.corr(c, target)), "variance": F.var_samp}[method]
    return per_feature(df, {c: {"score": expr(c)} for c in cols}).filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "feature").limit(n)


def rank_features(df: DataFrame, cols: Sequence[str], target: str, top: int = 10) -> DataFrame:
    """Two rankings in one table: strongest correlation with the target, and most nulls."""
    m = per_feature(df, {c: {"correlation": F.abs(S.corr(c, target)), "nulls": F.count_if(F.col(c).isNull()).cast("double")} for c in cols})
    a = m.filter(F.col("correlation").isNotNull()).select(F.lit("correlation").alias("ranking"), "feature", F.col("correlation").alias("value"))
    b = m.filter(F.col("nulls") > 0).select(F.lit("nulls").alias("ranking"), "feature", F.col("nulls").alias("value"))
    return a.orderBy(F.desc("value"), "feature").limit(top).unionByName(b.orderBy(F.desc("value"), "feature").limit(top))
