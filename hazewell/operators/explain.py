"""Importance, attribution, scenarios and anomaly scores.

Fitted models are Spark ML models; scenario tables are small and built from the last row of each
station, so every prediction is one ``transform``.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazewell.operators import windows as W
from hazewell.operators.quantiles import quantile_columns
from hazewell.operators.scalars_on import with_scalar
from hazewell.operators.select import fit_forest
from hazewell.operators.sets import jaccard
from hazewell.session import stored

TIME = "datetime_utc"
UNIT = 1_000_003


def unit_hash(*cols) -> Column:
    """A number in [0, 1) from the given columns: the same on every run and retry, unlike ``rand``."""
    return F.pmod(F.xxhash64(*cols), F.lit(UNIT)) / float(UNIT)


# --- importance -----------------------------------------------------------------------------

def permutation_importance(model, assembler, df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str], repeats: int = 3) -> DataFrame:
    """Rise of the squared error when one column takes the values of other rows; mean and deviation over repeats.

    Rows are numbered once in a hash order; in repeat r the donor of row p is row p + shift_r of that order. The donor
    serves all columns, so there is one stored copy, one join for all repeats, and one transform for all columns and repeats.
    """
    base = df.dropna(subset=[*cols, target]).select(*keys, *cols, target)
    numbered = stored(W.ordered_position(base.withColumn("_h", F.xxhash64(*keys)), "_h", list(keys), name="_pos").drop("_h"), "numbered")
    n = numbered.count()
    shifts = random.Random(n).sample(range(1, n), min(repeats, n - 1)) if n > 1 else []
    if not shifts:
        return df.sparkSession.createDataFrame([(c, None, None) for c in cols], "feature string, importance double, std double")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(s).cast("long").alias("s")) for r, s in enumerate(shifts)])).alias("x")
    donors = numbered.select("_pos", *[F.col(c).alias(f"_d_{c}") for c in cols], each)
    donors = donors.select(F.pmod(F.col("_pos") - F.col("x.s"), F.lit(n)).alias("_pos"), "x.repeat", *[f"_d_{c}" for c in cols])
    rows = numbered.join(donors, "_pos")
    swapped = rows.select("*", F.explode(F.array(*map(F.lit, [*cols, "none"]))).alias("feature"))
    swapped = swapped.select("repeat", "feature", target, *[F.when(F.col("feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for c in cols])
    sq = model.transform(assembler.transform(swapped)).withColumn("_e", F.pow(F.col(target) - F.col("prediction"), 2))
    mse = sq.groupBy("repeat", "feature").agg(F.avg("_e").alias("mse"))
    none = mse.filter(F.col("feature") == "none").select("repeat", F.col("mse").alias("_b"))
    rise = mse.filter(F.col("feature") != "none").join(none, "repeat").withColumn("rise", F.col("mse") - F.col("_b"))
    return rise.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std"))


def windowed_importance(model, assembler, df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str], rows: Sequence[int] = (24, 168), repeats: int = 1) -> DataFrame:
    """Permutation importance over the last rows of every station, one result per window."""
    out = None
    for n in rows:
        part = permutation_importance(model, assembler, W.last_n(df, n, [TIME]), cols, target, keys, repeats).withColumn("window", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def importance_stability(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str], folds: int = 3, **kw) -> DataFrame:
    """Mean, deviation and their ratio of the tree importance over hash folds."""
    fold = df.withColumn("_fold", F.floor(unit_hash(*keys, F.lit("fold")) * folds))
    rows = []
    for k in range(folds):
        model, _ = fit_forest(fold.filter(F.col("_fold") != k), cols, target, **kw)
        rows += [(k, c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    t = df.sparkSession.createDataFrame(rows, "fold INT, feature STRING, v DOUBLE")  # folds x features rows
    return t.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).withColumn("cv", F.col("std") / (F.col("mean") + 1e-8))


def explain_quality(scores: DataFrame, methods_expected: int = 5, k: int = 5) -> DataFrame:
    """Completeness (methods present), consistency (mean overlap of top-k sets), stability (1 / (1 + mean variation)), and their mean."""
    have = scores.agg((F.count_distinct("method") / methods_expected).alias("completeness"))
    same = jaccard(scores, k).agg(F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("consistency"))
    cv = scores.groupBy("feature").agg((F.stddev_pop("score") / (F.avg("score") + 1e-8)).alias("cv")).agg((1 / (1 + F.avg("cv"))).alias("stability"))
    one = with_scalar(with_scalar(have, same), cv)
    return one.withColumn("overall", (F.col("completeness") + F.col("consistency") + F.col("stability")) / 3)


# --- attribution ----------------------------------------------------------------------------

def linear_attributions(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Long table of slope x (value - mean) per row and feature; slopes from one aggregate."""
    fit = df.agg(*[e for c in cols for e in (F.try_divide(F.covar_pop(c, target), F.var_pop(c)).alias(f"w_{c}"), F.avg(c).alias(f"m_{c}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"w_{c}") * (F.col(c) - F.col(f"m_{c}"))).alias("attribution")) for c in cols])
    return with_scalar(df.select(*keys, *cols), fit).select(*keys, F.explode(cells).alias("a")).select(*keys, "a.*")


def attribution_rollup(att: DataFrame) -> DataFrame:
    """Mean, median and greatest absolute attribution per feature."""
    a = att.withColumn("_a", F.abs("attribution"))
    med = quantile_columns(a, "_a", {"median_abs": 0.5}, ["feature"])
    return a.groupBy("feature").agg(F.avg("_a").alias("mean_abs"), F.max("_a").alias("max_abs"), F.count("_a").alias("n")).join(med, "feature")


def attribution_by_hour(att: DataFrame) -> DataFrame:
    return att.groupBy(F.date_trunc("hour", TIME).alias("hour"), "feature").agg(F.avg(F.abs("attribution")).alias("importance"), F.count("*").alias("n"))


def attribution_top(att: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The k strongest features of every row (a row has one attribution per feature)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("attribution")), "feature")
    return att.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- scenarios ------------------------------------------------------------------------------

def last_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Latest complete row of each station: the baseline of its scenarios."""
    best = F.max_by(F.struct(*cols), TIME).alias("b")
    return df.dropna(subset=list(cols)).groupBy("station_id").agg(best).select("station_id", "b.*")


def _predict(model, assembler, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(assembler.transform(df))
    return out.drop("_x").withColumnRenamed("prediction", name)


def _impact(scen: DataFrame) -> DataFrame:
    i = F.col("scenario_pred") - F.col("baseline_pred")
    return scen.withColumns({"impact": i, "impact_pct": F.coalesce(F.try_divide(i, F.col("baseline_pred")) * 100, F.lit(0.0))})


def what_if(model, assembler, base: DataFrame, cols: Sequence[str], scenarios: dict[str, dict[str, tuple[str, float]]]) -> DataFrame:
    """Named user changes, each ``feature: ("multiply" | "add", amount)``, against the baseline of every station."""
    names = F.explode(F.array(*map(F.lit, scenarios))).alias("scenario")
    rows = base.select("*", names)

    def changed(c: str) -> Column:
        out = F.col(c)
        for name, ch in scenarios.items():
            if c in ch:
                how, amount = ch[c]
                new = F.col(c) * amount if how == "multiply" else F.col(c) + amount
                out = F.when(F.col("scenario") == name, new).otherwise(out)
        return out.alias(c)

    scen = _predict(model, assembler, rows.select("station_id", "scenario", *[changed(c) for c in cols]), "scenario_pred")
    ref = _predict(model, assembler, base, "baseline_pred").select("station_id", "baseline_pred")
    return _impact(scen.join(ref, "station_id"))


def make_scenarios(base: DataFrame, cols: Sequence[str], kind: str, n: int = 5, spread: float = 0.2, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Percent changes of the baseline: one feature at a time, random feature sets, or one feature group at a time.

    Amounts are hash-based in -spread..spread, so a scenario is the same on every run.
    """
    def amount(c: str) -> Column:
        return (unit_hash(F.col("station_id"), F.col("scenario"), F.lit(c)) * 2 - 1) * spread

    if kind == "systematic":
        sets = {f"systematic_{c}": [c] for c in list(cols)[:n]}
    elif kind == "grouped":
        sets = {f"group_{g}": list(f) for g, f in (groups or {}).items()}
    elif kind == "random":
        sets = {f"random_{i}": None for i in range(n)}
    else:
        raise ValueError(f"unknown scenario kind {kind!r}")
    rows = base.select("*", F.explode(F.array(*map(F.lit, sets))).alias("scenario"))

    def hit(c: str) -> Column:
        if kind == "random":
            return unit_hash(F.col("station_id"), F.col("scenario"), F.lit(c), F.lit("pick")) < min(5, len(cols)) / 2 / len(cols)
        return F.col("scenario").isin([s for s, f in sets.items() if c in f])

    touched = F.array_compact(F.array(*[F.when(hit(c), F.lit(c)) for c in cols])).alias("perturbed")
    return rows.select("station_id", "scenario", touched, *[F.when(hit(c), F.col(c) * (1 + amount(c))).otherwise(F.col(c)).alias(c) for c in cols])


def score_scenarios(model, assembler, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    ref = _predict(model, assembler, base, "baseline_pred").select("station_id", "baseline_pred")
    return _impact(_predict(model, assembler, scenarios, "scenario_pred").join(ref, "station_id"))


def sensitivity(model, assembler, base: DataFrame, cols: Sequence[str], change: float = 0.1) -> DataFrame:
    """Absolute change of the prediction when one feature rises by a tenth."""
    rows = base.select("*", F.explode(F.array(*map(F.lit, cols))).alias("feature"))
    up = rows.select("station_id", "feature", *[F.when(F.col("feature") == c, F.col(c) * (1 + change)).otherwise(F.col(c)).alias(c) for c in cols])
    ref = _predict(model, assembler, base, "baseline_pred").select("station_id", "baseline_pred")
    return _predict(model, assembler, up, "p").join(ref, "station_id").select("station_id", "feature", F.abs(F.col("p") - F.col("baseline_pred")).alias("sensitivity"))


def counterfactuals(model, assembler, base: DataFrame, cols: Sequence[str], trials: int = 100, sizes: Sequence[float] = (0.1, 0.2, 0.5, 1.0), keep: int = 5, goal: float = 1.2) -> DataFrame:
    """First trials whose prediction comes nearer to ``goal`` times the baseline than the baseline is."""
    sized = F.explode(F.array(*map(F.lit, sizes))).alias("size")
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).select("*", sized)

    def pick(c: str) -> Column:
        return unit_hash(F.col("station_id"), F.col("trial"), F.lit(c), F.lit("pick")) < min(5, len(cols)) / 2 / len(cols)

    def sign(c: str) -> Column:
        return F.when(unit_hash(F.col("station_id"), F.col("trial"), F.col("size"), F.lit(c)) < 0.5, -1.0).otherwise(1.0)

    tried = rows.select("station_id", "trial", "size", *[F.when(pick(c), F.col(c) * (1 + F.col("size") * sign(c))).otherwise(F.col(c)).alias(c) for c in cols])
    s = score_scenarios(model, assembler, base, tried)
    target = F.col("baseline_pred") * goal
    near = s.filter(F.abs(F.col("scenario_pred") - target) < F.abs(F.col("baseline_pred") - target))
    w = Window.partitionBy("station_id").orderBy("trial", "size")  # trials x sizes rows per station
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


# --- anomalies ------------------------------------------------------------------------------

def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """One isolation tree as (feature, cut, left, right, leaf path length) rows; feature -1 marks a leaf."""
    nodes: list[list] = []

    def leaf_length(n: int) -> float:
        return 0.0 if n <= 1 else 2.0 * (np.log(max(n - 1, 1)) + 0.5772156649) - 2.0 * (n - 1) / n

    stack = [(x, 0, None, None)]
    while stack:
        part, depth, parent, side = stack.pop()
        idx = len(nodes)
        if parent is not None:
            nodes[parent][side] = idx
        lo, hi = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        open_ = np.flatnonzero(hi > lo)
        if depth >= limit or len(part) <= 1 or not len(open_):
            nodes.append([-1, 0.0, -1, -1, depth + leaf_length(len(part))])
            continue
        f = int(rng.choice(open_))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes.append([f, cut, -1, -1, 0.0])
        stack.append((part[part[:, f] >= cut], depth + 1, idx, 3))
        stack.append((part[part[:, f] < cut], depth + 1, idx, 2))
    return [tuple(n) for n in nodes]


def isolation_forest(df: DataFrame, cols: Sequence[str], keys: Sequence[str], trees: int = 100, size: int = 256, seed: int = 42) -> list[np.ndarray]:
    """Trees grown on hash-drawn subsamples of about ``size`` rows, one group per tree; the forest is a few hundred numbers per tree.

    A row serves trees * size / n trees on average, whatever n: the whole part for certain, the rest by a hash, in turn
    from a tree that another hash names; at most every tree once.
    """
    share = with_scalar(df.select(*keys, *cols), df.agg((F.lit(float(trees * size)) / F.greatest(F.count("*"), F.lit(1))).alias("_share")))
    times = F.least(F.lit(trees), F.floor(F.col("_share") + unit_hash(*keys, F.lit("draw")))).cast("int")
    first = F.floor(unit_hash(*keys, F.lit("tree")) * trees).cast("int")
    drawn = share.withColumns({"_times": times, "_first": first}).filter("_times > 0")
    drawn = drawn.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).select(*keys, *cols, F.pmod(F.col("_first") + F.col("_turn"), F.lit(trees)).alias("tree"))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(list(keys))[list(cols)].to_numpy(dtype=float)
        rows = _grow(x, np.random.default_rng(seed + k), limit)
        out = pd.DataFrame(rows, columns=["f", "cut", "left", "right", "length"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", k)
        return out

    schema = "tree INT, node INT, f INT, cut DOUBLE, left INT, right INT, length DOUBLE"
    grown = drawn.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])  # bounded by trees x 2 size rows
    return [g[["f", "cut", "left", "right", "length"]].to_numpy(dtype=float) for _, g in grown.groupby("tree")]


def isolation_score(df: DataFrame, forest: list[np.ndarray], cols: Sequence[str], size: int = 256) -> DataFrame:
    """Anomaly score in 0..1 per row (higher is stranger), scored in Arrow batches with the broadcast forest."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = 2.0 * (np.log(size - 1) + 0.5772156649) - 2.0 * (size - 1) / size

    @F.pandas_udf(T.DoubleType())
    def score(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        total = np.zeros(len(x))
        for tree in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = tree[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                i = np.flatnonzero(inner)
                go_left = x[i, f[i]] < tree[at[i], 1]
                at[i] = np.where(go_left, tree[at[i], 2], tree[at[i], 3]).astype(int)
            total += tree[at, 4]
        return pd.Series(np.power(2.0, -total / (len(shared.value) * norm)))

    return df.withColumn("anomaly_score", score(*cols))


def anomalies(df: DataFrame, cols: Sequence[str], keys: Sequence[str], contamination: float = 0.1, **kw) -> DataFrame:
    """Rows beyond the contamination quantile with their strangest variable (largest scaled distance) and severity."""
    stats = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    filled = with_scalar(df, stats).select(*keys, *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in cols], *[F.col(f"_{k}_{c}") for c in cols for k in ("m", "s")])
    scored = isolation_score(filled, isolation_forest(filled, cols, keys, **kw), cols)
    cut = quantile_columns(scored, "anomaly_score", {"_cut": 1 - contamination})
    z = F.array_max(F.array(*[F.struct(F.coalesce(F.try_divide(F.abs(F.col(c) - F.col(f"_m_{c}")), F.col(f"_s_{c}")), F.lit(0.0)).alias("z"), F.lit(c).alias("v")) for c in cols]))
    decision = F.col("_cut") - F.col("anomaly_score")
    severity = F.when(decision < -0.5, "critical").when(decision < -0.3, "high").when(decision < -0.1, "medium").otherwise("low")
    return with_scalar(scored, cut).filter(F.col("anomaly_score") > F.col("_cut")).select(
        *keys, z["v"].alias("variable"), z["z"].alias("distance"), "anomaly_score", severity.alias("severity"))

