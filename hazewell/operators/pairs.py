"""Statistics of all pairs of columns from one scan.

A batch of rows is a matrix; sums over pairs of columns are products of such matrices (values, squares, and marks of which
values are there), so any number of columns needs one pass. Tasks send a row a column, with arrays as long as there are
columns; these add up per column, and the statistics of its pairs are worked out there. Nulls, NaN and infinite values count
as missing, pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 1000
EPS = 1e-8  # fixed value: what a ratio adds to its denominator


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
    x[~np.isfinite(x)] = np.nan
    return x


def _shift(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """A number near each column: subtracted first, so that sums of squares keep their digits. It changes no result."""
    row = df.select(*cols).limit(SAMPLE).agg(*[F.avg(F.when(F.abs(c) < 1e300, F.col(c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([0.0 if v is None else float(v) for v in row])


def _correlation(n, sx, sxx, sy, syy, sxy):
    """Pearson correlation, NaN where a side doesn't vary."""
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
    return np.where((n > 0) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy), r, np.nan)


SUMS = ("n", "sx", "sxx", "sy", "syy", "sxy")


def pair_sums(df: DataFrame, names: Sequence[str], keys: Sequence[str], make: Callable[[np.ndarray], dict], finish: Callable, schema: str) -> DataFrame:
    """For the columns ``names``, sums of the matrices (a row a column) that ``make`` gives of a batch under ``keys``, and
    ``finish(i, row of each)``, an Arrow table for column ``i``."""

    def run(batches):
        total = None
        for batch in batches:
            made = make(_matrix(batch))
            total = made if total is None else {k: total[k] + made[k] for k in keys}
        if total is not None:
            n = len(total[keys[0]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *[pa.array(list(total[k]), pa.list_(pa.float64())) for k in keys]], ["i", *keys])

    def join(table):
        i = table.column("i")[0].as_py()
        return finish(i, {k: np.sum([np.asarray(v.as_py()) for v in table.column(k)], axis=0) for k in keys})

    rows = df.select(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(names)])
    return rows.mapInArrow(run, ", ".join(["i int", *[f"{k} array<double>" for k in keys]])).groupBy("i").applyInArrow(join, schema)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a, b, r for every two columns, a before b; r is over rows where both are there, null where one side doesn't vary."""
    cols = list(cols)
    shift = _shift(df, cols)

    def make(x):
        there = ~np.isnan(x)
        m, v = there.astype(float), np.where(there, x - shift, 0.0)
        return dict(zip(SUMS, (m.T @ m, v.T @ m, (v * v).T @ m, m.T @ v, m.T @ (v * v), v.T @ v)))

    def finish(i, s):
        r = _correlation(*(s[k][i + 1 :] for k in SUMS))
        return pa.table([pa.array([cols[i]] * len(r), pa.string()), pa.array(cols[i + 1 :], pa.string()), pa.array(r, mask=np.isnan(r))], ["a", "b", "r"])

    return pair_sums(df, cols, SUMS, make, finish, "a string, b string, r double")


def interactions(df: DataFrame, cols: Sequence[str], target: str, kinds: Sequence[str]) -> DataFrame:
    """a, b, kind, r and n for every two columns and kind of pair feature: its correlation with the target over the n rows
    where both are there, and ``nulls``, the larger share of nulls of the two.

    Products, quotients and sums of powers have moments that are sums over products of the columns' own powers.
    """
    cols = list(cols)
    centre = float(_shift(df, [target])[0])

    def sides(kind: str, x: np.ndarray):
        """The feature as a sum of products: pairs of (left, right) factors, which are 0 where a side is missing, and marks of what is there."""
        a = x[:, :-1]
        there = ~np.isnan(a)
        v = np.where(there, a, 0.0)
        one = there.astype(float)
        if kind == "multiplicative":
            return [(v, v)], one, one
        if kind == "ratio":
            ok = there & (v + EPS != 0)
            return [(v, np.divide(1.0, v + EPS, out=np.zeros_like(v), where=ok))], one, ok.astype(float)
        if kind == "difference":
            return [(v, one), (one, -v)], one, one
        if kind == "polynomial":
            return [(v * v, one), (one, v * v)], one, one
        if kind == "log_ratio":
            ok = there & (v > 0)
            mark = ok.astype(float)
            log = np.log1p(np.where(ok, v, 0.0))
            return [(log, mark), (mark, -log)], mark, mark
        raise ValueError(f"unknown interaction kind {kind!r}")

    def make(x):
        gaps = np.tile(np.isnan(x[:, :-1]).sum(axis=0).astype(float), (len(cols), 1))
        out = {"rows": np.full((len(cols), 1), float(len(x))), "gaps": gaps}
        x = x[~np.isnan(x[:, -1])]
        y = (x[:, -1] - centre)[:, None]
        for kind in kinds:
            terms, left, right = sides(kind, x)
            out |= {
                f"{kind}_n": left.T @ right, f"{kind}_sy": (left * y).T @ right, f"{kind}_syy": (left * y * y).T @ right, f"{kind}_sx": sum(a.T @ b for a, b in terms),
                f"{kind}_sxy": sum((a * y).T @ b for a, b in terms), f"{kind}_sxx": sum((a * c).T @ (b * d) for a, b in terms for c, d in terms),
            }
        return out

    keys = ["rows", "gaps", *[f"{kind}_{what}" for kind in kinds for what in SUMS]]

    def finish(i, s):
        after = slice(i + 1, None)
        out = []
        for kind in kinds:
            n, *rest = (s[f"{kind}_{what}"][after] for what in SUMS)
            r = _correlation(n, *rest)
            share = np.maximum(s["gaps"][i], s["gaps"][after]) / max(s["rows"][0], 1.0)
            k = len(r)
            out.append(pa.table([pa.array([cols[i]] * k, pa.string()), pa.array(cols[i + 1 :], pa.string()), pa.array([kind] * k, pa.string()), pa.array(r, mask=np.isnan(r)), pa.array(n.astype(np.int64)), pa.array(share, pa.float64())],
                                ["a", "b", "kind", "r", "n", "nulls"]))
        return pa.concat_tables(out)

    return pair_sums(df, [*cols, target], keys, make, finish, "a string, b string, kind string, r double, n long, nulls double")
