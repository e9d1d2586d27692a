"""Folds over long ordered series without holding a series in one row or one task.

A fold's steps are functions of its state. Functions of one family compose to a function of the same family, so a series
is cut into stretches, each stretch is composed on its own (side by side, in order of time), and one small function a
stretch is left. The functions of a key then carry its state from stretch to stretch. Which family a fold needs:

* ``Decay``: state vectors that shrink by a constant and take a row's numbers in (weight smoothing, exponential means)
* ``Moments``: exponential mean and variance together, the variance quadratic in the mean before it
* ``Clamped``: numbers that are scaled and then limited (learning rates)
* ``Limited``: rising piecewise-linear functions (bias learning with a largest step and a bound)
* ``Counted``: rising functions of whole numbers (the running quantile, whose value is a start, plus a step up for each
  row, less a constant for each row that was not above it: only the number of these is state)

``in_order`` is for folds that compose in no such family: rows pass by in order, and only the state is kept.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key that are composed to one function at most.
STRETCH = 32_768


class Decay:
    """x -> (1 - rate) x + rate v, for a vector v a row; ``start`` is the state before the first row."""

    def __init__(self, rate: float, start: Sequence[float]):
        self.keep, self.rate, self.start_state = 1.0 - rate, rate, list(map(float, start))

    def identity(self):
        return [1.0, np.zeros(len(self.start_state))]

    def extend(self, f, rows: np.ndarray):
        n = len(rows)
        powers = self.keep ** np.arange(n, -1, -1.0)
        f[0], f[1] = f[0] * powers[0], f[1] * powers[0] + self.rate * (powers[1:] @ rows)
        return f

    def start(self, f):
        return np.array(self.start_state)

    def apply(self, f, state):
        return f[0] * state + f[1]


class Moments:
    """Exponential mean and variance: m -> (1 - r) m + r s, then v -> (1 - r) v + r (s - m)^2, the latter from the second row on.

    A stretch is m -> A m + B and v -> A v + c0 + c1 m + c2 m^2. The first row's score is kept, so that the start can take
    back what the variance gains from it.
    """

    def __init__(self, rate: float, mean: float = 0.0, variance: float = 1.0):
        self.rate, self.mean, self.variance = rate, mean, variance

    def identity(self):
        return [None, 1.0, 0.0, 0.0, 0.0, 0.0]

    def extend(self, f, rows: np.ndarray):
        first, a, b, c0, c1, c2 = f
        keep, gain = 1.0 - self.rate, self.rate * (1.0 - self.rate) ** 2  # s - m' = (1 - r) (s - m)
        for s in rows[:, 0].tolist():
            first = s if first is None else first
            d = s - b
            c0, c1, c2 = keep * c0 + gain * d * d, keep * c1 - 2 * gain * d * a, keep * c2 + gain * a * a
            a, b = keep * a, keep * b + self.rate * s
        return [first, a, b, c0, c1, c2]

    def start(self, f):
        keep = 1.0 - self.rate
        return np.array([self.mean, (self.variance - self.rate * (keep * (f[0] - self.mean)) ** 2) / keep])

    def apply(self, f, state):
        _, a, b, c0, c1, c2 = f
        m, v = state
        return np.array([a * m + b, a * v + c0 + c1 * m + c2 * m * m])


class Clamped:
    """x -> min(high, max(low, c x)): each row scales by its number, within fixed limits; a number of 1 leaves the state."""

    def __init__(self, start: float, low: float, high: float):
        if not 0 < low <= start <= high:
            raise ValueError("the start lies within the limits, above 0")
        self.first, self.low, self.high = start, low, high

    def identity(self):
        return [1.0, self.low, self.high]

    def extend(self, f, rows: np.ndarray):
        c, low, high = f
        for x in rows[:, 0].tolist():
            if x == 1.0:
                continue
            c, low, high = c * x, min(self.high, max(self.low, low * x)), min(self.high, max(self.low, high * x))
            if c * self.low >= high:  # all states end at one number
                c, low = 1.0, high
            elif c * self.high <= low:
                c, high = 1.0, low
        return [c, low, high]

    def start(self, f):
        return np.array([self.first])

    def apply(self, f, state):
        return np.clip(state * f[0], f[1], f[2])


class Limited:
    """b -> limit(b + limit(alpha (m - b), step), bound): a rising piecewise-linear function, kept as its corners.

    Corners that all states reach as one number are merged, which bounds their number: the map draws states together.
    """

    def __init__(self, alpha: float, step: float, bound: float, start: float = 0.0):
        self.alpha, self.step, self.bound, self.first = alpha, step, bound, start

    def identity(self):
        return [[-self.bound, self.bound], [-self.bound, self.bound]]

    @staticmethod
    def _corner(xs, ys, at):
        """Make the place where the function crosses ``at`` a corner."""
        i = bisect.bisect_right(ys, at)
        if 0 < i < len(ys) and ys[i - 1] < at < ys[i]:
            xs.insert(i, xs[i - 1] + (at - ys[i - 1]) * (xs[i] - xs[i - 1]) / (ys[i] - ys[i - 1]))
            ys.insert(i, at)

    def extend(self, f, rows: np.ndarray):
        xs, ys = f
        alpha, step, bound, reach = self.alpha, self.step, self.bound, self.step / self.alpha
        for m in rows[:, 0].tolist():
            self._corner(xs, ys, m - reach)
            self._corner(xs, ys, m + reach)
            ys = [y + max(-step, min(step, alpha * (m - y))) for y in ys]
            self._corner(xs, ys, -bound)
            self._corner(xs, ys, bound)
            ys = [max(-bound, min(bound, y)) for y in ys]
            if len(ys) > 2:  # a corner between two equal values says nothing
                kept = [0, *[i for i in range(1, len(ys) - 1) if not ys[i - 1] == ys[i] == ys[i + 1]], len(ys) - 1]
                xs, ys = [xs[i] for i in kept], [ys[i] for i in kept]
        return [xs, ys]

    def start(self, f):
        return np.array([self.first])

    def apply(self, f, state):
        return np.interp(state, f[0], f[1])


class Counted:
    """k -> k + 1 for k below the row's bound, else k. A stretch of n rows is k -> k + the number of its n thresholds above k."""

    def identity(self):
        return []

    def extend(self, f, rows: np.ndarray):
        for bound in rows[:, 0].tolist():
            bound = int(bound)
            n = len(f)
            # the least k that the function takes to the bound or beyond: from threshold i - 1 on, it is k -> k + n - i
            low, high = 0, n
            while low < high:
                mid = (low + high) // 2
                if f[mid] + n - (mid + 1) >= bound:
                    high = mid
                else:
                    low = mid + 1
            reach = bound - n + low  # within the piece that ends at threshold ``low``
            if low > 0:
                reach = max(reach, f[low - 1])
            if low < n:
                reach = min(reach, f[low])
            bisect.insort(f, reach)
        return f

    def start(self, f):
        return np.array([0])

    def apply(self, f, state):
        k = int(state[0])
        return np.array([k + len(f) - bisect.bisect_right(f, k)])


def _runs(batch: pa.RecordBatch, n_keys: int):
    """Stretches of equal keys in a batch: first row, end, and key."""
    n = len(batch)
    if not n:
        return
    change = np.zeros(n, bool)
    change[0] = True
    for i in range(n_keys):
        code = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(change)
    for a, b in zip(starts, [*starts[1:], n]):
        yield int(a), int(b), tuple(batch.column(i)[int(a)].as_py() for i in range(n_keys))


def _numbers(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(first, batch.num_columns)])


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], family, names: Sequence[str], by_stretch: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """The last state of every key, as columns ``names``, and ``rows``, how many rows it took; rows with a null value are left out.

    Rows are dealt by range of (keys, order), so a long series lies in many tasks, each in order; a task gives one
    function for each key it has and for every ``stretch`` rows. ``by_stretch`` names a whole number that already cuts the
    series in order: then rows are dealt by key and that number.
    """
    cut = [by_stretch] if by_stretch else []
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.dropna(subset=list(values)).select(*keys, *cut, *[F.col(o).alias(b) for o, b in zip(order, by)], *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    dealt = rows.repartition(*keys, *cut) if by_stretch else rows.repartitionByRange(*keys, *by)
    dealt = dealt.sortWithinPartitions(*keys, *by)
    at_column, first_value = len(keys) + len(cut), len(keys) + len(cut) + len(by)
    key_fields = [rows.schema[k] for k in keys]
    made_schema = T.StructType([*key_fields, T.StructField("_at", rows.schema["_o0"].dataType), T.StructField("_n", T.LongType()), T.StructField("_made", T.BinaryType())])

    def compose(batches):
        now, made, n, at, types = None, None, 0, None, []

        def done():
            # the first row's place is passed on as it came: no change of zone or unit on the way
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(now, types)], at, pa.array([n], pa.int64()), pa.array([pickle.dumps(made)], pa.binary())], [*keys, "_at", "_n", "_made"])

        for batch in batches:
            types = types or [batch.column(i).type for i in range(len(keys))]
            numbers = _numbers(batch, first_value)
            for a, b, key in _runs(batch, at_column):
                while a < b:
                    if key != now or n >= stretch:
                        if n:
                            yield done()
                        now, made, n, at = key, family.identity(), 0, batch.column(at_column).slice(a, 1)
                    end = min(b, a + stretch - n)
                    made = family.extend(made, numbers[a:end])
                    n, a = n + end - a, end
        if n:
            yield done()

    made = dealt.mapInArrow(compose, made_schema)
    out_fields = [*key_fields, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("rows", T.LongType())]

    def carry(batches):
        now, state, n, types = None, None, 0, []

        def done():
            return pa.RecordBatch.from_arrays([*[pa.array([v], types[i]) for i, v in enumerate(now)], *[pa.array([float(s)]) for s in state], pa.array([n], pa.int64())], [*keys, *names, "rows"])

        for batch in batches:
            types = types or [batch.column(i).type for i in range(len(keys))]
            for i in range(len(batch)):
                key = tuple(batch.column(j)[i].as_py() for j in range(len(keys)))
                f = pickle.loads(batch.column(len(keys) + 2)[i].as_py())
                if state is None or key != now:
                    if state is not None:
                        yield done()
                    now, state, n = key, family.start(f), 0
                state, n = family.apply(f, state), n + batch.column(len(keys) + 1)[i].as_py()
        if state is not None:
            yield done()

    # one function a stretch: a key's are few, and pass by one at a time
    ends = made.repartition(*keys).sortWithinPartitions(*keys, "_at")
    return ends.mapInArrow(carry, T.StructType(out_fields))


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: Sequence[float], step: Callable, names: Sequence[str]) -> DataFrame:
    """The last state of every key under ``step(state, row)``, for folds whose steps don't compose.

    A key's rows pass through one task in order of time, sorted by Spark (which spills), and only its state is in memory.
    Nulls come as None.
    """
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*keys, *[F.col(o).alias(b) for o, b in zip(order, by)], *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, *by)
    fields = [*[rows.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]]
    first = len(keys) + len(order)

    def run(batches):
        now, state, types = None, None, []

        def done():
            return pa.RecordBatch.from_arrays([*[pa.array([v], types[i]) for i, v in enumerate(now)], *[pa.array([float(s)]) for s in state]], [*keys, *names])

        for batch in batches:
            types = types or [batch.column(i).type for i in range(len(keys))]
            columns = [batch.column(first + i).to_pylist() for i in range(len(values))]
            for a, b, key in _runs(batch, len(keys)):
                if state is None or key != now:
                    if state is not None:
                        yield done()
                    now, state = key, list(start)
                for i in range(a, b):
                    state = step(state, [c[i] for c in columns])
        if state is not None:
            yield done()

    return sorted_.mapInArrow(run, T.StructType(fields))
