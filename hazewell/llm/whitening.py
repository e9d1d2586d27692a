"""Whitening of embeddings by a bit-sliced scatter.

Entries become whole numbers. Each dimension is shifted to start at zero, and its numbers are cut into bit planes: bit
``a`` of the dimension for 64 rows is one word. The popcount of the AND of two planes, weighted by ``2**(a + b)``, adds up to
the exact cross-product of two dimensions, so sums over any number of rows and tasks lose nothing. The scatter is centred
as whole numbers and only then divided and handed to ``eigh``.

What the driver holds grows with the square of the dimensions, never with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.session import stored

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are held at it: whole numbers must fit in 64 bits.
MOST = float(2**60)
COMPONENTS = 16
#: Numbers of a batch that are worked on at once, and rows whose bits make one block of planes.
MOST_NUMBERS = 1 << 21
BLOCK_ROWS = 8192
#: Weights 2**0 to 2**15 share one sum.
PART_BITS = 16
#: Directions whose share of the whole spread is below this are flat: rounding alone decides them.
FLAT = 1e-13


class Fit(NamedTuple):
    """What whitening needs of the distinct vectors: n of them, sums per dimension, directions (columns, by falling spread), spreads, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(embedding) -> F.Column:
    """Entries as whole numbers: floor(64 c) + 1,000,000, of the entry as a double."""
    scaled = lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double") * SCALE))) + F.lit(SHIFT).cast("long")
    return F.transform(embedding, scaled)


def usable(df: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return df.filter(F.col(embedding).isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(False)))


def matrices(batch: pa.RecordBatch, column: str, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, end and matrix of each part of the batch; every vector has ``dims`` entries."""
    col = batch.column(batch.schema.get_field_index(column))
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dims)
    step = max(1, MOST_NUMBERS // dims)
    for i in range(0, len(col), step):
        yield i, min(len(col), i + step), x[i : i + step]


def ranges(fit: DataFrame, dims: int) -> list:
    """For each dimension of the distinct vectors: rows, sum, least and greatest number."""

    def run(batches):
        n, low, high = 0, np.full(dims, 2**62, np.int64), np.full(dims, -(2**62), np.int64)
        top, rest = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            for *_, x in matrices(batch, "x", dims):
                n += len(x)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
                top += (x >> 32).sum(axis=0)
                rest += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(top), pa.array(rest), pa.array(low), pa.array(high)], ["d", "n", "top", "rest", "low", "high"])

    parts = fit.select("x").mapInArrow(run, "d int, n long, top long, rest long, low long, high long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), wide("top").alias("top"), wide("rest").alias("rest"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return [(r["n"], (int(r["top"]) << 32) + int(r["rest"]), r["low"], r["high"]) for r in sorted(rows, key=lambda r: r["d"])]


def bit_planes(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative numbers (rows x dims), by dimension and bit: each a row of 64-bit words; with the dimension and bit of each."""
    turned = np.ascontiguousarray(y.T)
    words = -(-len(y) // 64)
    planes, dim, bit = [], [], []
    for a in range(int(bits.max(initial=0))):
        of = np.flatnonzero(bits > a)
        packed = np.packbits(((turned[of] >> a) & 1).astype(np.uint8), axis=1)
        padded = np.zeros((len(of), words * 8), np.uint8)
        padded[:, : packed.shape[1]] = packed
        planes.append(padded.view(np.uint64))
        dim.append(of)
        bit.append(np.full(len(of), a))
    if not planes:
        return np.zeros((0, words), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    dim, bit = np.concatenate(dim), np.concatenate(bit)
    order = np.lexsort((bit, dim))
    return np.concatenate(planes)[order], dim[order], bit[order]


def add_cross(sums: np.ndarray, y: np.ndarray, bits: np.ndarray) -> None:
    """Add the cross-products of the rows to ``sums[part, i, j]``, for j from i on: part p holds weights from 2**(16 p)."""
    for at in range(0, len(y), BLOCK_ROWS):
        planes, dim, bit = bit_planes(y[at : at + BLOCK_ROWS], bits)
        first = np.searchsorted(dim, dim, side="left")
        for p in range(len(planes)):
            rest = slice(first[p], None)
            counts = np.bitwise_count(planes[rest] & planes[p]).sum(axis=1, dtype=np.int64)
            power = bit[rest] + bit[p]
            np.add.at(sums[:, dim[p]], (power // PART_BITS, dim[rest]), counts << (power % PART_BITS))


def cross_products(fit: DataFrame, low: list[int], high: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of (x_i - low_i) (x_j - low_j) over all rows, for i <= j; dimensions that never differ are left out."""
    dims = len(low)
    bits = np.array([(h - x).bit_length() for x, h in zip(low, high)])
    parts = max(1, -(-2 * int(bits.max(initial=0)) // PART_BITS))
    floor = np.array(low, np.int64)

    def run(batches):
        sums = np.zeros((parts, dims, dims), np.int64)
        for batch in batches:
            for *_, x in matrices(batch, "x", dims):
                add_cross(sums, x - floor, bits)
        p, i, j = np.nonzero(sums)
        for at in range(0, len(p), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(i[cut].astype(np.int32)), pa.array(j[cut].astype(np.int32)), pa.array(p[cut].astype(np.int32)), pa.array(sums[p[cut], i[cut], j[cut]])], ["i", "j", "p", "s"])

    found: dict[tuple[int, int], int] = {}
    for r in fit.select("x").mapInArrow(run, "i int, j int, p int, s long").groupBy("i", "j", "p").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (int(r["s"]) << (PART_BITS * r["p"]))
    return found


def fitted(fit: DataFrame, dims: int) -> Fit | None:
    """The covariance of distinct vectors, centred as whole numbers, and its eigenvectors; None without vectors."""
    found = ranges(fit, dims)
    if not found:
        return None
    n, low, high = found[0][0], [r[2] for r in found], [r[3] for r in found]
    shifted = [r[1] - n * r[2] for r in found]
    cross = cross_products(fit, low, high)
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * cross.get((i, j), 0) - shifted[i] * shifted[j]) / n**2  # whole numbers until here
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)]
    return Fit(n, [r[1] for r in found], vectors * np.where(lead < 0, -1.0, 1.0), values, float(np.trace(cov)))


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """x - S / n in doubles; whole parts are taken off first, so large offsets cost no digits."""
    whole = np.array([s // fit.n for s in fit.sums], np.int64)
    part = np.array([(s % fit.n) / fit.n for s in fit.sums])
    return (x - whole) - part


def deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """Exact sums over dimensions of (n x - S)**2: in 64 bits where the numbers' ranges allow it, else in Python's whole numbers."""
    whole = np.array([s // fit.n for s in fit.sums], np.int64)
    part = [s % fit.n for s in fit.sums]
    y = x - whole  # n x - S = n y - part
    most = fit.n * (int(np.abs(y).max(initial=0)) + 1)
    if most * most * x.shape[1] < 2**63:
        return ((fit.n * y - np.array(part, np.int64)) ** 2).sum(axis=1).tolist()
    return (((fit.n * y.astype(object)) - np.array(part, object)) ** 2).sum(axis=1).tolist()


def identity_error(rows: DataFrame, fit: Fit, axes: np.ndarray) -> float | None:
    """Largest entry of the whitened vectors' measured covariance less the identity; None without directions."""
    k, dims = axes.shape[1], axes.shape[0]
    if not k:
        return None

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for *_, x in matrices(batch, "x", dims):
                z = centred(x, fit) @ axes
                one += z.sum(axis=0)
                two += z.T @ z
        i, j = np.indices((k, k + 1))
        both = np.concatenate([two, one[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(both.ravel())], ["i", "j", "s"])

    # summed in decimals: the order of tasks doesn't change the result
    sums = rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,16)")).cast("double").alias("s")).collect()
    both = np.zeros((k, k + 1))
    for r in sums:
        both[r["i"], r["j"]] = r["s"]
    mean = both[:, k] / fit.n
    return float(np.abs(both[:, :k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row with a usable vector and each component: its key, component (from 1), n, deviation
    (decimal(38,0)), whitened, explained, identity_error.

    The fit takes every distinct vector once, however often it is repeated. Rows with a null vector, or a null, NaN or
    infinite entry, are dropped; a null key is kept; repeated rows each give their rows; other columns, whatever their
    names, are not touched. Vectors that have not the most frequent number of entries (the greater of two equally
    frequent) stay out of the fit and give rows with null deviation and whitened. Empty vectors have no components. With
    fewer dimensions than ``components`` there are as many as dimensions. A direction without spread has a null whitened
    and takes no part in ``identity_error``; without any spread, explained and identity_error are null too. Scaled entries
    beyond 2**60 are held at that bound. Two directions of equal spread may be turned against each other, the same way for
    all rows. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df, embedding).select(F.col(vec_id).alias("key"), whole_numbers(F.col(embedding)).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    key_type = df.schema[vec_id].dataType.simpleString()
    schema = f"`{vec_id}` {key_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    # equal vectors meet before the exchange, so a vector that a third of all rows hold is one row a task
    fit_rows = stored(rows.filter(F.size("x") == dims).select("x").distinct(), "whitening-fit")
    fit = fitted(fit_rows, dims)
    k = min(components, dims)
    seen = [c for c in range(k) if fit.values[c] > FLAT * fit.trace]
    axes = fit.vectors[:, seen] / np.sqrt(fit.values[seen])
    error = identity_error(fit_rows, fit, axes)
    share = [float(max(v, 0.0) / fit.trace) if fit.trace > 0 else None for v in fit.values[:k]]

    def run(batches):
        for batch in batches:
            for i, j, numbers in with_sizes(batch, dims):
                yield from out_rows(batch.slice(i, j - i), numbers)

    def out_rows(batch, numbers):
        m = len(batch)
        at = np.repeat(np.arange(m), k)
        if numbers is None:
            deviation = pa.nulls(m, pa.decimal128(38, 0))
            white = np.full((m, k), np.nan)
        else:
            deviation = pa.array([fits(d) for d in deviations(numbers, fit)], pa.decimal128(38, 0))
            white = np.full((m, k), np.nan)
            white[:, seen] = centred(numbers, fit) @ axes
        flat = white.ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), deviation.take(pa.array(at)),
             pa.array(flat, mask=np.isnan(flat)), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
            [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return rows.select("key", "x").mapInArrow(run, schema)


def fits(number: int):
    """The number as a decimal, or None beyond 38 digits."""
    return Decimal(number) if number < 10**38 else None


def with_sizes(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """Runs of rows of the batch and their matrix, None where vectors have another number of entries."""
    col = batch.column(1)
    at = np.concatenate(([0], np.cumsum(np.asarray(col.value_lengths()))))
    same = np.diff(at) == dims
    flat = col.flatten().to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1]))) if len(same) else np.zeros(0, int)
    step = max(1, MOST_NUMBERS // dims)
    for a, b in zip(edges, [*edges[1:], len(same)]):
        for i in range(a, b, step):
            j = min(b, i + step)
            yield i, j, flat[at[i] : at[j]].reshape(j - i, dims) if same[a] else None
