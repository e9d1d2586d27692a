"""Importance resampling towards a target text.

Features (runs of words) fall into buckets. An array of gains, one whole number a bucket, says how much more of the target
than of the corpus a bucket holds; a text's weight is the mean gain of its features. Weights get Gumbel noise that only
depends on the key, and the highest scores are a draw without replacement.

The draw needs no sort of all rows. Every round, each task finds the median of the keys that still are in question, the
driver takes the median of these weighted by how many keys each stands for, and all keys on the wrong side of it are
out: at least a quarter of them each time (an eighth where a task has more keys than one block). Once few are left, the
exact cut-off key is known, and only the drawn rows are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.llm.words import pieces, text_bytes, word_spans
from hazewell.operators.windows import ordered_position
from hazewell.session import stored

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Keys that the driver orders itself at the end, and keys of a task whose median is taken at once.
FINISH = 4_096
BLOCK_KEYS = 1 << 20
#: Bytes of a word that are hashed step by step beside other words; longer words one by one.
STEP_BYTES = 48

#: Words are runs of ASCII digits, letters and bytes of all other characters; A-Z are folded first.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    """One byte's step of the CRC-32 that zlib computes."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_STEP = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each span of bytes, carried on from ``before`` (the CRC of what precedes it) where given."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size = size[order]
    long = int(np.searchsorted(-size, -STEP_BYTES, side="left"))
    for k in order[:long].tolist():
        crc[k] = zlib.crc32(data[starts[k] : ends[k]], int(crc[k]))
    order, size = order[long:], size[long:]
    state, at = ~crc[order], starts[order]
    for i in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -i, side="left"))  # spans of more than i bytes come first
        state[:live] = _STEP[(state[:live] ^ data[at[:live] + i]) & np.uint32(0xFF)] ^ (state[:live] >> np.uint32(8))
    crc[order] = ~state
    return crc


def features(texts, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and the buckets of all its runs of 1 to ``longest`` words with the text of each."""
    data, at = text_bytes(texts)
    data = _FOLD[data]
    starts, ends = word_spans(data, at, _IS_WORD)
    first = np.searchsorted(starts, at, side="left")
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    crc, of, found, who = crc32_spans(data, starts, ends), owner, [], []
    blank = np.array([0x20], np.uint8)
    for n in range(1, longest + 1):
        if n > 1:
            here = np.flatnonzero(of[: len(crc) - 1] == owner[n - 1 : n - 1 + len(crc) - 1]) if len(crc) > 1 else np.zeros(0, int)
            joined = crc32_spans(blank, np.zeros(len(here), int), np.ones(len(here), int), crc[here])
            crc_next = np.zeros(len(crc) - 1 if len(crc) else 0, np.uint32)
            crc_next[here] = crc32_spans(data, starts[here + n - 1], ends[here + n - 1], joined)
            crc, of = crc_next, of[: len(crc_next)]
            found.append(crc[here] % buckets)
            who.append(of[here])
        else:
            found.append(crc % buckets)
            who.append(of)
    return np.diff(first), np.concatenate(found), np.concatenate(who)


def bucket_counts(df: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of the table in each bucket; tasks send one number a bucket, the driver holds ``buckets`` numbers."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, text):
                counts += np.bincount(features(part.column(0), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(text).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of the B buckets."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [((t + 1) * float(s_all + n)) / ((s + 1) * float(t_all + n)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(key, seed: int) -> F.Column:
    """A Gumbel draw in thousandths: a function of the seed and the key alone. A null key counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, doc_id: str, text: str, target_text: str, longest: int, buckets: int, seed: int) -> DataFrame:
    """One row for each document: doc_id, n_words, n_features, weight, score."""
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        table = shared.value
        for batch in batches:
            for part in pieces(batch, "t"):
                n_words, found, who = features(part.column(1), longest, buckets)
                n = np.bincount(who, minlength=len(part))
                total = np.zeros(len(part), np.int64)
                np.add.at(total, who, table[found])
                weight = total // np.maximum(n, 1)  # floors go down
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    key_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {key_type}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


KEY = ("k_score", "k_none", "k_id", "k_features", "k_row")


def with_key(rows: DataFrame) -> DataFrame:
    """Columns whose ascending order is that of the draw: highest score, smallest doc_id (null last), fewest features; then rows that nothing tells apart, by number."""
    numeric = rows.schema["doc_id"].dataType.typeName() != "string"
    return rows.withColumns({
        "k_score": -F.col("score"), "k_none": F.col("doc_id").isNull().cast("int"), "k_id": F.coalesce("doc_id", F.lit(0) if numeric else F.lit("")),
        "k_features": F.col("n_features"), "k_row": F.monotonically_increasing_id(),
    })


def _key_struct() -> F.Column:
    return F.struct(*KEY)


def _literal(rows: DataFrame, key: tuple) -> F.Column:
    return F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(KEY, key)])


def block_median(keys: pa.Table) -> tuple:
    """The lower median of the keys."""
    order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in KEY])
    row = keys.slice(order[(len(order) - 1) // 2].as_py(), 1).to_pylist()[0]
    return tuple(row[c] for c in KEY)


def weighted_median(medians: list[tuple[tuple, int]]) -> tuple:
    """The key at which the weights of smaller or equal ones first reach half of all."""
    total, up = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        up += n
        if 2 * up >= total:
            return key
    raise ValueError("no keys")


def side_medians(batches: Iterator[pa.RecordBatch], block: int = BLOCK_KEYS) -> Iterator[pa.RecordBatch]:
    """For keys on each side of the pivot (column ``side``) the task's median, and how many keys it stands for. At most one block a side is in memory."""
    held: dict[int, list[pa.RecordBatch]] = {-1: [], 1: []}
    rows: dict[int, int] = {-1: 0, 1: 0}
    found: dict[int, list[tuple[tuple, int]]] = {-1: [], 1: []}
    schema = None

    def close(side):
        table = pa.Table.from_batches(held[side])
        found[side].append((block_median(table), len(table)))
        held[side], rows[side] = [], 0

    for batch in batches:
        schema = batch.schema
        for side in held:
            part = batch.filter(pc.equal(batch.column("side"), side))
            if len(part):
                held[side].append(part.select(list(KEY)))
                rows[side] += len(part)
                if rows[side] >= block:
                    close(side)
    for side in held:
        if rows[side]:
            close(side)
        if found[side]:
            key, n = weighted_median(found[side]), sum(n for _, n in found[side])
            yield pa.RecordBatch.from_arrays([*[pa.array([v], schema.field(c).type) for c, v in zip(KEY, key)], pa.array([side], pa.int32()), pa.array([n], pa.int64())], [*KEY, "side", "n"])


def cutoff(keys: DataFrame, take: int, finish: int = FINISH) -> tuple | None:
    """The ``take``-th smallest key (all differ); None if ``take`` is 0. ``keys`` is a stored table that has at least as many rows."""
    if take <= 0:
        return None
    schema = ", ".join(f"{c} {keys.schema[c].dataType.simpleString()}" for c in KEY) + ", side int, n long"
    low = high = pivot = None
    while True:
        open_ = keys.select(*KEY)
        if low is not None:
            open_ = open_.filter((F.col("k_score") >= low[0]) & (_key_struct() > _literal(keys, low)))  # the first part reaches the scan
        if high is not None:
            open_ = open_.filter((F.col("k_score") <= high[0]) & (_key_struct() < _literal(keys, high)))
        at = _literal(keys, pivot) if pivot is not None else None
        side = F.lit(1) if at is None else F.when(_key_struct() < at, -1).when(_key_struct() > at, 1).otherwise(0)
        medians = [(tuple(r[c] for c in KEY), r["side"], r["n"]) for r in open_.withColumn("side", side.cast("int")).mapInArrow(side_medians, schema).collect()]
        below = sum(n for *_, s, n in medians if s < 0)
        if pivot is not None and take == below + 1:
            return pivot
        if pivot is not None and take > below:
            low, take, way = pivot, take - below - 1, 1
        elif pivot is not None:
            high, way = pivot, -1
        else:
            way = 1
        left = [(key, n) for key, s, n in medians if s == way]
        if sum(n for _, n in left) <= finish:
            break
        pivot = weighted_median(left)
    if low is not None:
        keys = keys.filter((F.col("k_score") >= low[0]) & (_key_struct() > _literal(keys, low)))
    if high is not None:
        keys = keys.filter((F.col("k_score") <= high[0]) & (_key_struct() < _literal(keys, high)))
    return sorted(tuple(r) for r in keys.select(*KEY).collect())[take - 1]  # at most ``finish`` rows


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, finish: int = FINISH) -> DataFrame:
    """One row for each document: doc_id, n_words, n_features, weight, score and rank, which is null if the document isn't drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down: the highest
    scores, ties to the smaller doc_id, then to fewer features; rows that are equal in all of these are interchangeable. A
    null doc_id comes after all others and has the noise of an empty key. A null or empty text has no features and
    weight 0. Repeated rows each count. Other columns are not looked at, whatever their names. Without documents there
    are no rows; without target texts all gains speak of the corpus alone.
    """
    rows = stored(with_key(scored(docs, target, doc_id, text, target_text, longest, buckets, seed)), "resampling-scores")
    fit = rows.filter(F.col("n_words") >= least_words)
    take = percent * fit.count() // 100
    last = cutoff(fit, take, finish)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (_key_struct() <= _literal(rows, last))
    won = ordered_position(rows.filter(drawn), KEY[0], KEY[1:], name="position")
    rest = rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return won.select(*out, (F.col("position") + 1).cast("long").alias("rank")).unionByName(rest)
