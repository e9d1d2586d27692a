"""Near duplicates by b-bit MinHash: banded candidates, packed low bits for an estimate, full shingle sets for the verdict.

1. Each text becomes a set of word shingles, 128 minima over it, 32 band keys of four minima each, and a signature that
   keeps the low 4 bits of every minimum, 16 to a 64-bit word. Texts with equal sets are one class from here on.
2. Classes that share a band meet there. The estimate corrects the share of equal 4-bit fields, counted in bits, for
   accidental equality. Inside a band only a spanning set of links passes on, never all pairs.
3. Linked candidates form clusters. Each cluster's texts are read once more, and links are decided on the full sets. A
   cluster too large for one task is cut into blocks, and every two blocks meet in a task of their own.

A pair of similarity 0.8 shares no band with a chance of 5e-8, and falls below the estimate's bound (0.8 less six standard
deviations) with one of 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.llm.common import components, free_name, small
from hazewell.llm.words import U64, mix, pieces, word_numbers
from hazewell.session import stored

MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
PER_WORD = 64 // BITS
#: Estimates from here on pass: 0.8 less six standard deviations of 128 fields.
ESTIMATE = 0.58
#: Members of a band that are compared by signature in one task; larger bands link all members to one.
BAND_MEMBERS = 4_096
#: Shingles of a cluster that one task decides on.
BLOCK_SHINGLES = 2_000_000

_RANDOM = np.random.Generator(np.random.PCG64(9))
_A = (_RANDOM.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RANDOM.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]
_WEIGHT = mix(np.arange(1, 65, dtype=np.uint64)) | U64(1)


def shingle_sets(texts, words: int) -> list[np.ndarray]:
    """Each text's set of shingles of ``words`` words as sorted 64-bit numbers; a shorter text is one shingle of all its words."""
    numbers, first = word_numbers(texts)
    if len(numbers) >= words:
        rolled = mix(sum((numbers[i : len(numbers) - words + 1 + i] * _WEIGHT[i] for i in range(words)), U64(0)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((numbers[a:b] * _WEIGHT[: b - a]).sum(dtype=np.uint64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray, block: int = 4_096) -> np.ndarray:
    x = (shingles >> U64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), block):
        np.minimum(low, (_A * x[i : i + block] + _B).min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The low bits of the (scrambled) minima, 16 fields to a word."""
    fields = mix(low.astype(np.uint64)) & U64(2**BITS - 1)
    return (fields.reshape(-1, PER_WORD) << (np.arange(PER_WORD, dtype=np.uint64) * U64(BITS))).sum(axis=1, dtype=np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = low.reshape(BANDS, ROWS).astype(np.uint64) * _WEIGHT[:ROWS]
    return mix(parts.sum(axis=1, dtype=np.uint64) + _WEIGHT[:BANDS])


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated resemblance of a packed signature to others: equal fields less those that would be equal by chance."""
    x = many ^ one
    x |= x >> U64(1)
    x |= x >> U64(2)
    unequal = np.bitwise_count(x & U64(0x1111111111111111)).sum(axis=1)
    chance = 1.0 / 2**BITS
    return (1.0 - unequal / MINIMA - chance) / (1.0 - chance)


def spanning(signatures: np.ndarray, bound: float) -> np.ndarray:
    """For each signature the index of one in the same cluster of estimates at or above the bound: single linkage, one tree each."""
    root = np.full(len(signatures), -1, dtype=np.int64)
    left = np.arange(len(signatures))
    while len(left):
        front, root[left[0]] = [left[0]], left[0]
        top, left = left[0], left[1:]
        while front and len(left):
            near = similarity(signatures[front.pop()], signatures[left]) >= bound
            root[left[near]] = top
            front.extend(left[near].tolist())
            left = left[~near]
    return root


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component of each set in the graph of pairs with 100 * intersection >= percent * union, decided exactly.

    The set whose shingles are the most common is compared with all; after that each set that is not yet linked to it.
    Counting runs over the postings of the compared set's shingles, so pairs without a common shingle cost nothing.
    """
    n = len(sets)
    root = np.arange(n)
    if n < 2:
        return root
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    _, number, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(number, kind="stable")
    posting, first = owner[order], np.cumsum(many) - many
    start = np.cumsum(size) - size
    common = np.add.reduceat(many[number], np.minimum(start, len(number) - 1)) / np.maximum(size, 1)
    hub, done = int(np.argmax(common)), np.zeros(n, dtype=bool)

    def near(i: int) -> np.ndarray:
        own = number[start[i] : start[i] + size[i]]
        length = many[own]
        at = np.repeat(first[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        both = np.bincount(posting[at], minlength=n)
        return np.flatnonzero(both * (100 + percent) >= percent * (size + size[i])) if size[i] else np.zeros(0, np.int64)

    def join(i: int) -> None:
        found = near(i)
        if len(found):
            tops = np.unique(root[np.append(found, i)])
            root[np.isin(root, tops)] = tops[0]
        done[i] = True

    join(hub)
    star = root == root[hub]
    for i in np.flatnonzero(~star).tolist():
        join(i)
    return root


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of a sorted partition, one table for each run of equal values in the first ``keys`` columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            now = tuple(int(c[a]) for c in cols)
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """uid, doc_id, n_shingles, set1, set2 (128 bits that stand for the whole set), sig and bands of each row of uid, doc_id, text."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 2 << 20):
                sets = shingle_sets(batch.column(2), words)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                both = np.array([(s.sum(dtype=np.uint64), mix(s ^ U64(0xA5A5A5A5)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                low = [minima(s) if len(s) else None for s in sets]
                sig = [pack(x).tobytes() if x is not None else None for x in low]
                bands = [band_keys(x).view(np.int64) if x is not None else None for x in low]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return rows.select("uid", "doc_id", "text").mapInArrow(sign, "uid long, doc_id long, n_shingles long, set1 long, set2 long, sig binary, bands array<long>")


def candidates(classes: DataFrame, bound: float = ESTIMATE, members: int = BAND_MEMBERS) -> DataFrame:
    """Links (a, b) between class uids: for each band a spanning set of those whose signatures are near."""
    flat = classes.select("uid", F.posexplode("bands").alias("band", "key"))
    several = stored(flat.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("uid").alias("top")).filter("n > 1"), "bands")
    met = flat.join(several, ["band", "key"])
    large = met.filter(F.col("n") > members).select(F.col("uid").alias("a"), F.col("top").alias("b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, 2):
            uid = rows.column("uid").to_numpy()
            root = spanning(np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint64).reshape(len(uid), -1), bound)
            far = root != np.arange(len(uid))
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[far]), pa.array(uid[root[far]])], schema=schema)

    # signatures join only the few members of bands that several classes share
    few = met.filter(F.col("n") <= members).select("band", "key", "uid").join(classes.select("uid", "sig"), "uid").select("band", "key", "uid", "sig")
    few = few.repartition("band", "key").sortWithinPartitions("band", "key", "uid").mapInArrow(near, "a long, b long")
    return few.unionAll(large).distinct()


def verified(docs: DataFrame, clusters: DataFrame, words: int, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) decided on full sets. ``docs``: uid, text; ``clusters``: uid, root, n_shingles, stored."""
    sizes = clusters.groupBy("root").agg(F.sum("n_shingles").alias("all"), F.max("n_shingles").alias("most"))
    sizes = sizes.select("root", F.greatest(F.lit(1), F.ceil(F.col("all") / F.lit(block))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    tasks = clusters.join(sizes, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("uid", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = docs.join(small(clusters.select("uid")), "uid", "left_semi").dropDuplicates(["uid"]).join(tasks, "uid").select("root", "i", "j", "uid", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _runs(batches, 3):
            uid = part.column("uid").to_numpy()
            sets: list[np.ndarray] = []
            for batch in part.combine_chunks().to_batches():
                for piece in pieces(batch, "text", 2 << 20):
                    sets += shingle_sets(piece.column(4), words)
            root = linked(sets, percent)
            far = root != np.arange(len(uid))
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[far]), pa.array(uid[root[far]])], schema=schema)

    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "uid").mapInArrow(decide, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: uid, doc_id, n_shingles, component_id, kept, first.

    component_id is the smallest doc_id reachable over links (itself included); kept tells whether doc_id is that one;
    first is true for exactly one uid of each component. uid is a hash of doc_id and text: rows that repeat both share
    it. A null or empty text has no shingles, links with nothing and is its own component. A null doc_id counts as larger
    than any other; a component of only such has a null id and is kept. An empty table gives an empty one.
    """
    rows = docs.select(F.xxhash64(doc_id, text).alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stored(signatures(rows, words), "signatures")
    # equal sets are one class, named by its smallest uid; combined before the shuffle, whatever the number of copies
    key = ["set1", "set2", "n_shingles"]
    classes = stored(signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("uid").alias("uid"), F.min_by("sig", "uid").alias("sig"), F.min_by("bands", "uid").alias("bands")), "classes")
    links = components(candidates(classes))
    clusters = stored(links.withColumnRenamed("node", "uid").join(classes.select("uid", "n_shingles"), "uid"), "clusters")
    exact = components(verified(rows.select("uid", "text"), clusters, words, percent))
    # row -> class -> component
    named = classes.select(*key, F.col("uid").alias("class")).join(exact.select(F.col("node").alias("class"), "root"), "class", "left").select(*key, F.coalesce("root", "class").alias("part"))
    lone = signed.filter("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("uid").alias("part"), F.lit(True).alias("lone"))
    found = signed.filter("n_shingles > 0").select("uid", "doc_id", *key).join(named, key).select("uid", "doc_id", "n_shingles", "part", F.lit(False).alias("lone"))
    found = stored(found.unionAll(lone), "parts")
    best = found.groupBy("part", "lone").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("first_uid"))
    out = found.join(best, ["part", "lone"])
    return out.select("uid", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("uid") == F.col("first_uid")).alias("first"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns, one row of each component; rows without words all stay."""
    found = stored(near_duplicates(docs, words, percent, doc_id, text), "near-duplicates")
    uid = free_name(docs, "row_uid")
    each = found.groupBy(F.col("uid").alias(uid)).agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"), F.max((F.col("n_shingles") == 0) | F.col("first")).alias("stays"))
    gone, again = stored(each.filter(~F.col("stays")).select(uid), "gone"), stored(each.filter("stays AND n > 1 AND size > 0").select(uid), "again")
    rows = docs.withColumn(uid, F.xxhash64(doc_id, text)).join(small(gone), uid, "left_anti")
    # rows that repeat both doc_id and text share a uid: one of them stays
    once, twice = rows.join(small(again), uid, "left_anti"), rows.join(small(again), uid, "left_semi").dropDuplicates([uid])
    return once.unionAll(twice).select(*docs.columns)
