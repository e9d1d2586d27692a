"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``t`` of the mix belongs to the source whose share of [0, 1) holds the fractional part of ``t`` golden ratios, so
every stretch of the mix is close to the target weights. Slots are ranked per source, and rank ``r`` takes block ``r`` of
the source: its documents in hashed order, a new order for each pass, laid end to end and cut into blocks of equal
words. Ranks and offsets are sums over buckets of bounded size, so a source with a third of all rows is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazewell.llm.common import MAX_BROADCAST_ROWS, free_name, n_words, small
from hazewell.session import stored

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 64
GOLDEN = 0.6180339887498949
#: Sources are rows of a table that the driver works out targets from.
MAX_SOURCES = 100_000
BUCKET = 20_000


def targets(sizes: list[int], weights: list[float], most_passes: float = MOST_PASSES) -> list[float]:
    """Shares of the total by weight; what exceeds ``most_passes`` times a source's size is shared again among the rest."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        if weight <= 0:
            break
        over = [i for i in free if left * weights[i] / weight >= most_passes * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most_passes * sizes[i])
            free.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def source_targets(sized: DataFrame, weights=WEIGHTS, most_passes: float = MOST_PASSES) -> list[tuple]:
    """(index, source, size, documents, target) by code point of the source, null last; weights repeat along that order."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))  # UTF-8 and code points sort alike
    share = targets([int(r["size"]) for r in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], most_passes)
    return [(i, r["source"], int(r["size"]), int(r["n"]), t) for i, (r, t) in enumerate(zip(rows, share))]


def _running(df: DataFrame, group: list[str], bucket: str, order: list, value, out: str) -> DataFrame:
    """The sum of ``value`` over all earlier rows of the group: inside a bucket by a window, before it by bucket sums."""
    total = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(total, [*group, bucket]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside", bucket)


def schedule(spark, shares: list[tuple], block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix's slots: t, s (index of its source), r (its rank among the source's slots), words that it takes.

    A source's slots beyond its target are left out and its last one is cut to it.
    """
    total = sum(x[4] for x in shares)
    if total <= 0:
        return spark.createDataFrame([], "t long, s int, r long, words long")
    slots = int(-(-total // block_words))
    bounds, up = [], 0.0
    for i, *_, target in shares:
        if target > 0:
            bounds.append((i, up / total, (up + target) / total, int(round(target))))
            up += target
    bounds[-1] = (*bounds[-1][:2], 2.0, bounds[-1][3])
    # a point meets the shares of its own hundredth of [0, 1): a look-up, not a scan of all shares
    cells = spark.createDataFrame([(c, *b) for b in bounds for c in range(int(b[1] * 128), min(127, int(b[2] * 128)) + 1)], "cell int, s int, low double, high double, quota long")
    extra = 2 * len(bounds) + 8
    point = F.col("t") * F.lit(GOLDEN) % F.lit(1.0)
    rows = spark.range(slots + extra).select(F.col("id").alias("t")).withColumn("x", point).withColumn("cell", (F.col("x") * 128).cast("int"))
    rows = rows.join(F.broadcast(cells), "cell").filter("x >= low AND x < high").select("t", "s", "quota", F.floor(F.col("t") / BUCKET).alias("b"))
    rows = _running(rows, ["s"], "b", ["t"], F.lit(1), "r")
    return rows.withColumn("words", F.least(F.lit(block_words), F.col("quota") - F.col("r") * block_words)).filter("words > 0").select("t", "s", "r", "words")


def mix(docs: DataFrame, weights=WEIGHTS, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix as pieces, and the documents with what it takes of each.

    Pieces: t (slot), s, r, row (the document's key), pass, first (the piece's first word in it), words. Documents: one
    row each with row, doc_id, source, size, source_size, target, taken.

    A null text or one without words has size 0 and is never taken. A null source is a source, the last. Rows of equal
    doc_id, source and text share one key and are taken apart by a running number, so repeated rows each count. An empty
    table gives empty results. The order is a hash of the key, so reruns agree.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(doc_id, source, text).alias("key"))
    sized = stored(sized, "mix-sizes")
    shares = source_targets(sized, weights, most_passes)
    table = spark.createDataFrame([(i, src is None, src or "", size, max(1, n // BUCKET), t) for i, src, size, n, t in shares], "s int, no boolean, name string, source_size long, buckets long, target double")
    same = [F.col("source").isNull() == F.col("no"), F.coalesce("source", F.lit("")) == F.col("name")]
    sized = sized.join(F.broadcast(table) if len(shares) <= MAX_BROADCAST_ROWS else table, same).drop("no", "name")
    # equal rows are one entry that holds all their words; copies of it get equal parts below
    one = sized.groupBy("s", "key", "doc_id", "source", "size", "source_size", "buckets", "target").agg(F.count("*").alias("copies"))
    one = stored(one, "mix-rows")
    passes = one.filter("size > 0").withColumn("whole", F.col("size") * F.col("copies"))
    passes = passes.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1))))
    passes = passes.withColumn("h", F.xxhash64("key", "pass")).withColumn("b", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    passes = _running(passes.select("s", "key", "doc_id", "pass", "h", "b", "whole", "source_size"), ["s", "pass"], "b", ["h", "key", "doc_id"], F.col("whole"), "before")
    start = F.col("before") + F.col("pass") * F.col("source_size")
    blocks = passes.select("s", "key", "doc_id", "pass", "whole", start.alias("start")).withColumn("r", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("whole") - 1) / block_words))))
    low, end = F.greatest("start", F.col("r") * block_words), F.least(F.col("start") + F.col("whole"), F.col("r") * block_words + F.col("words"))
    pieces = schedule(spark, shares, block_words).join(blocks, ["s", "r"]).withColumn("first", low - F.col("start")).withColumn("words", end - low).filter("words > 0")
    pieces = pieces.select("t", "s", "r", "key", "doc_id", "pass", "first", "words")
    took = pieces.groupBy(F.col("s").alias("took_s"), F.col("key").alias("took_key"), F.col("doc_id").alias("took_id")).agg(F.sum("words").alias("all"))
    part = F.floor(F.coalesce("all", F.lit(0)) / F.col("copies")) + (F.col("i") <= F.coalesce("all", F.lit(0)) % F.col("copies")).cast("long")
    same = (F.col("s") == F.col("took_s")) & (F.col("key") == F.col("took_key")) & F.col("doc_id").eqNullSafe(F.col("took_id"))
    done = one.join(took, same, "left").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return pieces, done.select("key", "doc_id", "source", "size", "source_size", "target", part.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their own columns: a row for each pass that takes words of them.

    Texts stay whole: a document that is begun is kept to its end.
    """
    _, taken = mix(docs, **options)
    names = {k: options.get(k, k) for k in ("doc_id", "text", "source")}
    key, times = free_name(docs, "mix_key"), free_name(docs, "mix_times")
    # equal rows are interchangeable: those of one key share their passes, as many rows in all as the mix takes of them
    taken = taken.filter("taken > 0").groupBy("key").agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times), F.count("*").alias("n"))
    taken = stored(taken.withColumn(times, F.ceil(F.col(times) / F.col("n")).cast("int")).withColumnRenamed("key", key).drop("n"), "mix-taken")
    rows = docs.withColumn(key, F.xxhash64(names["doc_id"], names["source"], names["text"])).join(small(taken), key)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
