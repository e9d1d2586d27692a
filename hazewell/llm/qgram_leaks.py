"""Benchmark decontamination by q-gram counting and banded alignment.

Texts and items are folded to lower-case letters and digits with single spaces. An item of m characters occurs with at
most k edits only where its diagonal band shares at least m + 1 - q (k + 1) q-grams with the text. Shared q-grams are
counted in overlapping bands of diagonals; bands that meet the bound are aligned, inside the band only.

Parts of an item count too: overlapping windows of a long item are searched like items, each with its own k and bound, and
a run of shared q-grams on one diagonal is a passage quoted word for word. Short items are matched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.llm.words import U64, mix, pieces

Q = 8
#: Edits for each character of an item.
BUDGET = 0.1
#: Folded items of fewer characters are too short to tell an edited copy from chance; they match exactly, as whole words.
MIN_CHARS = 30
#: A quoted passage of so many folded characters is a leak, whatever the rest of its item.
QUOTE = 50
#: Longer items are also searched by windows of so many characters, one begun each half of a window.
REGION = 256
#: Characters of benchmark items sent to the executors at once; a larger benchmark is worked off in blocks.
BLOCK_CHARS = 8_000_000

_BASE = U64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 22
_WORD = np.ones(0x3100, dtype=bool)
_WORD[:128] = False
_WORD[[*range(48, 58), *range(97, 123)]] = True
_WORD[0x80:0xC0] = False
_WORD[[0xAA, 0xB5, 0xBA]] = True
_WORD[[0xD7, 0xF7]] = False
_WORD[0x2000:0x2070] = False
_WORD[0x3000:0x3040] = False


class Folded(NamedTuple):
    code: np.ndarray  # folded characters of all texts, each text ended by one space
    place: np.ndarray  # their places in the own text
    at: np.ndarray  # where each text starts, with one more end


def fold(texts: list[str]) -> Folded:
    """Lower-case letters and digits; each run of other characters is one space; no space at a text's start."""
    low = [(t or "").lower() for t in texts]
    low = [x if len(x) == len(t or "") else "".join(c.lower()[:1] for c in t) for x, t in zip(low, texts)]
    size = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
    first = np.concatenate(([0], np.cumsum(size)))
    code = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if low else np.zeros(0, np.uint32)
    word = _WORD[np.minimum(code, 0x30FF)]
    keep = word.copy()
    keep[1:] |= word[:-1]
    place = np.flatnonzero(keep)
    at = np.searchsorted(place, first, side="left")
    return Folded(np.where(word[place], code[place], 32).astype(np.uint32), place - np.repeat(first[:-1], np.diff(at)), at)


def qgrams(code: np.ndarray, at: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all q-grams by start, and whether each lies in one text."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    part, width, total, done = code.astype(np.uint64), 1, None, 0
    while True:  # by doubling: a gram of 2w characters is two of w
        if q & width:
            head = part[: len(code) - width + 1]
            total = head if total is None else total[: len(code) - done - width + 1] * U64(pow(int(_BASE), width, 2**64)) + head[done : len(code) - width + 1]
            done += width
        if done == q:
            break
        part = part[:-width] * U64(pow(int(_BASE), width, 2**64)) + part[width:]
        width *= 2
    inside = np.ones(n, dtype=bool)
    for back in range(1, q):
        cut = at[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return total, inside


def trimmed_code(code: np.ndarray) -> np.ndarray:
    return code[:-1] if len(code) and code[-1] == 32 else code


class Short:
    """Items matched exactly, one sorted table of numbers for each length."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.tables = {}
        for size in sorted({len(c) for _, c in items}):
            same = [(n, c) for n, c in items if len(c) == size]
            numbers = np.array([qgrams(c, np.array([0, size]), size)[0][0] for _, c in same], dtype=np.uint64)
            order = np.argsort(numbers, kind="stable")
            self.tables[size] = (numbers[order], [same[i] for i in order.tolist()])

    def found(self, folded: Folded) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first, end) in folded characters. An item begins and ends where a word does; scripts written
        without spaces have no such places, and need none."""
        for size, (numbers, items) in self.tables.items():
            grams, inside = qgrams(folded.code, folded.at, size)
            at = np.minimum(np.searchsorted(numbers, grams), len(numbers) - 1)
            for i in np.flatnonzero((numbers[at] == grams) & inside).tolist():
                before, after = (folded.code[i - 1] if i else 32), folded.code[i + size]
                t = int(np.searchsorted(folded.at, i, side="right")) - 1
                if i > folded.at[t] and before != 32 and before < 0x2E80 and folded.code[i] < 0x2E80 or after != 32 and after < 0x2E80 and folded.code[i + size - 1] < 0x2E80:
                    continue
                for k in range(int(at[i]), len(numbers)):
                    if numbers[k] != grams[i]:
                        break
                    if np.array_equal(items[k][1], folded.code[i : i + size]):
                        yield t, items[k][0], i, i + size


class Items:
    """The searched side: q-gram postings of all items and the bounds of each."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, budget: float = BUDGET, min_chars: int = MIN_CHARS):
        folded = fold(texts)
        whole = [(i, trimmed_code(folded.code[a : b - 1])) for i, a, b in zip(ids, folded.at[:-1], folded.at[1:])]
        long = [(n, c) for n, (_, c) in enumerate(whole) if len(c) >= max(q, min_chars)]
        # windows end where their item ends; an item's own entry comes first
        parts = [(n, c[a : a + REGION]) for n, c in long if len(c) > REGION for a in sorted({*range(0, len(c) - REGION, REGION // 2), len(c) - REGION})]
        self.short = Short([(n, c) for n, (_, c) in enumerate(whole) if 0 < len(c) < max(q, min_chars)])
        kept = long + parts
        self.q, self.ids, self.codes, self.whole = q, [i for i, _ in whole], [c for _, c in kept], len(long)
        self.origin = np.array([n for n, _ in kept], dtype=np.int64)
        size = np.array([len(c) for c in self.codes], dtype=np.int64)
        # as many edits as the budget allows and the bound can still see
        self.k = np.minimum((size * budget).astype(np.int64), np.maximum(0, size // q - 1))
        self.need = np.maximum(1, size + 1 - q * (self.k + 1))
        numbers, item, spot = [], [], []
        for n, c in enumerate(self.codes):
            g, _ = qgrams(c, np.array([0, len(c)]), q)
            numbers.append(g)
            item.append(np.full(len(g), n, dtype=np.int64))
            spot.append(np.arange(len(g), dtype=np.int64))
        if not numbers:
            self.number = np.zeros(0, np.uint64)
            return
        g, item, spot = np.concatenate(numbers), np.concatenate(item), np.concatenate(spot)
        order = np.argsort(g, kind="stable")
        self.item, self.spot = item[order], spot[order]
        self.number, self.first, self.many = np.unique(g[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        self.sieve[mix(self.number) >> U64(64 - _SIEVE_BITS)] = True


def align(code: np.ndarray, items: list[np.ndarray], begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """For each candidate the least edits that turn its item into a part of code[begin:end] on diagonals low..high (place
    in the text less place in the item), and that part's first place and end. All candidates go side by side, one
    character of the items at a time. Ties: the earliest start, then the earliest end."""
    one, far = 1 << 40, 1 << 60
    size, length = np.array([len(x) for x in items]), (end - begin)[:, None]
    diagonal = low[:, None] + np.arange(int((high - low).max()) + 1, dtype=np.int64)
    inside = diagonal <= high[:, None]
    ramp = np.arange(diagonal.shape[1], dtype=np.int64) * one
    letters = np.zeros((len(items), size.max()), dtype=np.uint32)
    for n, x in enumerate(items):
        letters[n, : len(x)] = x
    now = np.where(inside & (diagonal >= 0) & (diagonal <= length), diagonal, far)
    skip = np.full_like(now, far)
    out: list = [None] * len(items)
    for i in range(1, letters.shape[1] + 1):
        j = diagonal + i
        ok = inside & (j >= 0) & (j <= length)
        same = code[np.minimum(np.maximum(j + (begin[:, None] - 1), 0), len(code) - 1)] == letters[:, i - 1 : i]
        step = np.where(j >= 1, now + np.where(same, 0, one), far)
        skip[:, :-1] = now[:, 1:] + one
        now = np.where(ok, np.minimum(np.minimum(step, skip), far), far)
        now = np.where(ok, np.minimum.accumulate(now - ramp, axis=1) + ramp, far)
        for n in np.flatnonzero(size == i):
            best = int(np.argmin(now[n]))
            edits, start = divmod(int(now[n, best]), one)
            out[n] = (edits, start, int(diagonal[n, best]) + i)
    return out


def search(items: Items, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first, end, edits): for each text and item the best occurrence within the item's budget, in characters of the text."""
    if not texts:
        return []
    folded = fold(texts)
    # an item's best match: of the whole item, then of a window, then a quoted passage
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}

    def note(t: int, n: int, rank: int, edits: int, begin: int, end: int) -> None:
        found = (rank, edits, int(folded.place[begin]), int(folded.place[end - 1]) + 1)
        best[t, n] = min(best.get((t, n), found), found)

    for t, n, begin, end in items.short.found(folded):
        note(t, n, 0, 0, begin, end)
    _search_long(items, folded, len(texts), note)
    return [(t, items.ids[n], first, end, edits) for (t, n), (_, edits, first, end) in sorted(best.items())]


def _search_long(items: Items, folded: Folded, n_texts: int, note) -> None:
    if not len(items.number):
        return
    grams, inside = qgrams(folded.code, folded.at, items.q)
    if not len(grams):
        return
    hits = np.flatnonzero(items.sieve[mix(grams) >> U64(64 - _SIEVE_BITS)] & inside)
    known = np.searchsorted(items.number, grams[hits])
    known[known == len(items.number)] = 0
    same = items.number[known] == grams[hits]
    hits, known = hits[same], known[same]
    if not len(hits):
        return
    many = items.many[known]
    posting = np.arange(many.sum(), dtype=np.int64) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.first[known], many)
    item, diagonal = items.item[posting], np.repeat(hits, many) - items.spot[posting]
    # runs of q-grams on one diagonal, in the items' own entries: a passage of QUOTE characters has QUOTE - q + 1 of them
    run = max(1, QUOTE - items.q + 1)
    own, place = item < items.whole, np.repeat(hits, many)
    reach = len(folded.code) + max(len(c) for c in items.codes)
    line = item[own] * (2 * reach + 2) + diagonal[own] + reach
    order = np.lexsort((place[own], line))
    line, at, which = line[order], place[own][order], item[own][order]
    for i in np.flatnonzero((line[run - 1 :] == line[: len(line) - run + 1]) & (at[run - 1 :] == at[: len(at) - run + 1] + run - 1)).tolist() if len(line) >= run else ():
        note(int(np.searchsorted(folded.at, at[i], side="right")) - 1, int(items.origin[which[i]]), 2, 0, int(at[i]), int(at[i]) + QUOTE)
    # fine bins of k + 1 diagonals; two neighbours are a band, and bands overlap by one bin
    width = items.k[item] + 1
    shift = int(max(items.k, default=0)) + max((len(c) for c in items.codes), default=0) + 2
    key = item * (len(folded.code) + 4 * shift) + (diagonal + 2 * shift) // width
    key, count = np.unique(key, return_counts=True)
    follows = np.append(key[1:] == key[:-1] + 1, False)
    both = count + np.where(follows, np.append(count[1:], 0), 0)
    span = len(folded.code) + 4 * shift
    chosen = np.flatnonzero(both >= items.need[key // span])
    todo = []
    for x in chosen.tolist():
        n, b = divmod(int(key[x]), span)
        k, m = int(items.k[n]), len(items.codes[n])
        low = b * (k + 1) - 2 * shift
        # texts that the band's cells touch: one, or neighbours where the band lies over an edge
        t0 = max(0, int(np.searchsorted(folded.at, low, side="right")) - 1)
        t1 = int(np.searchsorted(folded.at, low + 2 * (k + 1) + m, side="left"))
        for t in range(t0, min(t1, n_texts)):
            a, z = max(int(folded.at[t]), low - k), min(int(folded.at[t + 1]), low + 3 * k + 2 + m)
            if z - a >= m - k:
                todo.append((m, t, n, a, z, low - k - a, low + 3 * k + 2 - a))
    todo.sort()
    for c in range(0, len(todo), 256):
        _, text, item, a, z, low, high = (np.array(v, dtype=np.int64) for v in zip(*todo[c : c + 256]))
        for t, n, begin, (edits, i, j) in zip(text.tolist(), item.tolist(), a.tolist(), align(folded.code, [items.codes[n] for n in item], a, z, low, high)):
            if edits <= items.k[n] and j > i:
                note(t, int(items.origin[n]), int(n >= items.whole), edits, begin + i, begin + j)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, most_chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list]]:
    """The benchmark's items in blocks of bounded size, by a hash of id and text."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.length("t") + F.lit(32))).first()[0] or 0
    n = max(1, -(-2 * total // most_chars)) if total > most_chars else 1
    for b in range(n):
        block = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield [r["i"] for r in block], [r["t"] for r in block]


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, budget: float = BUDGET, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (doc_id, item_id, first, end, edits) for each document and item that leaks into it; first and end are places in its text.

    An item leaks where all of it, or a window of ``REGION`` characters, occurs within the edit budget, or ``QUOTE``
    characters of it word for word; edits are those of the part that was found, which is the whole item where that
    is within its budget, else the window, else the first passage of ``QUOTE`` characters. Items of fewer than ``min_chars`` folded characters
    match exactly, as whole words. Null or empty texts and items match nothing. Repeated documents and
    items are reported each for itself; a null doc_id or item_id stays null. An empty table on either side gives an empty
    result. No row is shuffled: whole texts pass the searched items, batch by batch.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    for ids, texts in item_blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(Items(ids, texts, q, budget, min_chars))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for whole in batches:
                for batch in pieces(whole, "text"):
                    found = search(items, batch.column(1).to_pylist())
                    own = batch.column(0)
                    cols = list(zip(*found)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(cols[0], pa.int64())).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols[1:], list(schema)[1:]))], schema=schema)

        part = rows.mapInArrow(look, "doc_id long, item_id long, first long, end long, edits int")
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, budget: float = BUDGET, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents in which no item occurs, with their own columns, whatever these are called."""
    for ids, texts in item_blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, q, budget, min_chars))

        def drop(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for whole in batches:
                for batch in pieces(whole, text):
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[[t for t, *_ in search(items, batch.column(batch.schema.get_field_index(text)).to_pylist())]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(drop, docs.schema)
    return docs
