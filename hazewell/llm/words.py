"""Words of UTF-8 texts as 64-bit numbers, a few passes of numpy over the bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its number is a polynomial over random 64-bit byte values, mixed
once more; two different words share one with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPAN = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = {"up": _powers(_BASE, 1), "down": _powers(_INVERSE, 1)}


def _at_least(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, max(n, 2 * SPAN)), _powers(_INVERSE, max(n, 2 * SPAN))
    return _POWERS["up"], _POWERS["down"]


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts, with one more end. Null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word, a run of bytes that ``is_word`` marks; no word crosses from one text to the next."""
    n = len(data)
    word = np.concatenate(([False], is_word[data], [False]))
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    inner = word[1:-1]
    starts = np.flatnonzero(inner & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(inner & (~word[2:] | edge[1:])) + 1
    return starts, ends


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The number of each span, worked off in blocks of bounded length; ``lower`` folds A-Z first."""
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + SPAN, side="right")))
        b = int(ends[j - 1])
        up, down = _at_least(b - a)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return mix(out)


def word_numbers(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts in order, and for each text the index of its first word, with one more end."""
    data, at = text_bytes(texts)
    starts, ends = word_spans(data, at)
    return span_numbers(data, starts, ends, lower), np.searchsorted(starts, at, side="left")


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part's texts have at most ``most_bytes`` bytes, or are a single text."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).cast(pa.int64()))
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most_bytes, side="right")))
        yield batch.slice(i, j - i)
        i = j
