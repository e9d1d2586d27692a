"""Bootstrap replicas without copies of rows.

A replica's weights are Poisson draws from a hash of a key and the replica's number, the same on every retry. They are
made where the rows (or sums over blocks of rows) already lie, as a matrix of rows x replicas, and used up in one product.
"""

from __future__ import annotations

import numpy as np

#: The distribution function of Poisson(1) up to 6.
CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
UNIT = 1_000_003
U64 = np.uint64
PRIMES = tuple(map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))


def hash_int(numbers: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 32-bit integers, each under each seed: a matrix of seeds x numbers.

    With the hash of a row's key as the seed it is ``xxhash64(key.., number)``.
    """
    p1, p2, p3 = PRIMES
    h = seeds.view(np.uint64)[:, None] + U64(0x27D4EB2F165667C5) + U64(4)
    h = h ^ (numbers.astype(np.uint32).astype(np.uint64) * p1)[None, :]
    h = ((h << U64(23)) | (h >> U64(41))) * p2 + p3
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    h ^= h >> U64(32)
    return h.view(np.int64)


def poisson(keys: np.ndarray, replicas: int) -> np.ndarray:
    """Weights of rows with these key hashes (64-bit) in each replica: rows x replicas."""
    at = (np.arange(UNIT) / UNIT)  # how the share of a unit is rounded must not depend on where it is worked out
    weight = np.searchsorted(np.array(CUTS), at, side="right").astype(np.uint8)
    return weight[hash_int(np.arange(replicas), np.ascontiguousarray(keys)) % UNIT]


def weighted_sums(keys: np.ndarray, values: np.ndarray, replicas: int, rows: int = 4096) -> np.ndarray:
    """For each replica the weighted sums of the columns of ``values``, a matrix of replicas x columns; made in blocks of rows."""
    out = np.zeros((replicas, values.shape[1]))
    for i in range(0, len(keys), rows):
        out += poisson(keys[i : i + rows], replicas).T.astype(float) @ values[i : i + rows]
    return out
