"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size (an offset and a step taken from its
name). Shards take turns; each claims the first slot on its list that is still free, until the table is full. Placement
is one hash and one look-up. Slots differ by at most one between shards of equal weight, and adding or removing a shard
moves few other slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.llm.common import free_name

SHARDS = tuple(f"shard-{i:04d}" for i in range(64))
SLOTS = 65_537
#: The filled table is broadcast: two numbers a slot.
MAX_SLOTS = 4_000_000


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    shards = list(shards)
    if not _prime(slots) or slots > MAX_SLOTS or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}, with between 1 and {slots} shards of different names")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key, slots: int) -> F.Column:
    """60 bits of the key's MD5, modulo the number of slots; a null key counts as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (its name) to each row; columns of those names give way to them.

    Rows with equal keys, nulls among them, share a shard; nothing is shuffled, dropped or merged, and an empty table
    stays empty.
    """
    shards = list(shards)
    rows = df.drop("slot", "shard")
    joined = free_name(rows, "owner_slot")
    owners = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(shards, slots))], f"{joined} int, shard string")
    return rows.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(owners), F.col("slot") == F.col(joined), "left").drop(joined)
