"""Placement on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def digits(text: str, start: int) -> int:
    """15 hexadecimal digits of the MD5 of a text, from digit `start` (from 0)."""
    return int(hashlib.md5(text.encode()).hexdigest()[start : start + 15], 16)


def fill(shards: Sequence[str], size: int) -> list[int]:
    """The shard of every slot. Shards take turns; each claims the first free slot of its own permutation
    (offset + j x skip) mod size, which visits all slots since size is prime."""
    if not shards or len(set(shards)) < len(shards) or size < len(shards) or next_prime(size) != size:
        raise ValueError("shards must be named, distinct and no more than a prime number of slots")
    step = [digits(s, 15) % (size - 1) + 1 for s in shards]
    at = [digits(s, 0) % size for s in shards]
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, shards: Sequence[str], slots_per_shard: int = 100) -> DataFrame:
    """(slot, shard): as many rows as the least prime of at least slots_per_shard slots for each shard."""
    table = fill(shards, next_prime(slots_per_shard * len(shards)))
    listed = F.split(F.lit(",".join(map(str, table))), ",")
    named = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "k")).select("slot", F.element_at(named, F.col("k").cast("int") + 1).alias("shard"))


def slot(key: Column, size: int) -> Column:
    """The slot of a key: its MD5's first 15 digits modulo the table size; a null key counts as empty text."""
    md5 = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(md5, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots_per_shard: int = 100) -> DataFrame:
    """df with its `slot` and `shard` added by a broadcast lookup, without a shuffle.

    The table's size follows from the parameters alone. Equal keys get equal places; a null key has the
    place of the empty text; an empty table stays empty. Columns of df named slot or shard give way to the new ones.
    """
    size = next_prime(slots_per_shard * len(shards))
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*others, slot(F.col(f"`{key}`"), size).alias("slot"))
    table = F.broadcast(lookup_table(df.sparkSession, shards, slots_per_shard))
    return placed.join(table, "slot").select(*others, "slot", "shard")
