"""Which shard a key belongs to: by rendezvous hashing, or by key ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(key: Column, shards: int) -> Column:
    """The shard whose number hashes highest together with the key. Another shard takes its share of keys and moves no others."""
    scored = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.md5(F.encode(F.concat(key, F.lit("#"), i.cast("string")), "UTF-8")).alias("h"), i.alias("shard")))
    return F.array_max(scored)["shard"]


def by_range(key: Column, edges: Sequence[str]) -> Column:
    """The number of edges that are not after the key: shard 0 ends before the first edge."""
    return F.size(F.filter(F.array(*map(F.lit, sorted(edges))), lambda e: e <= key)) if edges else F.lit(0)


def moved(keys: DataFrame, before: int, after: int) -> DataFrame:
    """key, before and after of the keys that change shards as their number changes."""
    placed = keys.select("key", by_hash(F.col("key"), before).alias("before"), by_hash(F.col("key"), after).alias("after"))
    return placed.where(F.col("before") != F.col("after"))
