"""Status and answer of every command of a log, in one pass per key.

ts_ms must not fall as seq rises. An epoch of a key begins with a write; a delete belongs to the epoch that it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import expiry_of
from ..model import CODES, OPS
from .fold import newest

WRITES, KEYED = ("WRITE", "WRITETTL"), ("WRITE", "WRITETTL", "DELETE", "TTL", "READ", "EXISTS")


def replay(commands: DataFrame, *order: str) -> DataFrame:
    """commands with status, payload, and expired: the key was written, but its time had passed. order: columns after seq that tell items of one command apart.

    One shuffle, by key; both windows use it. A status needs its key's whole past, so one key's commands meet in one task.
    """
    by = ["seq", *order]
    is_write, op = F.col("op").isin(*WRITES), F.col("op")
    before = Window.partitionBy("key").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    c = commands.withColumn("new_exp", F.when(op.isin("WRITETTL", "TTL"), expiry_of(F.col("ts_ms"), F.col("ttl_s"))))
    c = c.withColumn("epoch", F.coalesce(F.sum(op.isin(*WRITES, "DELETE").cast("int")).over(before), F.lit(0)) + is_write.cast("int"))
    whole = Window.partitionBy("key", "epoch").orderBy(*by)
    past, so_far = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({
        "head": F.first("op").over(so_far), "head_val": F.first("value").over(so_far),
        "prev": F.last(F.when(op.isin(*WRITES, "TTL"), F.struct("new_exp")), ignorenulls=True).over(past),
    })
    fails = ~is_write & F.coalesce(F.col("prev.new_exp") <= F.col("ts_ms"), F.lit(False))
    alive = F.coalesce(F.col("head").isin(*WRITES), F.lit(False)) & (F.max(fails.cast("int")).over(so_far) == 0)
    c = c.withColumn("alive", alive)
    status = F.when(~op.isin(*OPS) | op.isNull(), "ERROR").when(is_write | ~op.isin(*KEYED), "OK").when(F.col("alive"), "OK").otherwise("NOT_FOUND")
    return c.withColumn("status", status).withColumn("payload", F.when((op == "READ") & F.col("alive"), F.col("head_val"))).withColumn("expired", op.isin(*KEYED) & ~is_write & F.coalesce(F.col("head").isin(*WRITES), F.lit(False)) & ~F.col("alive")).drop("new_exp", "epoch", "head", "head_val", "prev", "alive")


def applied(commands: DataFrame, *order: str) -> DataFrame:
    """The mutations that a command log leaves: writes and deletes as they are, TTLs that found their key with its value."""
    known = Window.partitionBy("key").orderBy("seq", *order).rowsBetween(Window.unboundedPreceding, -1)
    done = replay(commands, *order).withColumn("held", F.last(F.when(F.col("op").isin(*WRITES), F.struct("value")), ignorenulls=True).over(known))
    changes = done.where(F.col("op").isin(*WRITES, "DELETE") | ((F.col("op") == "TTL") & (F.col("status") == "OK")))
    if order:  # of a command's items for one key the last stands
        columns = [c for c in changes.columns if c not in ("seq", "key")]
        changes = changes.groupBy("seq", "key").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select("seq", "key", "x.*")
    return changes.select("seq", "ts_ms", "key", F.when(F.col("op") == "TTL", F.col("held.value")).when(F.col("op") != "DELETE", F.col("value")).alias("value"), (F.col("op") == "DELETE").alias("tombstone"), F.when(F.col("op").isin("WRITETTL", "TTL"), expiry_of(F.col("ts_ms"), F.col("ttl_s"))).alias("expiry_ms"))


def exploded(batches: DataFrame) -> DataFrame:
    """MSET and MGET commands (items: array of key, value, ttl_s) as one command an item; pos orders the items of one seq."""
    each = batches.select("seq", "ts_ms", "op", F.posexplode("items").alias("pos", "item"))
    verb = F.when(F.col("op") == "MGET", "READ").when(F.col("item.ttl_s") > 0, "WRITETTL").otherwise("WRITE")
    return each.select("seq", "pos", "ts_ms", verb.alias("op"), "item.key", "item.value", "item.ttl_s")


def counters(replayed: DataFrame) -> DataFrame:
    """STATS as (name, value) rows."""
    op, missed = F.col("op"), F.col("status") == "NOT_FOUND"
    named = {"reads": op == "READ", "read_misses": (op == "READ") & missed, "writes": op.isin(*WRITES), "writes_with_ttl": op == "WRITETTL", "deletes": op == "DELETE", "delete_misses": (op == "DELETE") & missed, "ttls": op == "TTL", "ttl_misses": (op == "TTL") & missed, "errors": F.col("status") == "ERROR", "commands": F.lit(True)}
    one = replayed.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    return one.select(F.expr(f"stack({len(named)}, {', '.join(f'{n!r}, {n}' for n in named)}) AS (name, value)"))


def expiry_counters(replayed: DataFrame, log: DataFrame, as_of_ms: int) -> DataFrame:
    """(name, value): reads that missed as their key had expired, and records that a full compaction lets go for that reason."""
    read = replayed.agg(F.count_if((F.col("op") == "READ") & F.col("expired")).alias("value")).select(F.lit("expired_reads").alias("name"), "value")
    gone = newest(log, "tombstone", "expiry_ms").where(~F.col("tombstone") & (F.col("expiry_ms") <= as_of_ms))
    return read.unionByName(gone.agg(F.count("*").alias("value")).select(F.lit("expired_compacted").alias("name"), "value"))


def stats(replayed: DataFrame, store: dict[str, int]) -> DataFrame:
    """STATS in full as (name, value) rows: a store's own counters, and the commands. There are no connections to count."""
    op = F.col("op")
    named = {"reads": op == "READ", "writes": op.isin(*WRITES), "deletes": op == "DELETE"}
    counted = replayed.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    fixed = store | {"active_connections": 0}
    every = counted.select(*named, *[F.lit(v).cast("long").alias(n) for n, v in fixed.items()])
    names = [*named, *fixed]
    return every.select(F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) AS (name, value)"))


def running(increments: DataFrame) -> DataFrame:
    """INCR: seq, key, and the counter after each step (by); op RESET sets it to its value."""
    w = Window.partitionBy("key").orderBy("seq")
    epoch = increments.withColumn("epoch", F.sum((F.col("op") == "RESET").cast("int")).over(w))
    return epoch.select("seq", "key", F.sum("by").over(Window.partitionBy("key", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).alias("counter"))


def by_code(code: Column) -> tuple[Column, Column]:
    """Status and payload of a command that is known by its number alone: an unknown number is answered by name."""
    op = F.get(F.array(*map(F.lit, CODES)), (code - 1).cast("int"))
    status = answerable(F.when(code >= 1, op), "sorted")
    return status, F.when(status == "ERROR", F.concat(F.lit("Invalid op code: "), code.cast("string")))


def answerable(op: Column, mode: str) -> Column:
    """OK, or ERROR for what a mode cannot answer: RANGE in hash mode, and unknown commands."""
    known = F.coalesce(op.isin(*OPS), F.lit(False))
    return F.when(~known | (op.eqNullSafe("RANGE") & F.lit(mode == "hash")), "ERROR").otherwise("OK")
