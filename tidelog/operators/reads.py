"""Reads of the live view. Key predicates go below the fold, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import live

#: Bytes of request keys that may be broadcast, and what a key costs besides its own.
BROADCAST_BYTES, KEY_BYTES = 32 << 20, 64


class Unsupported(ValueError):
    """The operation does not exist in this mode."""


def get(log: DataFrame, key: str, as_of_ms: int) -> DataFrame:
    return live(log.where(F.col("key") == key), as_of_ms)


def span(log: DataFrame, start: str, end: str, as_of_ms: int, mode: str = "sorted") -> DataFrame:
    """Keys from start to end, both included, in order; none if start > end."""
    if mode == "hash":
        raise Unsupported("RANGE is not supported in hash mode")
    return live(log.where(F.col("key").between(start, end)), as_of_ms).orderBy("key")


def prefix(log: DataFrame, start: str, as_of_ms: int) -> DataFrame:
    return live(log.where(F.col("key").startswith(start)), as_of_ms)


def keys(log: DataFrame, as_of_ms: int) -> DataFrame:
    """LIST: live keys; values are not read."""
    return live(log, as_of_ms, values=False).select("key")


def asked(log: DataFrame, probes: DataFrame) -> DataFrame:
    """The part of the log that can answer probes; a semi join, by broadcast if the probes' keys are measured to be small."""
    wanted = probes.select("key").distinct()
    size = probes.agg(F.sum(F.coalesce(F.octet_length("key"), F.lit(0)) + KEY_BYTES)).first()[0] or 0
    return log.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "key", "left_semi")


def mget(log: DataFrame, probes: DataFrame, as_of_ms: int) -> DataFrame:
    """pos, key, value for each requested (pos, key), repeated keys too; value and found tell a missing key."""
    view = live(asked(log, probes), as_of_ms).select("key", "value", F.lit(True).alias("found"))
    return probes.select("pos", "key").join(view, "key", "left").select("pos", "key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def exists(log: DataFrame, probes: DataFrame, as_of_ms: int) -> DataFrame:
    return probes.join(keys(asked(log, probes), as_of_ms), "key", "left_semi")


def missing(log: DataFrame, probes: DataFrame, as_of_ms: int) -> DataFrame:
    return probes.join(keys(asked(log, probes), as_of_ms), "key", "left_anti")


def page(log: DataFrame, after: str | None, count: int, as_of_ms: int) -> DataFrame:
    """SCAN: the next keys after a cursor, in order."""
    rows = log if after is None else log.where(F.col("key") > after)
    return live(rows, as_of_ms).orderBy("key").limit(count)


def first_last(log: DataFrame, as_of_ms: int) -> DataFrame:
    view = live(log, as_of_ms)
    return view.agg(F.min("key").alias("first_key"), F.min_by("value", "key").alias("first_value"), F.max("key").alias("last_key"), F.max_by("value", "key").alias("last_value"))


def totals(view: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value).try_cast("double")
    return view.agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def remaining(log: DataFrame, as_of_ms: int) -> DataFrame:
    """PTTL: milliseconds left, -1 without expiry."""
    return live(log, as_of_ms, values=False).select("key", F.coalesce(F.col("expiry_ms") - as_of_ms, F.lit(-1)).alias("pttl_ms"))


def wire_pairs(found: DataFrame) -> DataFrame:
    r"""MGET's answer as one flat list in request order; a missing value is the one-byte string "\0", only here."""
    pairs = found.groupBy().agg(F.sort_array(F.collect_list(F.struct("pos", "key", F.when(F.col("found"), F.col("value").cast("string")).otherwise(F.lit("\0")).alias("v")))).alias("p"))
    return pairs.select(F.flatten(F.transform("p", lambda x: F.array(x["key"], x["v"]))).alias("payload"))
