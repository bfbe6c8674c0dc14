"""The live view: the newest mutation of each key, without deleted and expired keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import unexpired


def newest(log: DataFrame, *columns: str) -> DataFrame:
    """key, seq and the named columns of each key's newest mutation.

    max_by combines on the map side, so a hot key costs a row per task. Only predicates on key (and on seq, for a
    snapshot) may go below this; on values, tombstones or expiries they would bring older versions back.
    """
    return log.groupBy("key").agg(F.max_by(F.struct("seq", *columns), "seq").alias("last")).select("key", "last.*")


def live(log: DataFrame, as_of_ms: Column | int, as_of_seq: int | None = None, values: bool = True) -> DataFrame:
    """key, value (if asked for) and expiry_ms at an instant, or at a place in the log."""
    if as_of_seq is not None:
        log = log.where(F.col("seq") <= as_of_seq)
    columns = ["value"] if values else []
    last = newest(log, *columns, "tombstone", "expiry_ms")
    return last.where(~F.col("tombstone") & unexpired(F.col("expiry_ms"), as_of_ms)).select("key", *columns, "expiry_ms")


def last_instant(log: DataFrame) -> int:
    """The log's own clock: its largest ts_ms; 0 for an empty log."""
    return log.agg(F.max("ts_ms")).first()[0] or 0


def kept_expiry(log: DataFrame) -> DataFrame:
    """newest(), but a write without an expiry keeps the one that its key had (KEEPTTL), if the key still lived.

    ts_ms must not fall as seq rises: then the last expiry that was set after the last delete holds if it outlasts the
    newest write. One aggregation, combined on the map side.
    """
    sets = ~F.col("tombstone") & F.col("expiry_ms").isNotNull()
    folded = log.groupBy("key").agg(
        F.max_by(F.struct("seq", "ts_ms", "value", "tombstone"), "seq").alias("last"),
        F.max(F.when(F.col("tombstone"), F.col("seq"))).alias("cut"),
        F.max_by(F.struct("seq", "expiry_ms"), F.when(sets, F.col("seq"))).alias("kept"),
    )
    holds = (F.coalesce(F.col("kept.seq") > F.col("cut"), F.lit(True))) & (F.col("kept.expiry_ms") > F.col("last.ts_ms"))
    return folded.select("key", "last.*", F.when(holds, F.col("kept.expiry_ms")).alias("expiry_ms"))
