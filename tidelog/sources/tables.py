"""Logs over the driver's tables. Each has a unique seq that is part of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import epoch_ms, expiry_of

COMMAND = {"purchase": "WRITE", "signup": "WRITETTL", "error": "DELETE", "click": "TTL", "view": "READ"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(user: str) -> F.Column:
    return F.concat(F.lit("user:"), F.lpad(F.col(user).cast("string"), 8, "0"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_ms, op, key, value, ttl_s from events: purchases write, signups write for a time, errors delete, clicks set expiry, views read."""
    kind, op = F.col("event_type"), F.lit(None).cast("string")
    for name, verb in COMMAND.items():
        op = F.when(kind == name, verb).otherwise(op)
    ttl = F.when(kind == "signup", (1 + F.col("event_id") % 48) * 3600).when(kind == "click", (F.col("event_id") % 4) * 21600)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), epoch_ms("ts").alias("ts_ms"), op.alias("op"), user_key("user_id").alias("key"), F.when(kind.isin("purchase", "signup"), F.col("value")).alias("value"), ttl.alias("ttl_s"))


def mutations(spark: SparkSession, sf_dir: str, ttl: bool = False) -> DataFrame:
    """A key for each user and event type; every seventh event deletes; with ttl every third expires after 1 to 72 hours."""
    e, seq = table(spark, sf_dir, "events"), F.col("event_id")
    ts = epoch_ms("ts")
    hours = F.when(seq % 3 == 0, (1 + seq % 72) * 3600)
    return e.select(seq.alias("seq"), ts.alias("ts_ms"), F.concat(user_key("user_id"), F.lit(":"), "event_type").alias("key"), "value", (seq % 7 == 3).alias("tombstone"), (expiry_of(ts, hours) if ttl else F.lit(None).cast("long")).alias("expiry_ms"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("cust:"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return o.select(F.col("o_orderkey").alias("seq"), F.lit(0).cast("long").alias("ts_ms"), key.alias("key"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 7 == 3).alias("tombstone"), F.lit(None).cast("long").alias("expiry_ms"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.concat("event_type", F.lit(":"), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit(":"), F.lpad(epoch_ms("ts").cast("string"), 13, "0"))
    return e.select(F.col("event_id").alias("seq"), epoch_ms("ts").alias("ts_ms"), key.alias("key"), "value", F.lit(False).alias("tombstone"), F.lit(None).cast("long").alias("expiry_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("conv:"), F.lpad(F.col("conv_id").cast("string"), 8, "0"))
    return c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("seq"), F.lit(0).cast("long").alias("ts_ms"), key.alias("key"), F.col("text").alias("value"), F.lit(False).alias("tombstone"), F.lit(None).cast("long").alias("expiry_ms"))


def probe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, key: every customer's key, half of them out of range."""
    c = table(spark, sf_dir, "customer")
    shifted = F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 10_000_000).otherwise(0)
    return c.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("cust:"), F.lpad(shifted.cast("string"), 8, "0")).alias("key"))
