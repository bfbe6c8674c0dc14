"""Summaries of latencies and synthetic workloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latency(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, least, mean and largest, and operations per second of a sequential run (value in microseconds)."""
    v = F.col(value)
    return samples.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("high"), F.round(F.count("*") / (F.sum(v) / 1e6), 3).alias("ops_per_s"))


def at_ranks(samples: DataFrame, value: str, places: dict[str, str], *by: str, buckets: int = 256) -> DataFrame:
    """n (samples of a group) and, under the name of each place, the value there in order; a place is SQL over n, from 0.

    Equal values are counted first. Buckets are cut at values picked by hash; their counts tell which bucket of a group
    holds a place, and only the values of that bucket are sorted, so no task sorts a whole group.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    edges = sorted(r[0] for r in counted.select(value).distinct().orderBy(F.xxhash64(value), value).limit(buckets - 1).collect())
    placed = counted.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(value))) if edges else F.lit(0))
    w = Window.partitionBy(*by)
    sums = placed.groupBy(*by, "bucket").agg(F.sum("c").alias("s"))
    sums = sums.withColumns({"n": F.sum("s").over(w), "before": F.coalesce(F.sum("s").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(sql).cast("long").alias("place")) for name, sql in places.items()]))
    wanted = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bucket").alias("_bucket"), "n", "s", "before", each.alias("x")).select("*", "x.name", "x.place").drop("x").where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("s")))
    same = F.col("bucket") == F.col("_bucket")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = placed.join(wanted, same)
    ranked = inside.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "bucket", "name").orderBy(value)))
    found = ranked.where(F.col("upto") > F.col("place")).groupBy(*by, "name").agg(F.min(value).alias("v"), F.first("n").alias("n"))
    return found.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])


def nearest_rank(samples: DataFrame, value: str, percent: int, *by: str) -> DataFrame:
    """The sample at 0-based place min(n * percent div 100, n - 1) in order."""
    return at_ranks(samples, value, {f"p{percent}": f"least(n * {int(percent)} div 100, n - 1)"}, *by)


def quantiles(samples: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Values at shares of a group, between neighbours in proportion."""
    places = {f"{n}_{side}": f"{side}((n - 1) * {q}D)" for n, q in shares.items() for side in ("floor", "ceil")}
    found = at_ranks(samples, value, places, *by)
    at = lambda n: (F.col("n") - 1) * F.lit(shares[n])
    return found.select(*by, *[(F.col(f"{n}_floor") + (F.col(f"{n}_ceil") - F.col(f"{n}_floor")) * (at(n) - F.floor(at(n)))).alias(n) for n in shares])


def misses(replayed: DataFrame, *by: str) -> DataFrame:
    missed = F.count_if(F.col("status") == "NOT_FOUND")
    return replayed.groupBy(*by).agg(F.count("*").alias("n"), missed.alias("misses"), F.round(missed / F.count("*"), 6).alias("ratio"))


def key_windows(keys: DataFrame, width: int, buckets: int = 256) -> DataFrame:
    """First and last key of each full run of width keys in order; the rest is dropped.

    A key's rank is its rank in its bucket of neighbours plus the sizes of the buckets before, so no task sorts all keys:
    buckets are cut at keys picked by hash, and only their counts (at most buckets rows) go through one task.
    """
    edges = sorted(r[0] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(buckets - 1).collect())
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("key"))) if edges else F.lit(0)
    placed = keys.select("key", bucket.alias("bucket"))
    sizes = placed.groupBy("bucket").count()
    before = sizes.select("bucket", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("key"))).join(F.broadcast(before), "bucket")
    block = F.floor((F.col("before") + F.col("r") - 1) / width).cast("long")
    return ranked.groupBy(block.alias("block")).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n")).where(F.col("n") == width).drop("n")


def bench_keys(spark: SparkSession, n: int, n_misses: int = 0) -> DataFrame:
    """i and key of n requests; n_misses of them, evenly spread, ask for keys that nobody wrote."""
    i = F.col("id")
    miss = F.expr(f"(id + 1) * {n_misses} div {n} > id * {n_misses} div {n}")
    number = F.lpad(i.cast("string"), 8, "0")
    return spark.range(n).select(i.alias("i"), miss.alias("miss"), F.when(miss, F.concat(F.lit("bench:missing:"), number)).otherwise(F.concat(F.lit("bench:key:"), number)).alias("key"))


def zipf(spark: SparkSession, draws: int, n: int, s: float = 1.0) -> DataFrame:
    """i and rank (0 to n - 1) by the continuous inverse of Zipf's law; uniform numbers come from the draw's own number."""
    u = (F.pmod(F.col("id") * 2654435761, F.lit(4294967296)) + 0.5) / 4294967296.0
    x = F.exp(u * F.log(F.lit(float(n)))) if s == 1 else F.pow(u * (float(n) ** (1 - s) - 1) + 1, F.lit(1 / (1 - s)))
    return spark.range(draws).select(F.col("id").alias("i"), F.least(F.floor(x) - 1, F.lit(n - 1)).cast("long").alias("rank"))


def workload(spark: SparkSession, mode: str, n: int, n_misses: int, n_deletes: int = 0, writers: int = 2, readers: int = 4) -> DataFrame:
    """The commands of a benchmark mode: mode, client, seq, ts_ms, op, key, value, ttl_s.

    sequential: n writes, then n reads, then n_deletes deletes, by one client; concurrent: writers write while readers
    read the key written just before; mixed: one client writes and reads by turns. Misses are spread evenly over the reads.
    """
    asked = bench_keys(spark, n, n_misses)
    written = bench_keys(spark, n)
    i = F.col("i")
    if mode == "sequential":
        parts = [(written, "WRITE", i, F.lit(0)), (asked, "READ", i + n, F.lit(0)), (written.where(i < n_deletes), "DELETE", i + 2 * n, F.lit(0))]
    elif mode == "concurrent":
        parts = [(written, "WRITE", 2 * i, i % writers), (asked, "READ", 2 * i + 1, writers + i % readers)]
    elif mode == "mixed":
        parts = [(written, "WRITE", 2 * i, F.lit(0)), (asked, "READ", 2 * i + 1, F.lit(0))]
    else:
        raise ValueError(f"unknown mode: {mode}")
    value = lambda op: F.concat(F.lit("v"), i.cast("string")) if op == "WRITE" else F.lit(None).cast("string")
    made = [df.select(F.lit(mode).alias("mode"), client.cast("int").alias("client"), seq.alias("seq"), seq.alias("ts_ms"), F.lit(op).alias("op"), "key", value(op).alias("value"), F.lit(None).cast("long").alias("ttl_s")) for df, op, seq, client in parts]
    return reduce(DataFrame.unionByName, made)


def survivors(spark: SparkSession, n: int, stride: int) -> DataFrame:
    """Keys left after every stride-th of n is deleted."""
    every = bench_keys(spark, n).select("i", "key")
    return every.join(every.where(F.col("i") % stride == 0).select("key"), "key", "left_anti")


def rounds(spark: SparkSession, n: int, times: int) -> DataFrame:
    """A log that writes n keys `times` times over; the value is the round."""
    i = F.col("id")
    key = F.concat(F.lit("bench:key:"), F.lpad((i % n).cast("string"), 8, "0"))
    return spark.range(n * times).select(i.alias("seq"), F.lit(0).cast("long").alias("ts_ms"), key.alias("key"), F.expr(f"id div {n}").alias("value"), F.lit(False).alias("tombstone"), F.lit(None).cast("long").alias("expiry_ms"))


def compared(lines: DataFrame, base: str, other: str) -> DataFrame:
    """Mean rates of two systems and other's difference to base in percent, from report lines `<metric>: <rate> ops/s` (columns system, line)."""
    parts = lines.select("system", F.regexp_extract("line", r"^([^:]+): ", 1).alias("metric"), F.regexp_extract("line", r": ([0-9.]+) ops/s$", 1).try_cast("double").alias("rate")).where(F.col("rate").isNotNull())
    wide = parts.groupBy("metric").pivot("system", [base, other]).agg(F.avg("rate"))
    a, b = F.col(f"`{base}`"), F.col(f"`{other}`")
    return wide.select("metric", F.round(a, 4).alias("base_rate"), F.round(b, 4).alias("other_rate"), F.round(100 * (b - a) / F.nullif(a, F.lit(0.0)), 4).alias("percent"))


def histogram(samples: DataFrame, value: str, width: float, *by: str) -> DataFrame:
    """Counts in bins of equal width; low is a bin's lower edge."""
    return samples.where(F.col(value).isNotNull()).groupBy(*by, (F.floor(F.col(value) / width) * width).alias("low")).agg(F.count("*").alias("n"))
