"""Which segments to merge, and the merge itself: a fold that leaves the live view as it is.

Only newest-by-seq decides. A tombstone or an expired record goes only when every older version goes in the same step
(drop); else it stays, an expired one as a tombstone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import record_size, unexpired
from ..model import Settings
from ..operators.fold import newest

#: First keys that a bucket of ranked() has by chance, and buckets at most; first keys of a run, and parts at least over which
#: the ranges that meet a run are dealt; segments for each task of an overlap join, and its tasks at most.
BUCKET_MEAN, BUCKETS_MOST, RUN, SPREAD, TASK_MEAN, TASKS_MOST = 64, 64, 4096, 8, 256, 256


def merge(log: DataFrame, as_of_ms: int, drop: bool) -> DataFrame:
    """The newest mutation of each key; drop: without deleted and expired ones, legal if log holds all older versions."""
    last = newest(log, "ts_ms", "value", "tombstone", "expiry_ms")
    gone = F.col("tombstone") | ~unexpired(F.col("expiry_ms"), as_of_ms)
    if drop:
        return last.where(~gone)
    return last.withColumns({"value": F.when(~gone, F.col("value")), "expiry_ms": F.when(~gone, F.col("expiry_ms")), "tombstone": gone})


def collectable(log: DataFrame, chosen: list[int]) -> DataFrame:
    """Tombstones of the chosen segments whose key no other segment holds: these may go in a partial merge."""
    inside = F.col("segment_id").isin(chosen)
    dead = newest(log.where(inside), "tombstone").where("tombstone").select("key")
    return dead.join(log.where(~inside).select("key").distinct(), "key", "left_anti")


def leveled(log: DataFrame, factor: int) -> DataFrame:
    """log with level, by the age of segment_id: all but the newest 1/factor in level 2, of these all but 1/factor in level 1, the rest in 0."""
    last = log.agg(F.max("segment_id").alias("last")).first()["last"] or 0
    age = F.lit(last) - F.col("segment_id")
    return log.withColumn("level", F.when(age * factor > last, 2).when(age * factor**2 > last, 1).otherwise(0))


def collectable_by_level(log: DataFrame) -> DataFrame:
    """(level, key) of tombstones that may go where each level is merged by itself: collectable() of the segments of every level."""
    found = log.groupBy("key").agg(F.min("level").alias("level"), F.max("level").alias("top"), F.max_by("tombstone", "seq").alias("tombstone"))
    return found.where((F.col("level") == F.col("top")) & F.col("tombstone")).select("level", "key")


def size_of(log: DataFrame) -> Column:
    """Bytes of a record; a value of type double counts as eight."""
    value = F.when(F.col("value").isNotNull(), F.lit("12345678")) if dict(log.dtypes)["value"] == "double" else F.col("value")
    return record_size(F.col("key"), value, F.col("expiry_ms"))


def zone_map(log: DataFrame) -> DataFrame:
    """A row for each segment_id: key range, records, tombstones and bytes."""
    size = size_of(log)
    return log.groupBy("segment_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_records"), F.count_if("tombstone").alias("n_tombstones"), F.sum(size).alias("bytes"))


def meeting(segments: DataFrame, start: str, end: str) -> DataFrame:
    """Segments whose key range meets start to end."""
    return segments.where((F.col("min_key") <= end) & (F.col("max_key") >= start))


def ranked(source: DataFrame, target: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """Ranges of segments and first keys of the other side (of_source: the ranges are the source's), each step by itself.

    A row for each end of a range and for each first key: id, turn and rank, the number of first keys before it. At equal keys
    turn decides: 0 starts a source's range, 1 is a first key, 2 starts a target's range, 3 ends a range. Keys are cut into
    buckets at segments' first keys, picked by hash; first keys are counted in each and added up over the buckets before.
    """
    firsts = source.select("min_key").unionByName(target.select("min_key")).distinct()
    edges = sorted(r[0] for r in firsts.orderBy(F.xxhash64("min_key"), "min_key").limit(buckets - 1).collect())
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("key"))) if edges else F.lit(0)

    def marks(segments: DataFrame, of_source: bool) -> DataFrame:
        rows = ((of_source, "min_key", 0 if of_source else 2), (of_source, "max_key", 3), (not of_source, "min_key", 1))
        made = [F.struct(F.lit(side).alias("of_source"), F.col(key).alias("key"), F.lit(turn).alias("turn")) for side, key, turn in rows]
        return segments.select("step", F.col("segment_id").alias("id"), F.inline(F.array(*made)))

    every, group = marks(source, True).unionByName(marks(target, False)).withColumn("bucket", bucket), ["of_source", "step"]
    first = (F.col("turn") == 1).cast("long")
    held = every.groupBy(*group, "bucket").agg(F.sum(first).alias("held"))
    lower = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*group, "bucket", F.coalesce(F.sum("held").over(lower), F.lit(0)).alias("before"))
    so_far = Window.partitionBy(*group, "bucket").orderBy("key", "turn", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = every.repartition(tasks, *group, "bucket").withColumn("rank", F.sum(first).over(so_far) - first)
    return counted.join(F.broadcast(before), [*group, "bucket"]).select(*group, "id", "turn", (F.col("rank") + F.col("before")).alias("rank"))


def candidates(source: DataFrame, target: DataFrame, buckets: int | None = None, run: int = RUN) -> DataFrame:
    """Ranges of segments (range_id; of_source or of target), each with ids of the other side's segments whose first keys lie in it.

    First keys are ranked, so those in a range follow each other. They are stored in runs, and a range takes whole runs and
    slices at its ends: a row for each run that it meets, and no keys compared. Segments meet others of their step, if they
    have that column.
    """
    step = lambda x: F.col("step").cast("long") if "step" in x.columns else F.lit(0).cast("long")
    source, target = (x.where("min_key IS NOT NULL").select("segment_id", "min_key", "max_key", step(x).alias("step")) for x in (source, target))
    n = source.unionByName(target).count()
    tasks = min(TASKS_MOST, n // TASK_MEAN + 1)
    spread = max(SPREAD, 2 * tasks // (n // run + 1))
    rows = ranked(source, target, buckets or min(BUCKETS_MOST, n // BUCKET_MEAN + 1), min(BUCKETS_MOST, n // RUN + 1))
    group, on = ["of_source", "step"], ["of_source", "step", "run", "part"]

    firsts = rows.where("turn = 1").groupBy(*group, F.expr(f"rank div {run}").alias("run"))
    runs = firsts.agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("found")).select(*group, "run", F.col("found.id").alias("ids"))
    runs = runs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(tasks, *on)

    ends = rows.where("turn <> 1").groupBy(*group, F.col("id").alias("range_id"))
    low, high = (F.max(F.when(at, F.col("rank"))) for at in (F.col("turn") < 3, F.col("turn") == 3))
    ranges = ends.agg(low.alias("low"), high.alias("high")).where("low < high").withColumn("part", F.pmod(F.xxhash64("range_id"), F.lit(spread)).cast("int"))
    met = ranges.withColumn("run", F.explode(F.expr(f"sequence(low div {run}, (high - 1) div {run})")))
    skip, end = F.greatest(F.col("low") - F.col("run") * run, F.lit(0)), F.least(F.col("high") - F.col("run") * run, F.lit(run))
    met = met.select(*on, "range_id", skip.cast("int").alias("skip"), end.cast("int").alias("end")).repartition(tasks, *on)
    whole = (F.col("skip") == 0) & (F.col("end") == F.size("ids"))
    ids = F.when(whole, F.col("ids")).otherwise(F.slice("ids", F.col("skip") + 1, F.col("end") - F.col("skip")))
    return met.join(runs.hint("shuffle_hash"), on).select("of_source", "range_id", ids.alias("ids"))


def overlaps(source: DataFrame, target: DataFrame, buckets: int | None = None, run: int = RUN) -> DataFrame:
    """(source_id, target_id) of segments with overlapping key ranges, of equal step if there is one.

    Of two that overlap, the later first key lies in the other's range (the target's, if they are equal). So first keys
    meet the ranges around them and each pair comes about once, in one run: the work follows the pairs found.
    """
    met = candidates(source, target, buckets, run).select("of_source", "range_id", F.explode("ids").alias("point_id"))
    ids = [F.when(F.col("of_source"), F.col(x)).otherwise(F.col(y)) for x, y in (("range_id", "point_id"), ("point_id", "range_id"))]
    return met.select(ids[0].alias("source_id"), ids[1].alias("target_id"))


def level_triggers(segments: DataFrame, settings: Settings) -> DataFrame:
    """level, n, bytes and due: level 0 by its number of segments, level n by bytes against level1 * factor ** (n - 1)."""
    limit = F.lit(settings.level1_bytes) * F.pow(F.lit(settings.level_factor), F.col("level") - 1)
    due = F.when(F.col("level") == 0, F.col("n") >= settings.level0_files).otherwise(F.col("bytes") >= limit)
    return segments.groupBy("level").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).withColumn("due", due)


def level_due(level: int, n: int, size: int, settings: Settings) -> bool:
    """level_triggers() for one level of a manifest that the driver holds."""
    return n >= settings.level0_files if level == 0 else size >= settings.level1_bytes * settings.level_factor ** (level - 1)


def tiers(sizes: Sequence[tuple[int, int]], settings: Settings) -> list[list[int]]:
    """Buckets of (segment_id, bytes), in the given order: the bucket whose mean is nearest within the limits, else a new one."""
    buckets: list[list[tuple[int, int]]] = []
    for segment, size in sizes:
        means = [(abs(mean - size), i) for i, b in enumerate(buckets) if settings.tier_low * (mean := sum(x for _, x in b) / len(b)) <= size <= settings.tier_high * mean]
        if means:
            buckets[min(means)[1]].append((segment, size))
        else:
            buckets.append([(segment, size)])
    return [[s for s, _ in b] for b in buckets]


def tier_table(segments: DataFrame, settings: Settings) -> DataFrame:
    """segment_id, bytes, bucket, and whether the bucket is due. The order matters, so the driver deals out the manifest, a row per segment."""
    sizes = [(r["segment_id"], r["bytes"]) for r in segments.select("segment_id", "bytes").orderBy("segment_id").collect()]
    known = dict(sizes)
    rows = [(s, known[s], i, len(b) >= settings.tier_files) for i, b in enumerate(tiers(sizes, settings)) for s in b]
    return segments.sparkSession.createDataFrame(rows, "segment_id long, bytes long, bucket int, due boolean")


def summary(segments: DataFrame) -> DataFrame:
    """One row on a whole store from its manifest: segments, records, tombstones, bytes and key range."""
    return segments.agg(F.count("*").alias("segments"), F.sum("n_records").alias("n_records"), F.sum("n_tombstones").alias("n_tombstones"), F.sum("bytes").alias("bytes"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def dead_ratio(log: DataFrame) -> DataFrame:
    """total_bytes, dead_bytes and their ratio: all but the newest record of a key are dead, and that too if it is a tombstone.

    One aggregation by key, combined before the shuffle: dead bytes are all bytes less those of the newest records that live.
    """
    by_key = log.groupBy("key").agg(F.sum(size_of(log)).alias("size"), F.max_by(F.struct("tombstone", size_of(log).alias("size")), "seq").alias("last"))
    alive = F.when(~F.col("last.tombstone"), F.col("last.size")).otherwise(0)
    return by_key.agg(F.sum("size").alias("total_bytes"), F.sum(F.col("size") - alive).alias("dead_bytes")).withColumn("ratio", F.round(F.col("dead_bytes") / F.col("total_bytes"), 6))


def merge_by_window(log: DataFrame, width_ms: int, as_of_ms: int) -> DataFrame:
    """Each window of time merged by itself: window and, of each key in it, the newest mutation. Older versions may lie in other windows, so deletions stay."""
    windowed = log.withColumn("window", F.expr(f"ts_ms div {int(width_ms)}"))
    last = windowed.groupBy("window", "key").agg(F.max_by(F.struct("seq", "ts_ms", "value", "tombstone", "expiry_ms"), "seq").alias("last")).select("window", "key", "last.*")
    gone = F.col("tombstone") | ~unexpired(F.col("expiry_ms"), as_of_ms)
    return last.withColumns({"value": F.when(~gone, F.col("value")), "expiry_ms": F.when(~gone, F.col("expiry_ms")), "tombstone": gone})


def due(dead_bytes: int, total_bytes: int, segments: int, settings: Settings) -> bool:
    return (total_bytes > 0 and dead_bytes / total_bytes > settings.dead_ratio) or segments > settings.max_segments
