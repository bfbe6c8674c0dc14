"""Queries that take in their whole table, where another of the kind has a fixed choice of segments or a fixed seq."""

from pyspark.sql import functions as F

from tidelog import catalog
from tidelog.plans import compaction
from tidelog.sources import tables

PATH = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tombstones_of_every_level(spark):
    log = compaction.leveled(catalog.segments(tables.mutations(spark, PATH), 100), 10).cache()
    levels = {}
    for r in log.select("level", "segment_id").distinct().collect():
        levels.setdefault(r.level, []).append(r.segment_id)
    assert set(levels) == {0, 1, 2} and sorted(sum(levels.values(), [])) == list(range(100))
    want = sorted((level, r.key) for level, chosen in levels.items() for r in compaction.collectable(log, chosen).collect())
    assert want and rows(compaction.collectable_by_level(log)) == want
    assert rows(catalog.QUERIES["kv_tombstone_gc_levels"](spark, PATH).select("level", "key")) == want
    log.unpersist()


def test_tombstones_in_hand_made_levels(spark):
    made = [(1, "a", 2, True), (2, "b", 2, True), (3, "b", 0, True), (4, "c", 1, False), (5, "c", 1, True), (6, "d", 0, True), (7, "e", 1, True), (8, "e", 1, False)]
    log = spark.createDataFrame(made, "seq long, key string, level int, tombstone boolean").withColumn("segment_id", F.col("level"))
    assert rows(compaction.collectable_by_level(log)) == [(0, "d"), (1, "c"), (2, "a")]


def test_a_snapshot_follows_from_the_table(spark):
    log = tables.mutations(spark, PATH)
    half = log.where("seq <= 4999")
    newest = {r.key: r for r in sorted(half.collect(), key=lambda r: r.seq)}
    assert half.count() * 2 == log.count()
    assert rows(catalog.QUERIES["kv_live_as_of_half"](spark, PATH)) == sorted((k, r.value) for k, r in newest.items() if not r.tombstone)


def test_overlaps_take_in_every_segment(spark):
    got = catalog.QUERIES["kv_level_overlap_adjacent"](spark, PATH)
    seen = {x for r in got.collect() for x in r}
    assert seen == set(range(1000)) and got.where("target_id % 3 <> source_id % 3 + 1").count() == 0


def test_partial_merges_take_in_every_part(spark):
    got = catalog.QUERIES["kv_compact_partial_each"](spark, PATH)
    log = tables.mutations(spark, PATH, ttl=True)
    want = log.groupBy(F.expr("(seq div 100) % 4 AS part"), "key").agg(F.max("seq").alias("seq"))
    assert rows(got.select("part", "key", "seq")) == rows(want) and got.select("part").distinct().count() == 4
