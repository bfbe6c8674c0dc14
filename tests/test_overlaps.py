import random

from pyspark.sql import functions as F

from tidelog.plans import compaction


def test_interval_join_compares_little_more_than_it_finds(spark):
    rng, n = random.Random(5), 3000
    wide = [(i, f"k{rng.randint(0, 9999):05d}", f"k{rng.randint(80000, 99999):05d}") for i in range(n)]
    narrow = [(i, f"k{7 * i:05d}", f"k{7 * i + rng.randint(0, 20):05d}") for i in range(n)]
    same = [(i, "k", "k") for i in range(200)]
    for made, most in ((wide, 1.3 * n * n / 4), (narrow, 2 * compaction.BUCKET_MEAN * n), (same, 2 * 100 * 100)):
        df = spark.createDataFrame(made, "segment_id long, min_key string, max_key string")
        source, target = df.where("segment_id % 2 = 0"), df.where("segment_id % 2 = 1")
        met = (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("a.max_key") >= F.col("b.min_key"))
        plain = source.alias("a").join(target.alias("b"), met).selectExpr("a.segment_id AS source_id", "b.segment_id AS target_id")
        sums = [F.count("*"), F.sum("source_id"), F.sum("target_id"), F.expr("bit_xor(xxhash64(source_id, target_id))")]
        found = plain.agg(*sums).first()
        assert compaction.overlaps(source, target).agg(*sums).first() == found
        assert compaction.candidates(source, target).count() <= most


def test_interval_join_takes_runs_of_first_keys(spark):
    rng, n = random.Random(6), 3000
    wide = [(i, f"k{rng.randint(0, 9999):05d}", f"k{rng.randint(80000, 99999):05d}") for i in range(n)]
    df = spark.createDataFrame(wide, "segment_id long, min_key string, max_key string")
    assert compaction.candidates(df.where("segment_id % 2 = 0"), df.where("segment_id % 2 = 1")).count() <= 2 * n  # of 2,250,000 pairs


def test_interval_join_at_the_ends_of_runs_and_buckets(spark):
    rng = random.Random(7)
    made = [(i, i % 3, *sorted((f"k{rng.randint(0, 40):02d}", f"k{rng.randint(0, 40):02d}"))) for i in range(150)]
    made += [(200 + i, i % 3, None, None) for i in range(3)]
    df = spark.createDataFrame(made, "segment_id long, level long, min_key string, max_key string")
    source, target = df.withColumn("step", F.col("level")), df.withColumn("step", F.col("level") - 1)
    want = sorted((a[0], b[0]) for a in made[:150] for b in made[:150] if b[1] == a[1] + 1 and a[2] <= b[3] and a[3] >= b[2])
    for buckets, run in ((1, 1), (7, 3), (40, 50), (None, 10)):
        assert sorted(map(tuple, compaction.overlaps(source, target, buckets, run).collect())) == want
