"""Store, compaction, streams and the rules of the live view."""

import random

import pytest

from tidelog.model import MUTATIONS, Settings
from tidelog.operators import commands, fold, reads, replay
from tidelog.plans import compaction
from tidelog.plans.store import Store
from tidelog.streaming import ingest


def log(spark, rows):
    return spark.createDataFrame([(s, s, k, v, v is None, e) for s, k, v, e in rows], MUTATIONS)


def view(df):
    return sorted((r.key, r.value) for r in df.collect())


def test_fold_rules(spark):
    df = log(spark, [(1, "a", "1", None), (2, "a", "2", None), (3, "b", "x", None), (4, "b", None, None), (5, "c", "t", 100), (6, "d", "t", 100), (7, "d", "u", None), (8, "e", "", 101), (9, "é￿", "\0", None)])
    assert view(fold.live(df, 100)) == [("a", "2"), ("d", "u"), ("e", ""), ("é￿", "\0")]
    assert view(fold.live(df, 100, as_of_seq=3)) == [("a", "2"), ("b", "x")]
    assert [r.key for r in reads.span(df, "a", "d", 99).collect()] == ["a", "c", "d"]
    with pytest.raises(reads.Unsupported):
        reads.span(df, "a", "d", 99, mode="hash")
    probes = spark.createDataFrame([(0, "a"), (1, "zz"), (2, "a")], "pos int, key string")
    assert reads.wire_pairs(reads.mget(df, probes, 0)).first()[0] == ["a", "2", "zz", "\0", "a", "2"]


def test_key_predicate_reaches_the_scan(spark, tmp_path):
    log(spark, [(i, f"k{i:03d}", "v", None) for i in range(50)]).write.parquet(str(tmp_path / "p"))
    plan = reads.get(spark.read.parquet(str(tmp_path / "p")), "k007", 0)._jdf.queryExecution().toString()
    assert "EqualTo(key,k007)" in plan.split("PushedFilters")[1]


@pytest.mark.parametrize("strategy", ["size_tiered", "leveled"])
def test_merges_leave_the_view(spark, tmp_path, strategy):
    rng = random.Random(7)
    store = Store(spark, str(tmp_path / "s"), Settings(strategy=strategy, tier_files=2, level0_files=2, level1_bytes=1000, levels=3))
    seq = 0
    rows = []
    for _ in range(4):
        part = []
        for _ in range(25):
            seq += 1
            part.append((seq, f"k{rng.randint(0, 14):02d}", rng.choice([None, f"v{seq}"]), rng.choice([None, 50, 5000])))
        rows += part
        store.append(log(spark, part))
        want = view(fold.live(log(spark, rows), 100))
        store.step(100)
        assert view(store.live(100)) == want
    store.compact(100)
    assert view(store.live(100)) == want and store.manifest().count() == 1
    assert view(store.span("k03", "k09", 100)) == [x for x in want if "k03" <= x[0] <= "k09"]
    assert store.collect_garbage() > 0 and view(store.live(100)) == want
    with pytest.raises(ValueError):
        store.append(log(spark, [(999, "", "v", None)]))


def test_old_versions_do_not_come_back(spark):
    newer = log(spark, [(5, "a", "v2", 10), (6, "b", None, None)])
    kept = compaction.merge(newer, 100, False)
    both = kept.select("seq", "ts_ms", "key", "value", "tombstone", "expiry_ms").unionByName(log(spark, [(1, "a", "v1", None), (2, "b", "w", None)]))
    assert view(fold.live(both, 100)) == []
    assert compaction.tiers([(1, 100), (2, 110), (3, 1000), (4, 90)], Settings()) == [[1, 2, 4], [3]]


def test_replay_equals_a_fold(spark):
    rng, rows = random.Random(3), []
    for s in range(400):
        op = rng.choice(["WRITE", "WRITETTL", "DELETE", "TTL", "READ", "EXISTS"])
        rows.append((s, s * 1000, op, f"k{rng.randint(0, 5)}", f"v{s}" if op.startswith("WRITE") else None, rng.choice([0, 3, 9]) if op == "TTL" else 5 if op == "WRITETTL" else None))
    state, want = {}, []
    for s, ts, op, k, v, ttl in rows:
        held = state.get(k)
        if held and held[1] is not None and held[1] <= ts:
            held = None
        status = "OK" if op.startswith("WRITE") or held else "NOT_FOUND"
        want.append((s, status, held[0] if op == "READ" and held else None))
        if op.startswith("WRITE"):
            state[k] = (v, ts + ttl * 1000 if ttl else None)
        elif op == "DELETE":
            state.pop(k, None)
        elif op == "TTL" and held:
            state[k] = (held[0], ts + ttl * 1000 if ttl else None)
    df = spark.createDataFrame(rows, "seq long, ts_ms long, op string, key string, value string, ttl_s long")
    assert sorted((r.seq, r.status, r.payload) for r in replay.replay(df).collect()) == want
    left = {k: v for k, (v, e) in state.items() if e is None or e > 400_000}
    assert dict(view(fold.live(replay.applied(df), 400_000))) == left


def test_batches_and_lines(spark):
    items = spark.sql("SELECT 1L seq, 0L ts_ms, 'MSET' op, array(struct('a' AS key, '1' AS value, 0L AS ttl_s), struct('a' AS key, '2' AS value, 0L AS ttl_s)) items")
    assert [(r.pos, r.op, r.value) for r in replay.exploded(items).orderBy("pos").collect()] == [(0, "WRITE", "1"), (1, "WRITE", "2")]
    lines = ["write k  a  b ", "", "READ", "ttl k 0", "WRITETTL k 60 5things", "WRITETTL k 0 v", "MWRITETTL 60 k1 v1 k2 v2", "mset a", "MSET a 1 b 2", "ping", "bogus x"]
    got = [(r.op, r.value, r["items"], r.error) for r in commands.parse(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")).orderBy("i").collect()]
    assert got[0] == ("WRITE", " a  b ", None, None) and got[4][:2] == ("WRITETTL", "5things") and got[6][2] == "k1=v1,k2=v2"
    assert [g[3] is None for g in got] == [True, False, False, True, True, False, True, False, True, True, False]


def test_stream(spark, tmp_path):
    log(spark, [(i, f"k{i % 7}", f"v{i}", None) for i in range(40)]).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(MUTATIONS).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    ingest.into_store(source, store, str(tmp_path / "c")).awaitTermination()
    assert view(store.live(0)) == [(f"k{i % 7}", f"v{i}") for i in sorted(range(33, 40), key=lambda i: i % 7)]
    q = ingest.live_stream(source, 0).writeStream.outputMode("complete").format("memory").queryName("tidelog_live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert view(spark.table("tidelog_live")) == view(store.live(0))


def test_kept_expiry_against_a_sequential_fold(spark):
    rng, rows, state = random.Random(5), [], {}
    for seq in range(400):
        key, ttl, dead = f"k{rng.randint(0, 9)}", rng.choice([None, None, 3, 40]), rng.random() < 0.15
        ts = seq * 2
        rows.append((seq, ts, key, str(seq), dead, None if ttl is None else ts + ttl))
        old = state.get(key)
        if old and old[1] is not None and old[1] <= ts:
            old = None
        state[key] = None if dead else (str(seq), ts + ttl if ttl else (old[1] if old else None))
    log = spark.createDataFrame(rows, "seq long, ts_ms long, key string, value string, tombstone boolean, expiry_ms long")
    got = {r.key: (r.value, r.expiry_ms) for r in fold.kept_expiry(log).where("NOT tombstone").collect()}
    assert got == {k: v for k, v in state.items() if v}


def test_tiers_against_a_plain_fold(spark):
    sizes = [(i, s) for i, s in enumerate([100, 110, 1000, 90, 950, 40, 105, 5000])]
    table = compaction.tier_table(spark.createDataFrame(sizes, "segment_id long, bytes long"), Settings())
    got = {r.segment_id: (r.bucket, r.due) for r in table.collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (1, False), 3: (0, True), 4: (1, False), 5: (2, False), 6: (0, True), 7: (3, False)}


def test_ranks_against_sorted_values(spark):
    from tidelog.operators import measures

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 40))])) for _ in range(700)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for buckets in (1, 4, 256):
        got = {r.g: (r.n, r.p) for r in measures.at_ranks(df, "v", {"p": "least(n * 90 div 100, n - 1)"}, "g", buckets=buckets).collect()}
        assert got == {g: (len(v), sorted(v)[min(len(v) * 90 // 100, len(v) - 1)]) for g, v in groups.items()}
    assert measures.quantiles(df.limit(0), "v", {"m": 0.5}, "g").count() == 0


def test_shards_take_their_share_and_move_no_others(spark):
    from pyspark.sql import functions as F

    from tidelog.operators import shards

    keys = spark.range(4000).select(F.format_string("k%05d", "id").alias("key"))
    counts = [r["count"] for r in keys.groupBy(shards.by_hash(F.col("key"), 8)).count().collect()]
    assert len(counts) == 8 and min(counts) > 400
    moved = shards.moved(keys, 8, 9).collect()
    assert {r.after for r in moved} == {8} and 300 < len(moved) < 600
    assert [r[0] for r in spark.createDataFrame([("a",), ("m",), ("z",)], "k string").select(shards.by_range(F.col("k"), ["x", "m"])).collect()] == [0, 1, 2]


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(2)
    made = [(i, *sorted((f"k{rng.randint(0, 99):02d}", f"k{rng.randint(0, 99):02d}"))) for i in range(60)]
    df = spark.createDataFrame(made, "segment_id long, min_key string, max_key string")
    want = sorted((a[0], b[0]) for a in made[:30] for b in made[30:] if a[1] <= b[2] and a[2] >= b[1])
    for buckets in (1, 5, 64):
        got = compaction.overlaps(df.where("segment_id < 30"), df.where("segment_id >= 30"), buckets)
        assert sorted(map(tuple, got.collect())) == want


def test_items_of_a_command_apply_in_order(spark):
    lines = spark.createDataFrame([(1, "MSET a 1 b 2 a 3"), (2, "MWRITETTL 5 b 9 c 8 b 7"), (3, "mset c 1")], "seq long, line string")
    parsed = commands.parse(lines)
    each = parsed.selectExpr("seq", "seq * 1000 AS ts_ms", "'MSET' AS op", "transform(split(items, ','), x -> struct(split(x, '=')[0] AS key, split(x, '=')[1] AS value, coalesce(ttl_s, 0L) AS ttl_s)) AS items")
    log = replay.applied(replay.exploded(each), "pos")
    assert view(fold.live(log, 3000)) == [("a", "3"), ("b", "7"), ("c", "1")] and view(fold.live(log, 7000)) == [("a", "3"), ("c", "1")]
