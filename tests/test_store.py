"""Commits, restarts, compaction and streams of a store."""

import os

import pytest

from tidelog.model import MUTATIONS, Settings
from tidelog.operators import fold
from tidelog.plans import store as stores
from tidelog.plans.store import Store
from tidelog.streaming import ingest


def log(spark, rows):
    return spark.createDataFrame([(s, s, k, v, v is None, None) for s, k, v in rows], MUTATIONS)


def view(df):
    return sorted((r.key, r.value) for r in df.collect())


def test_a_batch_after_compaction_is_kept_and_a_replayed_one_is_known(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in (0, 1, 2):
        store.append(log(spark, [(i, f"k{i}", "v")]), batch=i, stream="a")
    assert store.compact(0) == "OK"
    store.append(log(spark, [(3, "k3", "v")]), batch=3, stream="a")
    before = store.version()
    for i in (0, 2, 3):
        store.append(log(spark, [(9, "k9", "again")]), batch=i, stream="a")
    assert store.version() == before and view(store.live(0)) == [(f"k{i}", "v") for i in range(4)]
    store.append(log(spark, [(5, "k5", "v")]), batch=0, stream="b")
    store.append(log(spark, [(6, "k6", "v")]))
    store.append(log(spark, []), batch=1, stream="b")
    again = Store(spark, str(tmp_path))
    assert view(again.live(0)) == [(k, "v") for k in ("k0", "k1", "k2", "k3", "k5", "k6")]
    ids = [r.segment_id for r in again.manifest().collect()]
    assert len(set(ids)) == len(ids) and again.state()["batches"] == {"a": 3, "b": 1}


def test_unfinished_commits_are_in_nobodys_way(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append(log(spark, [(1, "a", "1")]))
    os.makedirs(tmp_path / "manifest" / "v2")
    os.makedirs(tmp_path / "drafts", exist_ok=True)
    (tmp_path / "drafts" / "lost").write_text('{"segm')
    (tmp_path / "manifest" / ".v2.json.crc").write_text("x")
    store.append(log(spark, [(2, "b", "2")]))
    os.makedirs(tmp_path / "segments" / "0123abcd")
    assert store.version() == 2 and view(store.live(0)) == [("a", "1"), ("b", "2")]
    assert store.collect_garbage() == 1 and not os.listdir(tmp_path / "drafts") and view(store.live(0)) == [("a", "1"), ("b", "2")]
    assert view(store.live(0, version=1)) == [("a", "1")]


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    assert one._publish("manifest/v1.json", '{"a": 1}') and not two._publish("manifest/v1.json", '{"b": 2}')
    assert one.state(1) == {"a": 1}
    os.remove(tmp_path / "manifest" / "v1.json")
    write = two._write

    def beaten(*args):
        rows = write(*args)
        publish = two._publish

        def late(name, content):
            monkeypatch.setattr(two, "_publish", publish)
            one.append(log(spark, [(1, "a", "one")]))
            return publish(name, content)

        monkeypatch.setattr(two, "_publish", late)
        return rows

    monkeypatch.setattr(two, "_write", beaten)
    two.append(log(spark, [(2, "b", "two")]))
    assert view(one.live(0)) == [("a", "one"), ("b", "two")] and one.counters()["write_blocked_attempts"] == 1
    monkeypatch.setattr(stores, "TRIES", 1)
    monkeypatch.setattr(two, "_publish", lambda *_: False)
    with pytest.raises(stores.Conflict):
        two.append(log(spark, [(3, "c", "x")]))


def test_a_merge_that_lost_its_segments_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(3):
        store.append(log(spark, [(i, f"k{i}", "v")]))
    old = store.state()["segments"]
    assert store.compact(0) == "OK"
    v = store.version()
    assert not store._rewrite(old, 0, 0, False) and store.version() == v and len(view(store.live(0))) == 3


def test_compact_answers_and_counters(spark, tmp_path):
    times = iter(range(100, 200))
    store = Store(spark, str(tmp_path), Settings(max_segments=2, compact_ms=1 << 60), clock=lambda: next(times))
    assert store.compact(0) == "OK" and store.auto_compact(0) == "NOOP"
    for i in range(3):
        store.append(log(spark, [(i, "k", f"v{i}")]))
    assert store._publish("compacting", "0") and store.compact(0) == "NOOP" and store.counters()["compacting"] == 1
    os.remove(tmp_path / "compacting")
    assert store.due() and store.auto_compact(0) == "OK" and not store.due()
    got = store.counters()
    assert got["compaction_count"] == 2 and got["compacting"] == 0 and got["last_compact_end_ms"] > got["last_compact_start_ms"]
    left = Store(spark, str(tmp_path), Settings(compact_ms=0), clock=lambda: 1 << 60)
    assert left._publish("compacting", "0") and left.compact(0) == "OK"


def test_cascade_rolls_segments_and_leaves_the_view(spark, tmp_path):
    settings = Settings(strategy="leveled", level0_files=2, level1_bytes=2000, level_factor=2, levels=3, segment_bytes=1000)
    store, rows = Store(spark, str(tmp_path), settings), []
    for b in range(6):
        part = [(b * 100 + i, f"k{(i * 7 + b * 13) % 90:02d}", None if i % 9 == 0 else f"v{b}") for i in range(60)]
        rows += part
        store.append(log(spark, part))
        store.settle(0)
        assert view(store.live(0)) == view(fold.live(log(spark, rows), 0)) and not store.step(0)
    levels = {}
    for r in store.manifest().collect():
        levels.setdefault(r.level, []).append((r.min_key, r.max_key))
    assert max(levels) == 2 and len(levels[2]) > 1
    for level in set(levels) - {0}:
        own = sorted(levels[level])
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))
    assert store.span("k10", "k19", 0).count() == len([k for k, _ in view(store.live(0)) if "k10" <= k <= "k19"])
    with pytest.raises(ValueError, match="empty key"):
        store.append(log(spark, [(999, "", "v")]))
    assert view(store.live(0)) == view(fold.live(log(spark, rows), 0))


def test_segments_have_bloom_filters_on_key(spark, tmp_path):
    import glob

    store = Store(spark, str(tmp_path))
    store.append(log(spark, [(i, f"k{i:04d}", "v") for i in range(500)]))
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for f in glob.glob(str(tmp_path / "segments" / "*" / "*.parquet")):
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        for block in reader.getFooter().getBlocks():
            for column in block.getColumns():
                if column.getPath().toDotString() == "key":
                    found += column.getBloomFilterOffset() > 0
        reader.close()
    assert found


def test_settings_out_of_range():
    for bad in ({"mode": "x"}, {"codec": "x"}, {"dead_ratio": 2}, {"tier_low": 2}, {"max_segments": 0}, {"segment_bytes": 0}, {"level_factor": 1}, {"levels": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_a_restarted_stream_writes_each_batch_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for step in range(3):
        log(spark, [(step * 10 + i, f"k{i}", f"v{step}") for i in range(5)]).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(MUTATIONS).parquet(str(tmp_path / "in"))
        ingest.into_store(source, store, str(tmp_path / "c")).awaitTermination()
        if step == 1:
            store.compact(0)
    assert view(store.live(0)) == [(f"k{i}", "v2") for i in range(5)] and store.log().count() == 10
