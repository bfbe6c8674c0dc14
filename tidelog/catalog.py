"""All queries of the changelog engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.records import checksum, memory_size, record_size, unexpired
from .model import Settings
from .operators import commands as language
from .operators import fold, measures, reads, replay, shards
from .plans import compaction
from .plans.store import Store, scratch
from .sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MS = "epoch_us(ts) // 1000"
#: Logs, each as a table expression in SQL.
TOMB = f"SELECT event_id AS seq, {MS} AS ts_ms, 'user:' || lpad(user_id::VARCHAR, 8, '0') || ':' || event_type AS key, value, event_id % 7 = 3 AS tombstone, NULL::BIGINT AS expiry_ms FROM events"
TTL = TOMB.replace("NULL::BIGINT AS expiry_ms", f"CASE WHEN event_id % 3 = 0 THEN {MS} + (1 + event_id % 72) * 3600000 END AS expiry_ms")
ORDERS = "SELECT o_orderkey AS seq, 'cust:' || lpad(o_custkey::VARCHAR, 8, '0') AS key, o_totalprice AS value, o_orderkey % 7 = 3 AS tombstone, NULL::BIGINT AS expiry_ms FROM orders"
TELEMETRY = f"SELECT event_id AS seq, event_type || ':' || lpad(user_id::VARCHAR, 8, '0') || ':' || lpad(({MS})::VARCHAR, 13, '0') AS key, value FROM events"
PROBES = "SELECT c_custkey AS pos, 'cust:' || lpad((c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 10000000 ELSE 0 END)::VARCHAR, 8, '0') AS key FROM customer"
COMMANDS = f"""SELECT event_id AS seq, {MS} AS ts, CASE event_type WHEN 'purchase' THEN 'WRITE' WHEN 'signup' THEN 'WRITETTL' WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'TTL' WHEN 'view' THEN 'READ' END AS op,
    'user:' || lpad(user_id::VARCHAR, 8, '0') AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS value,
    CASE event_type WHEN 'signup' THEN (1 + event_id % 48) * 3600 WHEN 'click' THEN (event_id % 4) * 21600 END AS ttl FROM events"""
REPLAY = f"""c0 AS ({COMMANDS}), c1 AS (SELECT *, CASE WHEN op IN ('WRITETTL', 'TTL') AND ttl > 0 THEN ts + ttl * 1000 END AS new_exp, op IN ('WRITE', 'WRITETTL') AS w FROM c0),
    c2 AS (SELECT *, coalesce(sum((op IN ('WRITE', 'WRITETTL', 'DELETE'))::INT) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + w::INT AS epoch FROM c1),
    heads AS (SELECT key, epoch, arg_min(op, seq) AS head, arg_min(value, seq) AS head_val FROM c2 GROUP BY ALL),
    c3 AS (SELECT *, max(CASE WHEN op IN ('WRITE', 'WRITETTL', 'TTL') THEN seq END) OVER (PARTITION BY key, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c2),
    c4 AS (SELECT c3.*, p.new_exp AS prev_exp FROM c3 LEFT JOIN c1 p ON p.seq = c3.prev),
    c5 AS (SELECT *, max((NOT w AND coalesce(prev_exp <= ts, false))::INT) OVER (PARTITION BY key, epoch ORDER BY seq) AS failed FROM c4),
    r AS (SELECT c5.seq, c5.key, op, head_val, CASE WHEN w OR (head IN ('WRITE', 'WRITETTL') AND failed = 0) THEN 'OK' ELSE 'NOT_FOUND' END AS status, ttl, value, ts, new_exp FROM c5 JOIN heads USING (key, epoch))"""


def live_sql(log: str, where: str = "true", as_of: str = "(SELECT max(epoch_us(ts) // 1000) FROM events)") -> str:
    return f"(SELECT key, value, expiry_ms FROM (SELECT * FROM ({log}) WHERE {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone AND (expiry_ms IS NULL OR expiry_ms > {as_of}))"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def now(spark, d) -> int:
    return fold.last_instant(t.mutations(spark, d))


@query("kv_live_view", f"SELECT key, value, expiry_ms FROM {live_sql(TTL)}")
def _(spark, d):
    return fold.live(t.mutations(spark, d, ttl=True), now(spark, d))


@query("kv_get", f"SELECT key, value FROM {live_sql(ORDERS, "key = 'cust:00000007'")}")
def _(spark, d):
    return reads.get(t.orders_log(spark, d), "cust:00000007", 0).select("key", "value")


@query("kv_mget", f"SELECT pos, p.key, value, l.key IS NOT NULL AS found FROM ({PROBES}) p LEFT JOIN {live_sql(ORDERS)} l ON p.key = l.key")
def _(spark, d):
    return reads.mget(t.orders_log(spark, d), t.probe_keys(spark, d), 0)


@query("kv_exists_semi", f"SELECT pos, key FROM ({PROBES}) WHERE key IN (SELECT key FROM {live_sql(ORDERS)})")
def _(spark, d):
    return reads.exists(t.orders_log(spark, d), t.probe_keys(spark, d), 0).select("pos", "key")


@query("kv_missing_anti", f"SELECT pos, key FROM ({PROBES}) WHERE key NOT IN (SELECT key FROM {live_sql(ORDERS)})")
def _(spark, d):
    return reads.missing(t.orders_log(spark, d), t.probe_keys(spark, d), 0).select("pos", "key")


@query("kv_list", f"SELECT key FROM {live_sql(TTL)}")
def _(spark, d):
    return reads.keys(t.mutations(spark, d, ttl=True), now(spark, d))


@query("kv_range", f"SELECT key, value FROM {live_sql(TOMB, "key BETWEEN 'user:00000002' AND 'user:00000009:view'")}")
def _(spark, d):
    return reads.span(t.mutations(spark, d), "user:00000002", "user:00000009:view", 0).select("key", "value")


@query("kv_range_inverted_empty", f"SELECT key, value FROM {live_sql(TOMB, 'false')}")
def _(spark, d):
    return reads.span(t.mutations(spark, d), "z", "a", 0).select("key", "value")


@query("kv_live_as_of_half", f"SELECT key, value FROM {live_sql(TOMB, 'seq <= (SELECT max(event_id) // 2 FROM events)')}")
def _(spark, d):
    log = t.mutations(spark, d)
    return fold.live(log, 0, as_of_seq=(log.agg(F.max("seq").alias("last")).first()["last"] or 0) // 2).select("key", "value")


@query("kv_ttl_visible", f"SELECT key, expiry_ms FROM {live_sql(TTL)} WHERE expiry_ms IS NOT NULL")
def _(spark, d):
    return fold.live(t.mutations(spark, d, ttl=True), now(spark, d), values=False).where("expiry_ms IS NOT NULL")


@query("kv_expired_keys", f"SELECT key, expiry_ms FROM (SELECT * FROM ({TTL}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone AND expiry_ms <= (SELECT max({MS}) FROM events)")
def _(spark, d):
    return fold.newest(t.mutations(spark, d, ttl=True), "tombstone", "expiry_ms").where(~F.col("tombstone") & (F.col("expiry_ms") <= now(spark, d))).select("key", "expiry_ms")


@query("kv_persisted_keys", f"WITH {REPLAY} SELECT seq, key FROM r WHERE op = 'TTL' AND ttl = 0 AND status = 'OK'")
def _(spark, d):
    return replay.replay(t.commands(spark, d)).where("op = 'TTL' AND ttl_s = 0 AND status = 'OK'").select("seq", "key")


@query("kv_replay_status", f"WITH {REPLAY} SELECT seq, op, key, status FROM r")
def _(spark, d):
    return replay.replay(t.commands(spark, d)).select("seq", "op", "key", "status")


@query("kv_replay_reads", f"WITH {REPLAY} SELECT seq, key, status, CASE WHEN status = 'OK' THEN head_val END AS payload FROM r WHERE op = 'READ'")
def _(spark, d):
    return replay.replay(t.commands(spark, d)).where("op = 'READ'").select("seq", "key", "status", "payload")


@query("kv_replay_live", f"""WITH {REPLAY}, m AS (SELECT *, max(CASE WHEN op IN ('WRITE', 'WRITETTL') THEN seq END) OVER (PARTITION BY key ORDER BY seq) AS written FROM r WHERE op IN ('WRITE', 'WRITETTL', 'DELETE') OR (op = 'TTL' AND status = 'OK')),
    l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
    SELECT l.key, v.value, l.new_exp AS expiry_ms FROM l JOIN r v ON v.seq = l.written WHERE l.op <> 'DELETE' AND (l.new_exp IS NULL OR l.new_exp > (SELECT max({MS}) FROM events))""")  # fmt: skip
def _(spark, d):
    return fold.live(replay.applied(t.commands(spark, d)), now(spark, d))


@query("kv_op_stats", f"""WITH {REPLAY}, s AS (SELECT count(*) FILTER (op = 'READ') AS reads, count(*) FILTER (op = 'READ' AND status = 'NOT_FOUND') AS read_misses, count(*) FILTER (op IN ('WRITE', 'WRITETTL')) AS writes, count(*) FILTER (op = 'WRITETTL') AS writes_with_ttl,
    count(*) FILTER (op = 'DELETE') AS deletes, count(*) FILTER (op = 'DELETE' AND status = 'NOT_FOUND') AS delete_misses, count(*) FILTER (op = 'TTL') AS ttls, count(*) FILTER (op = 'TTL' AND status = 'NOT_FOUND') AS ttl_misses, 0::BIGINT AS errors, count(*) AS commands FROM r)
    UNPIVOT s ON COLUMNS(*) INTO NAME name VALUE value""")  # fmt: skip
def _(spark, d):
    return replay.counters(replay.replay(t.commands(spark, d)))


def segments(log: DataFrame, rows: int = 1000) -> DataFrame:
    return log.withColumn("segment_id", F.expr(f"seq div {rows}"))


SIZE = "21 + strlen(key) + CASE WHEN value IS NULL THEN 0 ELSE 8 END + CASE WHEN expiry_ms IS NULL THEN 0 ELSE 8 END"
ZONES = f"SELECT seq // 1000 AS segment_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_records, count(*) FILTER (tombstone) AS n_tombstones, sum({SIZE})::BIGINT AS bytes FROM ({TTL}) GROUP BY 1"
SMALL = f"SELECT seq // 10 AS segment_id, min(key) AS min_key, max(key) AS max_key FROM ({TTL}) GROUP BY 1"


@query("kv_dead_bytes_ratio", f"SELECT total AS total_bytes, dead AS dead_bytes, round(dead / total, 6) AS ratio FROM (SELECT sum(n)::BIGINT AS total, sum(CASE WHEN tombstone OR seq < last THEN n ELSE 0 END)::BIGINT AS dead FROM (SELECT *, {SIZE} AS n, max(seq) OVER (PARTITION BY key) AS last FROM ({TTL})))")
def _(spark, d):
    return compaction.dead_ratio(t.mutations(spark, d, ttl=True))


@query("kv_auto_compact", f"SELECT dead * 1.0 / total > 0.5 OR n > 10 AS due FROM (SELECT sum(n)::BIGINT AS total, sum(CASE WHEN tombstone OR seq < last THEN n ELSE 0 END)::BIGINT AS dead, count(DISTINCT seq // 1000) AS n FROM (SELECT *, {SIZE} AS n, max(seq) OVER (PARTITION BY key) AS last FROM ({TTL})))")
def _(spark, d):
    log, s = segments(t.mutations(spark, d, ttl=True)), Settings()
    dead, total = compaction.dead_ratio(log).select("dead_bytes", "total_bytes").first()
    n = log.agg(F.countDistinct("segment_id")).first()[0]
    return spark.range(1).select(F.lit(compaction.due(dead or 0, total or 0, n, s)).alias("due"))


@query("kv_segment_zone_map", ZONES)
def _(spark, d):
    return compaction.zone_map(segments(t.mutations(spark, d, ttl=True)))


@query("kv_range_file_prune", f"SELECT segment_id FROM ({SMALL}) WHERE min_key <= 'user:00000001:zz' AND max_key >= 'user:00000001'")
def _(spark, d):
    return compaction.meeting(compaction.zone_map(segments(t.mutations(spark, d, ttl=True), 10)), "user:00000001", "user:00000001:zz").select("segment_id")


@query("kv_level_overlap_adjacent", f"WITH z AS ({SMALL}) SELECT a.segment_id AS source_id, b.segment_id AS target_id FROM z a JOIN z b ON a.min_key <= b.max_key AND a.max_key >= b.min_key WHERE b.segment_id % 3 = a.segment_id % 3 + 1")
def _(spark, d):
    z, path = compaction.zone_map(segments(t.mutations(spark, d, ttl=True), 10)).select("segment_id", "min_key", "max_key"), scratch(spark, "zones")
    z.write.parquet(path)  # the join reads it again and again
    z, level = spark.read.schema(z.schema).parquet(path), F.col("segment_id") % 3
    source, target = (z.withColumn("step", level - i).where("step BETWEEN -2 AND 1") for i in (0, 1))
    return compaction.overlaps(source, target)


@query("kv_level_trigger", f"SELECT (segment_id % 3)::BIGINT AS level, count(*) AS n, sum(bytes)::BIGINT AS bytes, CASE WHEN segment_id % 3 = 0 THEN count(*) >= 4 ELSE sum(bytes) >= 100000 * pow(10, segment_id % 3 - 1) END AS due FROM ({ZONES}) GROUP BY segment_id % 3")
def _(spark, d):
    z = compaction.zone_map(segments(t.mutations(spark, d, ttl=True))).withColumn("level", F.col("segment_id") % 3)
    return compaction.level_triggers(z, Settings(level1_bytes=100_000))


@query("kv_compact_full", f"SELECT seq, key, value, expiry_ms FROM (SELECT * FROM ({TTL}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone AND (expiry_ms IS NULL OR expiry_ms > (SELECT max({MS}) FROM events))")
def _(spark, d):
    return compaction.merge(t.mutations(spark, d, ttl=True), now(spark, d), True).select("seq", "key", "value", "expiry_ms")


@query("kv_compact_partial_each", f"""SELECT part, seq, key, CASE WHEN NOT gone THEN value END AS value, gone AS tombstone, CASE WHEN NOT gone THEN expiry_ms END AS expiry_ms
    FROM (SELECT *, tombstone OR coalesce(expiry_ms <= (SELECT max({MS}) FROM events), false) AS gone FROM (SELECT *, (seq // 100) % 4 AS part FROM ({TTL}) QUALIFY row_number() OVER (PARTITION BY (seq // 100) % 4, key ORDER BY seq DESC) = 1))""")  # fmt: skip
def _(spark, d):
    log, as_of = segments(t.mutations(spark, d, ttl=True), 100), now(spark, d)
    parts = [compaction.merge(log.where(F.col("segment_id") % 4 == i), as_of, False).withColumn("part", F.lit(i).cast("long")) for i in range(4)]
    return reduce(DataFrame.unionByName, parts).select("part", "seq", "key", "value", "tombstone", "expiry_ms")


def levels_sql(log: str, rows: int) -> str:
    """A log with segment_id and level, as compaction.leveled gives it with factor 10."""
    return f"(SELECT *, CASE WHEN (last - segment_id) * 10 > last THEN 2 WHEN (last - segment_id) * 100 > last THEN 1 ELSE 0 END AS level FROM (SELECT *, seq // {rows} AS segment_id, max(seq // {rows}) OVER () AS last FROM ({log})))"


@query("kv_tombstone_gc_levels", f"WITH l AS {levels_sql(TOMB, 100)} SELECT level, key FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY level, key ORDER BY seq DESC) = 1) a WHERE tombstone AND NOT EXISTS (SELECT 1 FROM l b WHERE b.key = a.key AND b.level <> a.level)")
def _(spark, d):
    return compaction.collectable_by_level(compaction.leveled(segments(t.mutations(spark, d), 100), Settings().level_factor))


@query("kv_latency_summary", "SELECT event_type, count(*) AS n, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high, round(count(*) / (sum(value) / 1e6), 3) AS ops_per_s FROM events GROUP BY 1")
def _(spark, d):
    return measures.latency(t.table(spark, d, "events"), "value", "event_type")


@query("kv_p99_nearest_rank", "SELECT event_type, max(n)::BIGINT AS n, max(value) FILTER (r = least(n * 99 // 100, n - 1) + 1) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def _(spark, d):
    return measures.nearest_rank(t.table(spark, d, "events"), "value", 99, "event_type")


@query("kv_miss_ratio", f"WITH {REPLAY} SELECT op, count(*) AS n, count(*) FILTER (status = 'NOT_FOUND') AS misses, round(count(*) FILTER (status = 'NOT_FOUND') / count(*), 6) AS ratio FROM r GROUP BY 1")
def _(spark, d):
    return measures.misses(replay.replay(t.commands(spark, d)), "op")


@query("kv_key_windows", f"SELECT block, min(key) AS first_key, max(key) AS last_key FROM (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 10 AS block FROM {live_sql(TOMB)}) GROUP BY 1 HAVING count(*) = 10")
def _(spark, d):
    return measures.key_windows(reads.keys(t.mutations(spark, d), 0), 10)


@query("kv_spread_misses", "SELECT i, m AS miss, CASE WHEN m THEN 'bench:missing:' ELSE 'bench:key:' END || lpad(i::VARCHAR, 8, '0') AS key FROM (SELECT i, (i + 1) * 3000 // 10000 > i * 3000 // 10000 AS m FROM range(10000) t(i))")
def _(spark, d):
    return measures.bench_keys(spark, 10000, 3000)


@query("kv_zipf_reads", "SELECT rank, count(*) AS n FROM (SELECT least(floor(exp(((i * 2654435761) % 4294967296 + 0.5) / 4294967296.0 * ln(1000.0::DOUBLE)))::BIGINT - 1, 999) AS rank FROM range(20000) t(i)) GROUP BY 1")
def _(spark, d):
    return measures.zipf(spark, 20000, 1000).groupBy("rank").agg(F.count("*").alias("n"))


@query("kv_surviving_keys", "SELECT i, 'bench:key:' || lpad(i::VARCHAR, 8, '0') AS key FROM range(5000) t(i) WHERE i % 7 <> 0")
def _(spark, d):
    return measures.survivors(spark, 5000, 7)


@query("kv_prefix", f"SELECT key, value FROM {live_sql(ORDERS, "starts_with(key, 'cust:000000')")}")
def _(spark, d):
    return reads.prefix(t.orders_log(spark, d), "cust:000000", 0).select("key", "value")


@query("kv_count_range", f"SELECT count(*) AS n FROM {live_sql(ORDERS, "key BETWEEN 'cust:00000010' AND 'cust:00000090'")}")
def _(spark, d):
    return reads.span(t.orders_log(spark, d), "cust:00000010", "cust:00000090", 0).agg(F.count("*").alias("n"))


@query("kv_first_last", f"SELECT min(key) AS first_key, arg_min(value, key) AS first_value, max(key) AS last_key, arg_max(value, key) AS last_value FROM {live_sql(ORDERS)}")
def _(spark, d):
    return reads.first_last(t.orders_log(spark, d), 0)


@query("kv_scan_page", f"SELECT key, value FROM {live_sql(ORDERS, "key > 'cust:00000020'")} ORDER BY key LIMIT 25")
def _(spark, d):
    return reads.page(t.orders_log(spark, d), "cust:00000020", 25, 0).select("key", "value")


@query("kv_range_agg", f"SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM (SELECT key, value FROM ({TELEMETRY}) WHERE key BETWEEN 'click:00000005:' AND 'click:00000010:~' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)")
def _(spark, d):
    return reads.totals(reads.span(t.telemetry(spark, d), "click:00000005:", "click:00000010:~", 0))


@query("kv_incr", "SELECT event_id AS seq, user_id AS key, sum(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 10 END) OVER (PARTITION BY user_id, epoch ORDER BY event_id)::BIGINT AS counter FROM (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events)")
def _(spark, d):
    e = t.table(spark, d, "events")
    reset = F.col("event_type") == "error"
    return replay.running(e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(reset, "RESET").otherwise("INCR").alias("op"), F.when(reset, 0).otherwise(F.col("event_id") % 10).alias("by")))


@query("kv_pttl", f"SELECT key, coalesce(expiry_ms - (SELECT max({MS}) FROM events), -1) AS pttl_ms FROM {live_sql(TTL)}")
def _(spark, d):
    return reads.remaining(t.mutations(spark, d, ttl=True), now(spark, d))


LINES = """SELECT event_id, CASE event_id % 16 WHEN 0 THEN 'write k' || user_id || ' a  b ' || event_type WHEN 1 THEN 'READ k' || user_id WHEN 2 THEN 'Ttl k' || user_id || ' ' || (event_id % 5 * 10) WHEN 3 THEN 'WRITETTL k ' || (event_id % 3) || ' x y'
    WHEN 4 THEN 'MSET a 1 b' || CASE WHEN event_id % 3 = 0 THEN ' 2' ELSE '' END WHEN 5 THEN 'RANGE a z' WHEN 6 THEN 'MGET a b a' WHEN 7 THEN 'NOPE' WHEN 8 THEN 'DELETE k' || user_id WHEN 9 THEN 'exists k' || user_id WHEN 10 THEN 'Compact'
    WHEN 11 THEN 'STATS' || CASE WHEN event_id % 3 = 0 THEN ' x' ELSE '' END WHEN 12 THEN 'LIST' WHEN 13 THEN ' ping ' WHEN 14 THEN 'QUIT' ELSE 'MWRITETTL ' || (event_id % 3) || ' a 1 b' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' 2' END END AS line FROM {e}"""


@query("kv_cli_parse", f"""WITH l AS ({LINES.format(e="events")}), p AS (SELECT *, event_id % 16 AS c, string_split(trim(line), ' ') AS w FROM l),
    e AS (SELECT *, CASE WHEN c = 7 THEN 'unknown command' WHEN c = 11 AND len(w) > 1 THEN 'wrong number of operands' WHEN c IN (4, 15) AND (len(w) - CASE c WHEN 4 THEN 1 ELSE 2 END) % 2 = 1 THEN 'odd number of operands' WHEN c IN (3, 15) AND event_id % 3 = 0 THEN 'bad seconds' END AS error FROM p)
    SELECT event_id, CASE WHEN error IS NULL THEN upper(w[1]) END AS op, CASE WHEN error IS NULL AND c IN (0, 1, 2, 3, 8, 9) THEN w[2] END AS key,
    CASE WHEN c = 0 THEN substr(line, strlen(w[2]) + 8) WHEN c = 3 AND error IS NULL THEN 'x y' END AS value, CASE WHEN error IS NULL AND c IN (2, 3) THEN w[3]::BIGINT WHEN error IS NULL AND c = 15 THEN w[2]::BIGINT END AS ttl_s,
    CASE WHEN c = 5 THEN 'a' END AS start, CASE WHEN c = 5 THEN 'z' END AS "end", CASE WHEN c = 6 THEN 'a,b,a' WHEN c IN (4, 15) AND error IS NULL THEN 'a=1,b=2' END AS items, error FROM e""")  # fmt: skip
def _(spark, d):
    return language.parse(spark.sql(LINES, e=t.table(spark, d, "events"))).drop("line")


@query("kv_conversation_last", "SELECT 'conv:' || lpad(conv_id::VARCHAR, 8, '0') AS key, arg_max(text, turn) AS value FROM conversations GROUP BY 1")
def _(spark, d):
    return fold.live(t.turns(spark, d), 0).select("key", "value")


@query("kv_codec_sizes")
def _(spark, d):
    """I-50: bytes of the log under each Parquet codec, written to the shared folder."""
    from .plans.codecs import sizes

    return sizes(t.turns(spark, d))


CRC_BITS = "flatten(list_transform(string_split(key || seq, ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))"


@query("kv_crc", f"SELECT seq, key, xor(list_reduce([4294967295::BIGINT] || {CRC_BITS}, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS crc FROM ({TOMB})")
def _(spark, d):
    """The SQL folds bit by bit: each byte enters with its first bit."""
    return t.mutations(spark, d).select("seq", "key", checksum(F.col("key"), F.col("seq").cast("string")).alias("crc"))


@query("kv_ping", "SELECT 'OK' AS status, 'PONG' AS payload")
def _(spark, d):
    return spark.range(1).select(F.lit("OK").alias("status"), F.lit("PONG").alias("payload"))


@query("kv_invalid_op", "SELECT event_id AS seq, CASE WHEN event_id % 20 BETWEEN 1 AND 12 THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN event_id % 20 NOT BETWEEN 1 AND 12 THEN 'Invalid op code: ' || (event_id % 20) END AS payload FROM events")
def _(spark, d):
    status, payload = replay.by_code(F.col("event_id") % 20)
    return t.table(spark, d, "events").select(F.col("event_id").alias("seq"), status.alias("status"), payload.alias("payload"))


@query("kv_collections_default_ttl", f"SELECT event_type AS collection, count(*) AS n FROM (SELECT event_type, user_id, {MS} + coalesce(CASE WHEN event_id % 3 = 0 THEN (1 + event_id % 72) * 3600000 END, 86400000) AS x FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1) WHERE x > (SELECT max({MS}) FROM events) GROUP BY 1")
def _(spark, d):
    log = t.mutations(spark, d, ttl=True).withColumns({"tombstone": F.lit(False), "expiry_ms": F.coalesce("expiry_ms", F.col("ts_ms") + 86400000)})
    return fold.live(log, now(spark, d)).groupBy(F.split_part("key", F.lit(":"), F.lit(3)).alias("collection")).agg(F.count("*").alias("n"))


@query("kv_time_windows", f"SELECT ({MS}) // 86400000 AS day, count(*) AS n_records, count(*) FILTER (event_id % 7 = 3) AS n_tombstones FROM events GROUP BY 1")
def _(spark, d):
    return t.mutations(spark, d).groupBy(F.expr("ts_ms div 86400000").alias("day")).agg(F.count("*").alias("n_records"), F.count_if("tombstone").alias("n_tombstones"))


@query("kv_latency_quantiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def _(spark, d):
    return measures.quantiles(t.table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")


@query("kv_keep_ttl", f"""WITH l AS ({TTL}), n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), d AS (SELECT key, max(seq) FILTER (tombstone) AS cut FROM l GROUP BY 1),
    k AS (SELECT key, arg_max(expiry_ms, seq) AS e FROM l JOIN d USING (key) WHERE NOT tombstone AND expiry_ms IS NOT NULL AND (cut IS NULL OR seq > cut) GROUP BY 1),
    r AS (SELECT key, value, CASE WHEN e > ts_ms THEN e END AS expiry_ms FROM n LEFT JOIN k USING (key) WHERE NOT tombstone)
    SELECT * FROM r WHERE expiry_ms IS NULL OR expiry_ms > (SELECT max({MS}) FROM events)""")  # fmt: skip
def _(spark, d):
    return fold.kept_expiry(t.mutations(spark, d, ttl=True)).where(~F.col("tombstone") & unexpired(F.col("expiry_ms"), now(spark, d))).select("key", "value", "expiry_ms")


@query("kv_mset_items", f"""SELECT event_id AS seq, pos, 'user:' || lpad(user_id::VARCHAR, 8, '0') || CASE pos WHEN 0 THEN '' ELSE ':copy' END AS key, value,
    CASE WHEN pos = 1 AND event_id % 2 = 0 THEN 'WRITETTL' ELSE 'WRITE' END AS op, CASE WHEN pos = 1 THEN (event_id + 1) % 2 * 60 END AS ttl_s FROM events, (VALUES (0), (1)) v(pos)""")  # fmt: skip
def _(spark, d):
    key, seq = t.user_key("user_id"), F.col("event_id")
    items = F.array(F.struct(key.alias("key"), F.col("value"), F.lit(None).cast("long").alias("ttl_s")), F.struct(F.concat(key, F.lit(":copy")).alias("key"), F.col("value"), ((seq + 1) % 2 * 60).alias("ttl_s")))
    sets = t.table(spark, d, "events").select(seq.alias("seq"), F.lit(0).cast("long").alias("ts_ms"), F.lit("MSET").alias("op"), items.alias("items"))
    return replay.exploded(sets).drop("ts_ms")


@query("kv_range_modes", "SELECT mode, op, CASE WHEN op = 'NOPE' OR (op = 'RANGE' AND mode = 'hash') THEN 'ERROR' ELSE 'OK' END AS status FROM (VALUES ('sorted'), ('hash')) m(mode), (VALUES ('READ'), ('RANGE'), ('LIST'), ('NOPE')) o(op)")
def _(spark, d):
    ops = spark.createDataFrame([("READ",), ("RANGE",), ("LIST",), ("NOPE",)], "op string")
    sorted_mode, hash_mode = (ops.select(F.lit(m).alias("mode"), "op", replay.answerable(F.col("op"), m).alias("status")) for m in ("sorted", "hash"))
    return sorted_mode.unionByName(hash_mode)


@query("kv_record_bytes", "SELECT sum(21 + 13 + coalesce(strlen(text), 0))::BIGINT AS record_bytes, sum(13 + coalesce(strlen(text), 0))::BIGINT AS memory_bytes FROM conversations")
def _(spark, d):
    at = F.col("key"), F.col("value"), F.col("expiry_ms")
    return t.turns(spark, d).agg(F.sum(record_size(*at)).alias("record_bytes"), F.sum(memory_size(*at)).alias("memory_bytes"))


@query("kv_store_info", f"SELECT count(*) AS segments, sum(n_records)::BIGINT AS n_records, sum(n_tombstones)::BIGINT AS n_tombstones, sum(bytes)::BIGINT AS bytes, min(min_key) AS min_key, max(max_key) AS max_key FROM ({ZONES})")
def _(spark, d):
    return compaction.summary(compaction.zone_map(segments(t.mutations(spark, d, ttl=True))))


@query("kv_size_tiers", f"""WITH RECURSIVE z AS (SELECT floor(log2(greatest(seq, 1) / 3 + 1))::BIGINT AS segment_id, sum({SIZE})::BIGINT AS bytes FROM ({TTL}) GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY segment_id) AS i FROM z),
    f AS (SELECT 0::BIGINT AS i, []::STRUCT(s BIGINT, n BIGINT)[] AS b, 0::BIGINT AS k UNION ALL
        SELECT i, CASE WHEN k IS NULL THEN list_append(b, {{'s': bytes, 'n': 1}}) ELSE list_transform(b, lambda e, j: CASE WHEN j = k THEN {{'s': e.s + bytes, 'n': e.n + 1}} ELSE e END) END, coalesce(k, len(b) + 1) FROM (
            SELECT o.i, o.bytes, f.b, list_sort(list_filter(list_transform(f.b, lambda e, j: {{'d': abs(e.s / e.n - o.bytes), 'j': j, 'ok': 0.5 * (e.s / e.n) <= o.bytes AND o.bytes <= 1.5 * (e.s / e.n)}}), lambda c: c.ok))[1].j AS k FROM f JOIN o ON o.i = f.i + 1))
    SELECT segment_id, bytes, (k - 1)::INT AS bucket, count(*) OVER (PARTITION BY k) >= 4 AS due FROM f JOIN o USING (i)""")  # fmt: skip
def _(spark, d):
    """I-12, I-13: segments that double in size, dealt into tiers."""
    log = t.mutations(spark, d, ttl=True).withColumn("segment_id", F.floor(F.log2(F.greatest("seq", F.lit(1)) / 3 + 1)))
    return compaction.tier_table(compaction.zone_map(log), Settings())


@query("kv_overwrite_rounds", "SELECT 'bench:key:' || lpad(i::VARCHAR, 8, '0') AS key, 2::BIGINT AS value FROM range(5000) t(i)")
def _(spark, d):
    return fold.live(measures.rounds(spark, 5000, 3), 0).select("key", "value")


@query("kv_compare_systems", """SELECT metric, round(a, 4) AS base_rate, round(b, 4) AS other_rate, round(100 * (b - a) / nullif(a, 0), 4) AS percent FROM
    (SELECT 'user ' || user_id AS metric, avg(event_id) FILTER (event_type = 'view') AS a, avg(event_id) FILTER (event_type = 'click') AS b FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)""")  # fmt: skip
def _(spark, d):
    lines = t.table(spark, d, "events").where(F.col("event_type").isin("view", "click")).select(F.col("event_type").alias("system"), F.concat(F.lit("user "), F.col("user_id"), F.lit(": "), F.col("event_id"), F.lit(" ops/s")).alias("line"))
    return measures.compared(lines, "view", "click")


@query("kv_latency_histogram", "SELECT event_type, floor(value / 25) * 25.0::DOUBLE AS low, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return measures.histogram(t.table(spark, d, "events"), "value", 25.0, "event_type")


SETS = """SELECT event_id AS seq, pos, CASE WHEN pos = 2 THEN 'shared' ELSE 'user:' || lpad(user_id::VARCHAR, 8, '0') END AS key, value + pos AS value, CASE WHEN pos = 1 THEN event_id % 3 * 3600000 ELSE 0 END AS ttl_ms, epoch_us(ts) // 1000 AS ts_ms FROM events, (VALUES (0), (1), (2)) v(pos)"""


@query("kv_mset_live", f"SELECT key, value, CASE WHEN ttl_ms > 0 THEN ts_ms + ttl_ms END AS expiry_ms FROM (SELECT * FROM ({SETS}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, pos DESC) = 1) WHERE ttl_ms = 0 OR ts_ms + ttl_ms > (SELECT max({MS}) FROM events)")
def _(spark, d):
    """MSET and MWRITETTL folded: the last item for a key stands, in a command and over all of them."""
    log, n = t.commands(spark, d).withColumn("value", F.lit(None)), F.col("seq")
    e = t.table(spark, d, "events").select(F.col("event_id").alias("seq"), "value")
    item = lambda key, plus, ttl: F.struct(key.alias("key"), (F.col("value") + plus).alias("value"), ttl.cast("long").alias("ttl_s"))
    items = F.array(item(F.col("key"), 0, F.lit(0)), item(F.col("key"), 1, n % 3 * 3600), item(F.lit("shared"), 2, F.lit(0)))
    sets = log.drop("value").join(e, "seq").select("seq", "ts_ms", F.lit("MSET").alias("op"), items.alias("items"))
    return fold.live(replay.applied(replay.exploded(sets), "pos"), now(spark, d))


def store_of(spark, d, settings: Settings, step, chunks: int = 4) -> Store:
    """A store in the shared folder that takes the table's log in flushes by seq; step(store, instant) runs after each."""
    log = t.mutations(spark, d, ttl=True).withColumn("value", F.col("seq").cast("string"))
    last, as_of = log.agg(F.max("seq"), F.max("ts_ms")).first()
    store = Store(spark, scratch(spark, "store"), settings, clock=lambda: as_of or 0)
    for i in range(chunks):
        part = F.expr(f"seq * {chunks} div {(last or 0) + 1}")
        store.append(log.where(part == i), batch=i, stream="events")
        step(store, as_of or 0)
        store.append(log.where(part == i), batch=i, stream="events")  # known: it is not written again
    return store


STORED = TTL.replace(", value,", ", event_id::VARCHAR AS value,")


@query("kv_store_live", f"SELECT key, value, expiry_ms FROM {live_sql(STORED)}")
def _(spark, d):
    """Flushes with a full compaction after every second, read back."""
    store = store_of(spark, d, Settings(), lambda s, at: s.state()["batches"]["events"] % 2 == 1 and s.compact(at))
    return store.live(now(spark, d))


@query("kv_store_range", f"SELECT key, value FROM {live_sql(STORED, "key BETWEEN 'user:00000002' AND 'user:00000009:view'")}")
def _(spark, d):
    """A range out of leveled segments, of which the key ranges leave few to read."""
    settings = Settings(strategy="leveled", level0_files=2, level1_bytes=100_000, segment_bytes=100_000, levels=3)
    store = store_of(spark, d, settings, lambda s, at: s.settle(at))
    return store.span("user:00000002", "user:00000009:view", now(spark, d)).select("key", "value")


@query("kv_store_tiers_live", f"SELECT key, value, expiry_ms FROM {live_sql(STORED)}")
def _(spark, d):
    """Size tiers merged until none is due."""
    return store_of(spark, d, Settings(tier_files=2), lambda s, at: s.settle(at)).live(now(spark, d))


@query("kv_stats", f"""WITH {REPLAY}, s AS (SELECT count(*) FILTER (op = 'READ') AS reads, count(*) FILTER (op IN ('WRITE', 'WRITETTL')) AS writes, count(*) FILTER (op = 'DELETE') AS deletes, 0::BIGINT AS compacting, 2::BIGINT AS compaction_count,
    (SELECT max({MS}) FROM events) AS last_compact_start_ms, (SELECT max({MS}) FROM events) AS last_compact_end_ms, 0::BIGINT AS write_blocked_attempts, 0::BIGINT AS write_blocked_total_ms, 0::BIGINT AS active_connections FROM r)
    UNPIVOT s ON COLUMNS(*) INTO NAME name VALUE value""")  # fmt: skip
def _(spark, d):
    """STATS of a store with two compactions, by a clock that stands at the log's last instant."""
    store = store_of(spark, d, Settings(), lambda s, at: s.state()["batches"]["events"] % 2 == 1 and s.compact(at))
    return replay.stats(replay.replay(t.commands(spark, d)), store.counters())


@query("kv_expiry_counters", f"""WITH {REPLAY} SELECT 'expired_reads' AS name, count(*) AS value FROM r WHERE op = 'READ' AND status = 'NOT_FOUND' AND head_op IN ('WRITE', 'WRITETTL')
    UNION ALL SELECT 'expired_compacted', count(*) FROM (SELECT * FROM ({TTL}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone AND expiry_ms <= (SELECT max({MS}) FROM events)""".replace("SELECT c5.seq, c5.key, op,", "SELECT c5.seq, c5.key, op, head AS head_op,"))  # fmt: skip
def _(spark, d):
    return replay.expiry_counters(replay.replay(t.commands(spark, d)), t.mutations(spark, d, ttl=True), now(spark, d))


@query("kv_window_compaction", f"""SELECT "window", seq, key, CASE WHEN NOT gone THEN value END AS value, gone AS tombstone, CASE WHEN NOT gone THEN expiry_ms END AS expiry_ms
    FROM (SELECT *, ts_ms // 86400000 AS "window", tombstone OR coalesce(expiry_ms <= (SELECT max({MS}) FROM events), false) AS gone FROM ({TTL}) QUALIFY row_number() OVER (PARTITION BY ts_ms // 86400000, key ORDER BY seq DESC) = 1)""")  # fmt: skip
def _(spark, d):
    return compaction.merge_by_window(t.mutations(spark, d, ttl=True), 86_400_000, now(spark, d)).select("window", "seq", "key", "value", "tombstone", "expiry_ms")


SHARD = "(SELECT key, arg_max(s, md5(key || '#' || s)) AS shard FROM (SELECT key FROM {log}), range({n}) r(s) GROUP BY key)"


@query("kv_shards", f"SELECT key, shard::INT AS shard FROM {SHARD.format(log=live_sql(TTL), n=8)}")
def _(spark, d):
    return reads.keys(t.mutations(spark, d, ttl=True), now(spark, d)).select("key", shards.by_hash(F.col("key"), 8).alias("shard"))


@query("kv_shard_moves", f"SELECT a.key, a.shard::INT AS before, b.shard::INT AS after FROM {SHARD.format(log=live_sql(TTL), n=8)} a JOIN {SHARD.format(log=live_sql(TTL), n=9)} b USING (key) WHERE a.shard <> b.shard")
def _(spark, d):
    return shards.moved(reads.keys(t.mutations(spark, d, ttl=True), now(spark, d)), 8, 9)


MODES = """SELECT mode, client::INT AS client, seq, op, CASE WHEN op = 'READ' AND (i + 1) * 600 // 2000 > i * 600 // 2000 THEN 'bench:missing:' ELSE 'bench:key:' END || lpad(i::VARCHAR, 8, '0') AS key FROM (
    SELECT 'sequential' AS mode, 0 AS client, i AS seq, 'WRITE' AS op, i FROM range(2000) t(i) UNION ALL SELECT 'sequential', 0, i + 2000, 'READ', i FROM range(2000) t(i) UNION ALL SELECT 'sequential', 0, i + 4000, 'DELETE', i FROM range(200) t(i)
    UNION ALL SELECT 'concurrent', i % 2, 2 * i, 'WRITE', i FROM range(2000) t(i) UNION ALL SELECT 'concurrent', 2 + i % 4, 2 * i + 1, 'READ', i FROM range(2000) t(i)
    UNION ALL SELECT 'mixed', 0, 2 * i, 'WRITE', i FROM range(2000) t(i) UNION ALL SELECT 'mixed', 0, 2 * i + 1, 'READ', i FROM range(2000) t(i))"""


def workloads(spark) -> DataFrame:
    return reduce(DataFrame.unionByName, [measures.workload(spark, mode, 2000, 600, 200) for mode in ("sequential", "concurrent", "mixed")])


@query("kv_workloads", MODES)
def _(spark, d):
    return workloads(spark).select("mode", "client", "seq", "op", "key")


@query("kv_workload_statuses", f"SELECT mode, op, CASE WHEN key LIKE 'bench:missing:%' THEN 'NOT_FOUND' ELSE 'OK' END AS status, count(*) AS n FROM ({MODES}) GROUP BY ALL")
def _(spark, d):
    """Each mode's commands replayed by themselves."""
    parts = [replay.replay(workloads(spark).where(F.col("mode") == mode)) for mode in ("sequential", "concurrent", "mixed")]
    return reduce(DataFrame.unionByName, parts).groupBy("mode", "op", "status").agg(F.count("*").alias("n"))
