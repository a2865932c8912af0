"""Registry of the state engine's queries, each with the SQL that must give the same rows.

The change logs come of the driver's tables: `events` is the log of a list state (signup puts, error deletes, all else
merges), split into keyspaces, runs or with range deletes where an operator needs them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import filters, keys, merge, scalar
from tidelog.operators import compaction, reads, state, stats, writes
from tidelog.plans import resolve as plans
from tidelog.schema import DEFAULT_CF, DELETE_RANGE
from tidelog.sources import filenames
from tidelog.sources.durable import scratch
from tidelog.sources.store import Store
from tidelog.streaming import ingest
from tidelog.streaming.state import STORE_PROVIDER, Appender, Counter, Fields, keep_state

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidelog import store_queries  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from tidelog import store_queries  # noqa: F401

    return dict(_oracles)


# -- logs ---------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list state's log: one record per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit(DEFAULT_CF).alias("cf"),
        F.floor(F.col("event_id") / 100).alias("batch_id"),
        (F.col("event_id") % 100).cast("int").alias("ordinal"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "error", "delete").otherwise("merge").alias("op"),
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.lit(None).cast("binary").alias("end_key"),
        F.col("event_type").cast("binary").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


#: Literal range deletes: begin, end, sequence number.
RANGES = ((b"1", b"12", 3000), (b"30", b"5", 700), (b"7", b"71", 6000), (b"30", b"31", 9000))


def ranged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(DEFAULT_CF, -1, i, seq, DELETE_RANGE, bytearray(b), bytearray(e), None, None) for i, (b, e, seq) in enumerate(RANGES)]
    log = event_log(spark, sf_dir)
    return log.unionByName(spark.createDataFrame(rows, "cf string, batch_id long, ordinal int, seq long, op string, key binary, end_key binary, value binary, ts timestamp"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value state keyed by customer and order: `custkey:orderkey`, both padded."""
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit(":"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    return o.select(
        F.lit(DEFAULT_CF).alias("cf"),
        (F.col("o_orderkey") + 1).alias("seq"),
        F.lit("put").alias("op"),
        key.cast("binary").alias("key"),
        F.lit(None).cast("binary").alias("end_key"),
        F.col("o_orderpriority").cast("binary").alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log cut into runs of 2,500 events; the oldest run is level 1."""
    run = F.floor((F.col("seq") - 1) / 2500).cast("long")
    return event_log(spark, sf_dir).withColumn("run_id", run).withColumn("level", F.when(run == 0, 1).otherwise(0))


def readable(df: DataFrame) -> DataFrame:
    """Keys and values as text, so that results compare as text."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


EVENTS = """SELECT 'default' AS cf, event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op,
CAST(user_id AS VARCHAR) AS k, event_type AS v, ts FROM events"""
RANGE_ROWS = "(VALUES " + ", ".join(f"('{b.decode()}', '{e.decode()}', {s})" for b, e, s in RANGES) + ") AS r(lo, hi, rseq)"
ORDERS = """SELECT 'default' AS cf, o_orderkey + 1 AS seq, 'put' AS op, lpad(CAST(o_custkey AS VARCHAR), 8, '0') || ':' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS k,
o_orderpriority AS v, o_orderdate AS ts FROM orders"""


def resolved(log: str = EVENTS, where: str = "TRUE", value: str = "string_agg(v, ',' ORDER BY seq)") -> str:
    """SQL for the state of a log."""
    return f"""(WITH l AS (SELECT * FROM ({log}) WHERE {where}),
b AS (SELECT cf, k, max(seq) AS bs FROM l WHERE op <> 'merge' GROUP BY cf, k),
j AS (SELECT l.*, coalesce(b.bs, -1) AS bs FROM l LEFT JOIN b ON l.cf = b.cf AND l.k = b.k)
SELECT cf, k AS key, {value} AS value, max(seq) AS seq, CAST(count(*) FILTER (op = 'merge') AS INTEGER) AS n_operands
FROM j WHERE (seq = bs AND op = 'put') OR (seq > bs AND op = 'merge') GROUP BY cf, k)"""


RANGED = f"SELECT * FROM ({EVENTS}) e WHERE NOT EXISTS (SELECT 1 FROM {RANGE_ROWS} WHERE e.k >= lo AND e.k < hi AND e.seq < rseq)"


# -- state and reads ----------------------------------------------------------------------------------------------


@query(f"SELECT * FROM {resolved()}")
def resolve_latest(spark, sf_dir):
    return readable(plans.resolve(event_log(spark, sf_dir)))


@query(f"SELECT * FROM {resolved(where='seq <= 5000')}")
def resolve_snapshot(spark, sf_dir):
    return readable(plans.resolve(event_log(spark, sf_dir), read_seq=5000))


@query(f"SELECT * FROM {resolved(RANGED)}")
def resolve_range_deletes(spark, sf_dir):
    return readable(plans.resolve(ranged_log(spark, sf_dir)))


@query(f"SELECT * FROM {resolved(f'SELECT * FROM ({EVENTS}) e WHERE seq <= 5000 AND NOT EXISTS (SELECT 1 FROM {RANGE_ROWS} WHERE rseq <= 5000 AND e.k >= lo AND e.k < hi AND e.seq < rseq)')}")
def resolve_range_deletes_snapshot(spark, sf_dir):
    return readable(plans.resolve(ranged_log(spark, sf_dir), read_seq=5000))


@query(f"SELECT * FROM {resolved(RANGED)}")
def range_deletes_by_bucket(spark, sf_dir):
    """The plan for very many range deletes, forced."""
    log = ranged_log(spark, sf_dir)
    points = plans.hide_ranges(log.where(F.col("op") != DELETE_RANGE), log.where(F.col("op") == DELETE_RANGE), broadcast_ranges=1)
    return readable(plans.resolve(points))


@query(f"SELECT cf, key, value FROM {resolved(where=chr(107) + ' = ' + chr(39) + '42' + chr(39))}")
def point_get(spark, sf_dir):
    return readable(reads.get(event_log(spark, sf_dir), b"42").select("cf", "key", "value"))


WANTED = (b"7", b"42", b"no such key", b"7", b"100", b"")
WANTED_ROWS = "(VALUES " + ", ".join(f"({i}, '{k.decode()}')" for i, k in enumerate(WANTED)) + ") AS w(pos, key)"


@query(f"SELECT w.pos, w.key, s.value FROM {WANTED_ROWS} LEFT JOIN {resolved()} s ON s.key = w.key")
def multi_get(spark, sf_dir):
    return readable(reads.multi_get(event_log(spark, sf_dir), WANTED))


@query(f"SELECT w.pos, w.key, s.value FROM {WANTED_ROWS} LEFT JOIN {resolved(where='seq <= 2000')} s ON s.key = w.key")
def multi_get_snapshot(spark, sf_dir):
    return readable(reads.multi_get(event_log(spark, sf_dir), WANTED, read_seq=2000))


@query(f"SELECT c_custkey AS pos, CAST(c_custkey AS VARCHAR) AS key, s.value FROM customer LEFT JOIN {resolved()} s ON s.key = CAST(c_custkey AS VARCHAR)")
def multi_get_table(spark, sf_dir):
    """Requests of any number: a table of keys."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").cast("binary").alias("key"))
    return readable(reads.multi_get(event_log(spark, sf_dir), asked))


SPACES = "SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS cf, seq, op, k, v, ts FROM (SELECT user_id, event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op, CAST(user_id % 10 AS VARCHAR) AS k, event_type AS v, ts FROM events)"


def spaced_log(spark, sf_dir):
    log, number = event_log(spark, sf_dir), F.col("key").cast("string").cast("long")
    return log.withColumn("cf", F.when(number % 2 == 0, "even").otherwise("odd")).withColumn("key", (number % 10).cast("string").cast("binary"))


@query(f"SELECT * FROM {resolved(SPACES)}")
def scan_all_keyspaces(spark, sf_dir):
    return readable(reads.scan(spaced_log(spark, sf_dir), None))


@query(f"SELECT * FROM {resolved(SPACES)} WHERE cf = 'odd'")
def scan_keyspace(spark, sf_dir):
    return readable(reads.scan(spaced_log(spark, sf_dir), "odd"))


@query(f"SELECT * FROM {resolved(SPACES, where='seq <= 4000')} WHERE cf = 'odd'")
def scan_keyspace_snapshot(spark, sf_dir):
    return readable(reads.scan(spaced_log(spark, sf_dir), "odd", read_seq=4000))


@query(f"SELECT key, value FROM {resolved(ORDERS)} WHERE starts_with(key, '000000')")
def prefix_scan(spark, sf_dir):
    """Every key under the prefix."""
    return readable(reads.prefix_scan(order_log(spark, sf_dir), b"000000").select("key", "value"))


@query(f"SELECT key, value FROM {resolved(ORDERS)} WHERE key >= '00000050' AND key < '00000075:'")
def range_scan(spark, sf_dir):
    return readable(reads.range_scan(order_log(spark, sf_dir), b"00000050", b"00000075:").select("key", "value"))


@query(f"""WITH s AS (SELECT key, value FROM {resolved(ORDERS)})
SELECT * FROM (SELECT 'first' AS how, * FROM s ORDER BY key LIMIT 1) UNION ALL SELECT * FROM (SELECT 'last', * FROM s ORDER BY key DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'seek', * FROM s WHERE key >= '00000077' ORDER BY key LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'seek_for_prev', * FROM s WHERE key <= '00000077' ORDER BY key DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'seek beyond the end', * FROM s WHERE key >= 'z' ORDER BY key LIMIT 1)""")
def seeks(spark, sf_dir):
    s = reads.scan(order_log(spark, sf_dir)).select("key", "value")
    found = {
        "first": reads.seek_to_first(s), "last": reads.seek_to_last(s), "seek": reads.seek(s, b"00000077"),
        "seek_for_prev": reads.seek_for_prev(s, b"00000077"), "seek beyond the end": reads.seek(s, b"z"),
    }
    out = None
    for how, df in found.items():
        part = df.select(F.lit(how).alias("how"), "key", "value")
        out = part if out is None else out.unionByName(part)
    return readable(out)


@query(f"SELECT key, value FROM {resolved(ORDERS)} WHERE key > '00000042:' ORDER BY key LIMIT 100")
def next_chunk(spark, sf_dir):
    return readable(reads.next_chunk(reads.scan(order_log(spark, sf_dir)), b"00000042:", 100).select("key", "value"))


@query(f"SELECT key, value FROM {resolved(ORDERS)} WHERE key < '00000042:' ORDER BY key DESC LIMIT 50")
def prev_chunk(spark, sf_dir):
    return readable(reads.prev_chunk(reads.scan(order_log(spark, sf_dir)), b"00000042:", 50).select("key", "value"))


@query(f"SELECT key, CAST((row_number() OVER (ORDER BY key) - 1) // 1024 AS BIGINT) AS chunk FROM {resolved(ORDERS)}")
def chunked_scan(spark, sf_dir):
    return readable(reads.numbered_chunks(reads.scan(order_log(spark, sf_dir)).select("key"), 1024))


@query(f"""WITH s AS (SELECT substr(key, 1, 8) AS c, key, value FROM {resolved(ORDERS)}),
u AS (SELECT c, count(*) AS n, string_agg(lpad(hex(strlen(key)), 8, '0') || hex(key) || lpad(hex(strlen(value)), 8, '0') || hex(value), '' ORDER BY key) AS body FROM s GROUP BY c)
SELECT c AS customer, lpad(hex(n), 8, '0') || body AS packed_hex FROM u""")
def packed_chunks(spark, sf_dir):
    s = reads.scan(order_log(spark, sf_dir)).withColumn("customer", F.substring(F.col("key").cast("string"), 1, 8))
    return reads.pack_chunk(s, "customer").select("customer", F.hex("packed").alias("packed_hex"))


@query(f"SELECT substr(key, 1, 8) AS customer, key, value FROM {resolved(ORDERS)}")
def unpacked_chunks(spark, sf_dir):
    s = reads.scan(order_log(spark, sf_dir)).withColumn("customer", F.substring(F.col("key").cast("string"), 1, 8))
    return readable(reads.unpacked(reads.pack_chunk(s, "customer")))


@query(f"SELECT cf, hex(k) AS key_hex, seq, op, hex(v) AS value_hex FROM ({EVENTS})")
def all_versions(spark, sf_dir):
    return reads.all_versions(event_log(spark, sf_dir))


@query(f"SELECT cf, k AS key, op, v AS value, seq, lead(seq) OVER (PARTITION BY cf, k ORDER BY seq) AS next_seq FROM ({EVENTS})")
def version_intervals(spark, sf_dir):
    return readable(plans.intervals(event_log(spark, sf_dir)))


RUNNING = f"""(WITH l AS (SELECT * FROM ({EVENTS})), g AS (SELECT *, sum(CASE WHEN op <> 'merge' THEN 1 ELSE 0 END) OVER (PARTITION BY cf, k ORDER BY seq) AS grp FROM l)
SELECT cf, k AS key, seq, op, string_agg(CASE WHEN op <> 'delete' THEN v END, ',') OVER (PARTITION BY cf, k, grp ORDER BY seq) AS value FROM g)"""


@query(f"SELECT * FROM {RUNNING}")
def running_merge(spark, sf_dir):
    return readable(plans.running(event_log(spark, sf_dir)))


@query(f"""WITH s AS (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until FROM {RUNNING}),
p AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k, o_orderkey % (SELECT max(event_id) + 2 FROM events) AS t FROM orders)
SELECT o_orderkey AS probe_id, k AS key, t AS at, s.value FROM p LEFT JOIN s ON s.key = k AND s.seq <= t AND (s.until IS NULL OR t < s.until)""")
def as_of_join(spark, sf_dir):
    """Probe times from before the log's first record to its last."""
    log = event_log(spark, sf_dir)
    times = log.agg((F.max("seq") + 1).alias("times"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(times))
    probes = o.select(F.col("o_orderkey").alias("probe_id"), F.col("o_custkey").cast("string").cast("binary").alias("key"), (F.col("o_orderkey") % F.col("times")).alias("at"))
    return readable(reads.as_of(probes, log))


@query(" UNION ALL ".join(f"SELECT cf, CAST({s} AS BIGINT) AS snapshot, key, value FROM {resolved(RANGED if False else EVENTS, where=f'seq <= {s}')}" for s in (1000, 5000, 9000)))
def multi_snapshot(spark, sf_dir):
    return readable(reads.multi_snapshot(event_log(spark, sf_dir), (1000, 5000, 9000)))


@query(f"SELECT key, value FROM {resolved()} ORDER BY key DESC LIMIT 25")
def reverse_scan(spark, sf_dir):
    return readable(reads.prev_chunk(reads.scan(event_log(spark, sf_dir)), None, 25).select("key", "value"))


@query(f"SELECT DISTINCT k AS key FROM ({EVENTS}) EXCEPT SELECT key FROM {resolved()}")
def deleted_keys(spark, sf_dir):
    """Keys that the log knows and the state lacks."""
    log = event_log(spark, sf_dir)
    return readable(log.select("key").distinct().join(reads.scan(log).select("key"), "key", "left_anti"))


# -- merge operators ----------------------------------------------------------------------------------------------


@query(f"""SELECT cf, key, CASE WHEN n_operands = 0 THEN base ELSE newest END AS value FROM (SELECT cf, key, n_operands, value AS base, newest FROM
(SELECT s.*, (SELECT max(v) FROM ({EVENTS}) e WHERE e.seq = s.seq) AS newest FROM {resolved()} s))""")
def merge_newest_operand(spark, sf_dir):
    return readable(plans.resolve(event_log(spark, sf_dir), merge=merge.newest()).select("cf", "key", "value"))


@query(f"""SELECT cf, key, value, seq, n_operands FROM {resolved(value="list_reduce(list_prepend('', list(v ORDER BY seq)), lambda a, x: CASE WHEN a = '' THEN x ELSE a || ',' || x END)",
log=EVENTS.replace('event_type AS v', "CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS v"))}""")
def merge_with_empty_elements(spark, sf_dir):
    """Leading empty elements vanish, later ones leave their delimiter."""
    log = event_log(spark, sf_dir)
    return readable(plans.resolve(log.withColumn("value", F.when(F.col("value") == F.lit("click").cast("binary"), F.lit("").cast("binary")).otherwise(F.col("value")))))


COUNTED = EVENTS.replace("event_type AS v", "event_id % 7 AS v")


@query(f"SELECT cf, key, CAST(value AS VARCHAR) AS value, seq, n_operands FROM {resolved(COUNTED, value='CAST(sum(v) AS BIGINT)')}")
def merge_counter(spark, sf_dir):
    """An operator that combines partially."""
    log = event_log(spark, sf_dir).withColumn("value", ((F.col("seq") - 1) % 7).cast("string").cast("binary"))
    return readable(plans.resolve(log, merge=merge.counter()))


@query(f"SELECT cf, key, value, seq, n_operands FROM {resolved(value='max(v)')}")
def merge_maximum(spark, sf_dir):
    return readable(plans.resolve(event_log(spark, sf_dir), merge=merge.maximum()))


@query(f"SELECT cf, k AS key, list(v ORDER BY seq) AS operands FROM ({EVENTS}) WHERE op = 'merge' GROUP BY cf, k".replace("list(v ORDER BY seq)", "string_agg(v, '|' ORDER BY seq)"))
def merge_operand_lists(spark, sf_dir):
    log = event_log(spark, sf_dir).where("op = 'merge'")
    pairs = F.sort_array(F.collect_list(F.struct("seq", F.col("value").cast("string").alias("v"))))
    return readable(log.groupBy("cf", "key").agg(F.array_join(F.transform(pairs, lambda x: x.v), "|").alias("operands")))


# -- batches and sequence numbers ---------------------------------------------------------------------------------


@query(f"""SELECT CAST((seq - 1) // 100 AS BIGINT) AS batch_id, op, count(*) AS n, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS n_bytes FROM ({EVENTS}) GROUP BY 1, 2""")
def batch_replay(spark, sf_dir):
    return writes.replay_counts(event_log(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 500 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq FROM lineitem")
def assign_sequence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return writes.assign_sequence(lines.select(*order), order, 500).select("l_orderkey", "l_linenumber", "l_partkey", "seq")


# -- runs ---------------------------------------------------------------------------------------------------------

RUNS = f"""(SELECT cf, CAST((seq - 1) // 2500 AS BIGINT) AS run_id, CASE WHEN (seq - 1) // 2500 = 0 THEN 1 ELSE 0 END AS level, count(*) AS n_entries,
CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS size, min(k) AS smallest_key, max(k) AS largest_key, min(seq) AS min_seq, max(seq) AS max_seq,
count(*) FILTER (op = 'merge') AS n_merges FROM ({EVENTS}) GROUP BY 1, 2, 3)"""


def run_table(spark, sf_dir):
    meta = stats.run_metadata(run_log(spark, sf_dir))
    return meta.withColumn("level", F.when(F.col("run_id") == 0, 1).otherwise(0))


@query(f"SELECT * EXCLUDE (level) FROM {RUNS}")
def live_file_metadata(spark, sf_dir):
    return readable(stats.run_metadata(run_log(spark, sf_dir)))


@query(f"SELECT * FROM {resolved()}")
def merge_of_runs(spark, sf_dir):
    """The union of all runs resolves as the log does."""
    log, out = run_log(spark, sf_dir), None
    for i in range(4):
        part = log.where(F.col("run_id") % 4 == i).drop("run_id", "level")
        out = part if out is None else out.unionByName(part)
    return readable(plans.resolve(out))


@query(f"SELECT run_id FROM {RUNS} WHERE (smallest_key >= '1' AND largest_key < '5') OR (smallest_key >= '0' AND largest_key < '~')")
def delete_files_in_ranges(spark, sf_dir):
    ranges = spark.createDataFrame([(bytearray(b"1"), bytearray(b"5")), (bytearray(b"0"), bytearray(b"~"))], "begin binary, end binary")
    return compaction.covered_runs(run_table(spark, sf_dir), ranges).select("run_id")


@query(f"""WITH r AS (SELECT * FROM {RUNS}), f AS (SELECT cf, min(smallest_key) AS lo, max(largest_key) AS hi FROM r WHERE level = 0 GROUP BY cf)
SELECT r.cf, run_id FROM r JOIN f ON r.cf = f.cf WHERE level = 1 AND largest_key >= lo AND smallest_key <= hi""")
def overlapping_runs(spark, sf_dir):
    return compaction.overlapping(run_table(spark, sf_dir))


@query(f"""SELECT cf, CASE WHEN count(*) FILTER (level = 0) >= 3 THEN string_agg(CAST(run_id AS VARCHAR), ',' ORDER BY run_id) END AS picked FROM {RUNS} GROUP BY cf""")
def compaction_pick(spark, sf_dir):
    """The picker works on the run list, which is as small as a manifest."""
    runs = [r.asDict() for r in run_table(spark, sf_dir).collect()]
    plan = compaction.pick(runs, {DEFAULT_CF: 3})
    picked = ",".join(map(str, sorted(plan["runs"]))) if plan else None
    return spark.createDataFrame([(DEFAULT_CF, picked)], "cf string, picked string")


#: Properties of write buffers, caches and deeper levels, which are always zero.
ZEROS = (
    *(f"num-files-at-level{i}" for i in range(2, 7)), "num-running-compactions", "num-running-flushes", "actual-delayed-write-rate", "num-immutable-mem-table",
    "mem-table-flush-pending", "block-cache-capacity", "block-cache-usage", "cur-size-active-mem-table", "cur-size-all-mem-tables", "size-all-mem-tables",
    "num-entries-active-mem-table",
)


@query(f"""WITH r AS (SELECT * FROM {RUNS}) SELECT cf, name, CAST(value AS BIGINT) AS value FROM (
SELECT cf, 'num-files-at-level0' AS name, count(*) FILTER (level = 0) AS value FROM r GROUP BY cf UNION ALL
SELECT cf, 'num-files-at-level1', count(*) FILTER (level = 1) FROM r GROUP BY cf UNION ALL
SELECT cf, 'total-sst-files-size', sum(size) FROM r GROUP BY cf UNION ALL
SELECT cf, 'estimate-pending-compaction-bytes', coalesce(sum(size) FILTER (level = 0), 0) FROM r GROUP BY cf UNION ALL
SELECT cf, 'compaction-pending', CASE WHEN count(*) FILTER (level = 0) >= 4 THEN 1 ELSE 0 END FROM r GROUP BY cf UNION ALL
SELECT cf, 'is-write-stopped', CASE WHEN count(*) FILTER (level = 0) >= 36 THEN 1 ELSE 0 END FROM r GROUP BY cf UNION ALL
SELECT cf, 'live-sst-files-size', sum(size) FROM r GROUP BY cf UNION ALL
SELECT DISTINCT cf, z.name, 0 FROM r, (VALUES {', '.join(f"('{n}')" for n in ZEROS)}) AS z(name))""")
def engine_properties(spark, sf_dir):
    return stats.properties(run_table(spark, sf_dir))


# -- compaction and time to live ----------------------------------------------------------------------------------

NOW_MS, TTL_MS = 1706659200000, 7 * 24 * 3600 * 1000  # 2024-01-31, seven days


@query(f"""WITH l AS ({EVENTS}), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS t,
row_number() OVER (PARTITION BY k, seq <= 4000 ORDER BY seq DESC) AS u FROM l)
SELECT cf, k AS key, seq, op, v AS value FROM n WHERE t = 1 OR seq > 4000 OR u = 1""")
def retention(spark, sf_dir):
    return readable(compaction.retained(event_log(spark, sf_dir), (4000, 7000)).select("cf", "key", "seq", "op", "value"))


@query(f"SELECT cf, key, seq, 'put' AS op, value FROM {resolved()}")
def compact_log(spark, sf_dir):
    return readable(compaction.compact(event_log(spark, sf_dir)).select("cf", "key", "seq", "op", "value"))


@query(f"SELECT cf, key, value, seq FROM {resolved(RANGED)}")
def compact_then_read(spark, sf_dir):
    compacted = compaction.compact(ranged_log(spark, sf_dir), snapshots=(2500, 7000))
    return readable(plans.resolve(compacted).select("cf", "key", "value", "seq"))


@query(f"SELECT cf, key, value FROM {resolved(f'SELECT * FROM ({EVENTS}) e WHERE seq <= 2500 AND NOT EXISTS (SELECT 1 FROM {RANGE_ROWS} WHERE rseq <= 2500 AND e.k >= lo AND e.k < hi AND e.seq < rseq)')}")
def compact_then_read_snapshot(spark, sf_dir):
    compacted = compaction.compact(ranged_log(spark, sf_dir), snapshots=(2500, 7000))
    return readable(plans.resolve(compacted, read_seq=2500).select("cf", "key", "value"))


@query(f"""SELECT s.cf, s.key, s.value FROM {resolved()} s JOIN ({EVENTS}) e ON e.seq = s.seq WHERE greatest({NOW_MS} - epoch_ms(e.ts), 0) <= {TTL_MS}""")
def compact_with_ttl(spark, sf_dir):
    """Expired by the time of the newest record that makes up the value."""
    rows = compaction.compact(event_log(spark, sf_dir), filters=[filters.column_ttl(NOW_MS, TTL_MS)])
    return readable(rows.select("cf", "key", "value"))


#: An event's frame in a list, in hexadecimal: length, stamp, number.
FRAME = "lpad(hex(8 + strlen(CAST(event_id AS VARCHAR))), 8, '0') || lpad(hex(ms), 16, '0') || hex(CAST(event_id AS VARCHAR))"
STAMPED = "1706659200000 - (o_orderkey % 20) * 86400000"


@query(f"""SELECT key, CASE WHEN o_orderkey % 11 = 0 THEN hex('short') ELSE lpad(hex(stamp), 16, '0') || hex(o_orderpriority) END AS value_hex
FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') || ':' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, {STAMPED} AS stamp, o_orderkey, o_orderpriority FROM orders)
WHERE o_orderkey % 11 = 0 OR {NOW_MS} - stamp <= {TTL_MS}""")
def value_ttl_view(spark, sf_dir):
    """Values that begin with an 8-byte stamp; every eleventh is too short to have one and stays."""
    log = order_log(spark, sf_dir)
    stamp = F.lit(NOW_MS) - ((F.col("seq") - 1) % 20) * 86_400_000
    value = F.when((F.col("seq") - 1) % 11 == 0, F.lit("short").cast("binary")).otherwise(F.concat(scalar.fixed_be(stamp, 8), F.col("value")))
    view = compaction.ttl_view(plans.resolve(log.withColumn("value", value), has_merges=False), filters.value_ttl(NOW_MS, TTL_MS))
    return readable(view.select("key", F.hex("value").alias("value_hex")))


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), f AS (SELECT user_id, min(event_id) AS first FROM e WHERE greatest({NOW_MS} - ms, 0) <= {TTL_MS} GROUP BY user_id)
SELECT e.user_id, count(*) AS n_left, min(event_id) AS first_left FROM e JOIN f ON e.user_id = f.user_id AND e.event_id >= f.first GROUP BY e.user_id""")
def list_ttl_typed(spark, sf_dir):
    """Lists lose their expired prefix and keep all from the first fresh element on."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).alias("e"))
    lists = e.groupBy("user_id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    tail = lists.select("user_id", filters.unexpired_tail(F.col("es"), lambda x: x.ms, NOW_MS, TTL_MS).alias("es")).where(F.size("es") > 0)
    return tail.select("user_id", F.size("es").cast("long").alias("n_left"), F.col("es")[0]["event_id"].alias("first_left"))


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), f AS (SELECT user_id, min(event_id) AS first FROM e WHERE greatest({NOW_MS} - ms, 0) <= {TTL_MS} GROUP BY user_id)
SELECT CAST(e.user_id AS VARCHAR) AS key, string_agg({FRAME}, '' ORDER BY event_id) AS value_hex FROM e JOIN f ON e.user_id = f.user_id AND e.event_id >= f.first GROUP BY e.user_id""")
def list_ttl_framed(spark, sf_dir):
    """The same on lists of framed bytes, in a compaction."""
    rows = compaction.compact(framed_log(spark, sf_dir), merge=merge.string_append(b""), filters=[filters.list_ttl(NOW_MS, TTL_MS)])
    return readable(rows.select("key", F.hex("value").alias("value_hex")))


def framed_log(spark, sf_dir) -> DataFrame:
    """Each event as an element of its user's list: a frame of length, stamp and number."""
    payload = F.col("event_id").cast("string").cast("binary")
    frame = F.concat(scalar.fixed_be(F.octet_length(payload) + 8, 4), scalar.fixed_be(F.unix_millis(F.col("ts").cast("timestamp")), 8), payload)
    return table(spark, sf_dir, "events").select(
        F.lit(DEFAULT_CF).alias("cf"), (F.col("event_id") + 1).alias("seq"), F.lit("merge").alias("op"), F.col("user_id").cast("string").cast("binary").alias("key"),
        F.lit(None).cast("binary").alias("end_key"), frame.alias("value"), F.col("ts").cast("timestamp").alias("ts"),
    )


@query(f"""WITH s AS (SELECT key, value FROM {resolved(ORDERS)})
SELECT key, CASE WHEN value LIKE '1%' THEN 'top' ELSE value END AS value FROM s
WHERE value NOT LIKE '5%' AND NOT (key >= '00000010' AND key < '00000020')""")
def compaction_filter(spark, sf_dir):
    """Keep, remove, change, and skip up to a key."""
    f = filters.CompactionFilter(
        "priorities",
        lambda k, v, ts: F.when(keys.in_range(k, b"00000010", b"00000020"), filters.SKIP)
        .when(v.cast("string").startswith("5"), filters.REMOVE)
        .when(v.cast("string").startswith("1"), filters.CHANGE)
        .otherwise(filters.KEEP),
        change=lambda k, v, ts: F.lit("top").cast("binary"),
        skip_until=lambda k, v: F.lit("00000020").cast("binary"),
    )
    return readable(compaction.compact(order_log(spark, sf_dir), filters=[f]).select("key", "value"))


# -- keyed state --------------------------------------------------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def value_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return readable(state.value_state(_log(state.value_updates(e, F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id") + 1))))


@query("SELECT CAST(user_id AS VARCHAR) AS key, string_agg(event_type, '|' ORDER BY event_id) AS elements FROM events GROUP BY user_id")
def list_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lists = state.list_state(_log(state.list_appends(e, F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id") + 1)))
    return readable(lists.select("key", F.array_join("elements", "|").alias("elements")))


def _log(records: DataFrame) -> DataFrame:
    return records.withColumn("end_key", F.lit(None).cast("binary"))


def _map_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return _log(state.map_puts(e, F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string"), F.col("event_id") + 1))


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_type AS field, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id, event_type")
def map_state(spark, sf_dir):
    return readable(state.map_state(_map_log(spark, sf_dir)))


@query("SELECT event_type AS field, CAST(max(event_id) AS VARCHAR) AS value FROM events WHERE user_id = 7 GROUP BY event_type")
def map_entries(spark, sf_dir):
    return readable(state.map_entries(_map_log(spark, sf_dir), b"7"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(DISTINCT event_type) AS n_fields FROM events GROUP BY user_id")
def map_counts(spark, sf_dir):
    return readable(state.map_counts(_map_log(spark, sf_dir)))


# -- figures ------------------------------------------------------------------------------------------------------

BUCKETS = """(SELECT CAST(CASE WHEN v < 2 THEN 0 ELSE length(ltrim(bin(v), '0')) - 1 END AS INTEGER) AS bucket, count(*) AS n FROM (SELECT CAST(l_extendedprice AS BIGINT) AS v FROM lineitem) GROUP BY 1)"""
TRUNCATED = BUCKETS.replace("CAST(l_extendedprice AS BIGINT)", "CAST(trunc(l_extendedprice) AS BIGINT)")


@query(f"SELECT * FROM {TRUNCATED}")
def histogram_buckets(spark, sf_dir):
    return stats.histogram_buckets(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(f"""WITH b AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS seen, sum(n) OVER () AS total, (1::BIGINT << (bucket + 1)) - 1 AS upper FROM {TRUNCATED}),
t AS (SELECT count(*) AS count, CAST(sum(v) AS BIGINT) AS sum, min(v) AS min, max(v) AS max FROM (SELECT CAST(trunc(l_extendedprice) AS BIGINT) AS v FROM lineitem))
SELECT t.*, sum / count AS mean, (SELECT min(upper) FROM b WHERE seen >= ceil(0.5 * total)) AS p50, (SELECT min(upper) FROM b WHERE seen >= ceil(0.95 * total)) AS p95,
(SELECT min(upper) FROM b WHERE seen >= ceil(0.99 * total)) AS p99, (SELECT min(upper) FROM b WHERE seen >= ceil(0.999 * total)) AS p99_9 FROM t""")
def histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(f"""SELECT count(*) AS records, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes_written, count(*) FILTER (op = 'put') AS n_put, count(*) FILTER (op = 'delete') AS n_delete,
CAST(0 AS BIGINT) AS n_single_delete, count(*) FILTER (op = 'merge') AS n_merge, CAST(0 AS BIGINT) AS n_delete_range FROM ({EVENTS})""")
def tickers(spark, sf_dir):
    return stats.tickers(event_log(spark, sf_dir))


# -- scalar functions ---------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, hex(s_name) AS name_hex FROM supplier")
def hex_function(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalar.to_hex(F.col("s_name")).alias("name_hex"))


@query("""SELECT a.p_partkey, (SELECT coalesce(min(i) - 1, least(strlen(a.p_name), strlen(a.p_type))) FROM range(1, 200) t(i)
WHERE i <= least(strlen(a.p_name), strlen(a.p_type)) AND substr(a.p_name, i, 1) <> substr(a.p_type, i, 1)) AS same FROM part a""")
def difference_offset(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalar.difference_offset(F.col("p_name").cast("binary"), F.col("p_type").cast("binary")).cast("long").alias("same"))


@query("SELECT p_partkey, starts_with(lower(p_type), 'eco') AS economic FROM part")
def starts_with_ignoring_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.starts_with_ci(F.col("p_type"), F.lit("Eco")).alias("economic"))


SPELT = "(VALUES ('42'), ('+42'), ('-1'), (' 7'), ('18446744073709551615'), ('18446744073709551616'), ('000000000000000000000000012'), ('1.5'), (''), ('+'), ('TRUE'), ('off'), ('0'), ('Yes')) AS t(s)"
SPELLINGS = "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN ' ' WHEN 4 THEN '00' ELSE '+0' END || CAST(o_orderkey AS VARCHAR(20)) || CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN ' ' WHEN 2 THEN '.0' WHEN 3 THEN '' ELSE '0000000000000' END"
WORDS = ("42", "+42", "-1", " 7", "18446744073709551615", "18446744073709551616", "000000000000000000000000012", "1.5", "", "+", "TRUE", "off", "0", "Yes")


@query(f"""SELECT s, CASE WHEN regexp_full_match(s, '\\+?[0-9]+') AND CAST(ltrim(s, '+') AS HUGEINT) <= 18446744073709551615 THEN CAST(CAST(ltrim(s, '+') AS HUGEINT) AS VARCHAR) END AS number,
CASE WHEN lower(s) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(s) IN ('false', '0', 'no', 'off') THEN false END AS truth FROM (SELECT s FROM {SPELT} UNION ALL SELECT {SPELLINGS} FROM orders)""")
def parse_numbers_and_booleans(spark, sf_dir):
    """Odd words, and every order's number in thirty spellings."""
    t = spark.createDataFrame([(w,) for w in WORDS], "s string").unionAll(table(spark, sf_dir, "orders").select(F.expr(SPELLINGS).alias("s")))
    return t.select("s", scalar.parse_u64(F.col("s")).cast("string").alias("number"), scalar.parse_bool(F.col("s")).alias("truth"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, 'a'), lambda x: x <> ''), '/') AS parts FROM part")
def split_dropping_empties(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalar.split_nonempty(F.col("p_name"), "a"), "/").alias("parts"))


@query("SELECT o_orderkey, o_orderkey * 256 + 7 AS packed, o_orderkey AS seq, 7 AS code FROM orders")
def packed_sequence(spark, sf_dir):
    packed = table(spark, sf_dir, "orders").select("o_orderkey", scalar.pack_seq(F.col("o_orderkey"), F.lit(7)).alias("packed"))
    seq, code = scalar.unpack_seq(F.col("packed"))
    return packed.select("*", seq.alias("seq"), code.alias("code"))


@query("""SELECT o_orderkey, lpad(hex(o_orderkey), 16, '0') AS be64, lpad(hex(o_orderkey), 8, '0') AS be32,
array_to_string(list_reverse(list_transform(range(0, 8), lambda i: substr(lpad(hex(o_orderkey), 16, '0'), CAST(2 * i + 1 AS BIGINT), 2))), '') AS le64, o_orderkey AS back FROM orders""")
def fixed_width_codes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k, F.hex(scalar.fixed_be(k, 8)).alias("be64"), F.hex(scalar.fixed_be(k, 4)).alias("be32"), F.hex(scalar.fixed_le(k, 8)).alias("le64"),
        scalar.from_fixed_le(scalar.fixed_le(k, 8)).alias("back"),
    )


@query("""WITH n AS (SELECT o_orderkey, 'key' AS kind, o_orderkey AS v FROM orders
UNION ALL SELECT o_orderkey, 'shifted', (o_orderkey % 127 + 1) << CAST(7 * (o_orderkey % 9) AS INTEGER) FROM orders),
c AS (SELECT *, list_transform(range(0, 9), lambda i: v >> CAST(7 * i AS INTEGER)) AS rest FROM n)
SELECT o_orderkey, kind, array_to_string(list_transform(list_filter(range(1, 10), lambda i: i = 1 OR rest[i] > 0),
lambda i: lpad(hex(rest[i] % 128 + CASE WHEN i < 9 AND rest[i] >= 128 THEN 128 ELSE 0 END), 2, '0')), '') AS code, v AS back FROM c""")
def varint_codes(spark, sf_dir):
    """Every order key as it is, and numbers of one to nine bytes."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k)
    shifted = F.expr("shiftleft(o_orderkey % 127 + 1, cast(7 * (o_orderkey % 9) as int))")
    v = o.select(k, F.lit("key").alias("kind"), k.alias("v")).unionByName(o.select(k, F.lit("shifted").alias("kind"), shifted.alias("v")))
    coded = v.select("o_orderkey", "kind", scalar.encode_varint(F.col("v")).alias("c"))
    return coded.select("o_orderkey", "kind", F.hex("c").alias("code"), scalar.decode_varint(F.col("c")).alias("back"))


@query("SELECT s_suppkey, lpad(hex(strlen(s_name)), 2, '0') || hex(s_name) AS framed FROM supplier")
def length_prefixed(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.hex(scalar.length_prefixed(F.col("s_name").cast("binary"))).alias("framed"))


_STEP32 = "list_reduce(list_prepend({start}::UBIGINT, list_transform(range(1, strlen(s_name) + 1), lambda i: ord(substr(s_name, i, 1))::UBIGINT)), lambda a, b: {step})"
_FNV = _STEP32.format(start="2166136261", step="((xor(a, b)) * 16777619) % 4294967296")
_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160::UBIGINT) ELSE x >> 1 END"
_TABLE = "list_reduce(list_prepend(xor(a, b) & 255, [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]), lambda x, y: " + _BIT + ")"
_CRC = "xor(" + _STEP32.format(start="4294967295", step=f"xor(a >> 8, {_TABLE})") + ", 4294967295::UBIGINT)"


@query(f"SELECT s_suppkey, CAST({_FNV} AS BIGINT) AS fnv, CAST({_CRC} AS BIGINT) AS crc FROM supplier")
def checksums(spark, sf_dir):
    name = F.col("s_name").cast("binary")
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalar.fnv32(name).alias("fnv"), scalar.crc32c(name).alias("crc"))


_P1, _P2, _M = (f"{n}::UHUGEINT" for n in (*scalar.HASH64_PRIMES, 1 << 64))
_TURN = f"(xor(a, b) * {_P2}) % {_M}"
_WIDE = _STEP32.replace("UBIGINT", "UHUGEINT").format(start=str((scalar.HASH64_PRIMES[0]) % (1 << 64)), step=f"({_TURN} * 2147483648::UHUGEINT) % {_M} + ({_TURN}) // 8589934592::UHUGEINT")
_END = f"(xor(b, b // 536870912::UHUGEINT) * {_P1}) % {_M}"


@query(f"""WITH w AS (SELECT s_suppkey, {_WIDE} AS a, CAST({_CRC} AS BIGINT) AS crc FROM supplier),
x AS (SELECT *, (xor(a, a // 8589934592::UHUGEINT) * {_P2}) % {_M} AS b FROM w), y AS (SELECT *, {_END} AS c FROM x), z AS (SELECT *, xor(c, c // 4294967296::UHUGEINT) AS h FROM y)
SELECT s_suppkey, CAST(CAST(h AS HUGEINT) - CASE WHEN h >= 9223372036854775808::UHUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS hash,
((crc >> 15) + (crc & 32767) * 131072 + {scalar.MASK_DELTA}) % 4294967296 AS masked, crc FROM z""")
def hash64_function(spark, sf_dir):
    name = F.col("s_name").cast("binary")
    coded = table(spark, sf_dir, "supplier").select("s_suppkey", scalar.hash64(name).alias("hash"), scalar.masked_crc32c(name).alias("masked"))
    return coded.withColumn("crc", scalar.unmasked_crc32c(F.col("masked")))


NAMES = ("000012.log", "000007.sst", "9.blob", "000003.dbtmp", "MANIFEST-000005", "OPTIONS-12", "CURRENT", "LOCK", "IDENTITY", "LOG", "LOG.old.123", "x.sst", "MANIFEST-", "7.txt")
FILES = "CASE o_orderkey % 7 WHEN 0 THEN 'MANIFEST-' WHEN 1 THEN 'OPTIONS-' ELSE '' END || lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0') || CASE o_orderkey % 7 WHEN 2 THEN '.log' WHEN 3 THEN '.sst' WHEN 4 THEN '.blob' WHEN 5 THEN '.dbtmp' WHEN 6 THEN '.txt' ELSE '' END"
KINDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in filenames.SUFFIXES.items()) + "}"


@query(f"""SELECT n AS name, CASE WHEN n IN ('CURRENT', 'LOCK', 'IDENTITY') THEN lower(n) WHEN n = 'LOG' OR regexp_full_match(n, 'LOG\\.old\\.[0-9]+') THEN 'info_log'
WHEN regexp_full_match(n, 'MANIFEST-[0-9]+') THEN 'descriptor' WHEN regexp_full_match(n, 'OPTIONS-[0-9]+') THEN 'options'
WHEN regexp_full_match(n, '[0-9]+\\.(log|sst|blob|dbtmp)') THEN CAST({KINDS}[regexp_extract(n, '\\.([a-z]+)$', 1)] AS VARCHAR) END AS kind,
CASE WHEN regexp_full_match(n, '[0-9]+\\.(log|sst|blob|dbtmp)') THEN CAST(regexp_extract(n, '^[0-9]+') AS BIGINT)
WHEN regexp_full_match(n, '(MANIFEST|OPTIONS)-[0-9]+') THEN CAST(regexp_extract(n, '[0-9]+$') AS BIGINT)
WHEN n IN ('CURRENT', 'LOCK', 'IDENTITY', 'LOG', 'LOG.old.123') THEN 0 END AS number FROM (SELECT n FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) AS t(n) UNION ALL SELECT {FILES} FROM orders)""")
def parse_file_names(spark, sf_dir):
    t = spark.createDataFrame([(n,) for n in NAMES], "name string").unionAll(table(spark, sf_dir, "orders").select(F.expr(FILES).alias("name")))
    kind, number = filenames.parsed(F.col("name"))
    return t.select("name", kind.alias("kind"), number.alias("number"))


# -- stores -------------------------------------------------------------------------------------------------------


def filled_store(spark, sf_dir) -> tuple[Store, int]:
    """The event log committed in two batches, with a snapshot held in between; the store and the snapshot."""
    store = Store.open(spark, f"{scratch(spark)}/store")
    log = event_log(spark, sf_dir)
    store.write(log.where("seq <= 400"), ["batch_id", "ordinal"])
    snapshot = store.snapshot()
    store.write(log.where("seq > 400"), ["batch_id", "ordinal"])
    return store, snapshot


@query(f"SELECT * FROM {resolved()}")
def store_scan(spark, sf_dir):
    return readable(filled_store(spark, sf_dir)[0].scan())


@query(f"SELECT cf, key, value, seq FROM {resolved(where='seq <= 400')}")
def store_snapshot_after_compaction(spark, sf_dir):
    """The store's scan alone."""
    store, snapshot = filled_store(spark, sf_dir)
    store.compact()
    return readable(store.scan(read_seq=snapshot).select("cf", "key", "value", "seq"))


@query(f"SELECT cf, key, value FROM {resolved()} WHERE starts_with(key, '1')")
def store_prefix_scan_of_checkpoint(spark, sf_dir):
    """A checkpoint is a store of its own and does not see later writes."""
    store, _ = filled_store(spark, sf_dir)
    copy = store.checkpoint(f"{scratch(spark)}/checkpoint")
    store.put(b"1", b"later")
    return readable(copy.prefix_scan(b"1").select("cf", "key", "value"))


@query(f"""SELECT 'removed' AS change, count(*) AS n_entries, min(seq) AS min_seq, max(seq) AS max_seq FROM ({EVENTS}) WHERE seq <= 400
UNION ALL SELECT 'removed', count(*), min(seq), max(seq) FROM ({EVENTS}) WHERE seq > 400 UNION ALL SELECT 'added', count(*), min(seq), max(seq) FROM {resolved()}
UNION ALL SELECT 'vacuumed', 2, 0, 0""")
def store_incremental_checkpoint(spark, sf_dir):
    """The runs that a compaction added and removed since a manifest, with what they hold, and how many a vacuum deletes."""
    store, snapshot = filled_store(spark, sf_dir)
    since = store.version
    store.release(snapshot)
    before = store.runs()
    store.compact()
    changed = dict(zip(("added", "removed"), store.changed_runs(since), strict=True))
    known = before.unionByName(store.runs()).select("path", "n_entries", "min_seq", "max_seq").collect()  # a row per run
    rows = [(how, *r[1:]) for how, paths in changed.items() for r in known if r["path"] in paths]
    return spark.createDataFrame([*rows, ("vacuumed", len(store.vacuum()), 0, 0)], "change string, n_entries long, min_seq long, max_seq long")


@query(f"SELECT 'copy' AS cf, key, value FROM {resolved()}")
def store_import(spark, sf_dir):
    """A log written elsewhere becomes a keyspace."""
    at = scratch(spark)
    event_log(spark, sf_dir).write.parquet(f"{at}/log")
    store = Store.open(spark, f"{at}/store")
    store.create_keyspace_with_import("copy", [f"{at}/log"])
    return readable(store.scan("copy").select("cf", "key", "value"))


# -- streams ------------------------------------------------------------------------------------------------------


def _streamed(spark, sf_dir, processor, op: str, key: str, value: str, order: list[str]) -> DataFrame:
    """The state that a processor keeps over the events, out of the store that it was streamed into."""
    at, conf, name = scratch(spark), spark.conf, "spark.sql.streaming.stateStore.providerClass"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, since a stream's plain path must be a folder
    rows = events.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value")
    )
    before = conf.get(name, None)
    conf.set(name, STORE_PROVIDER)  # read when a query starts
    try:
        store = Store.open(spark, f"{at}/state")
        q = ingest.state_into_store(keep_state(rows, processor), op, F.expr(key), F.expr(value), order, store, f"state-{uuid.uuid4().hex[:8]}", f"{at}/checkpoint")
        q.awaitTermination()
    finally:
        conf.set(name, before) if before else conf.unset(name)
    return store.refresh().scan()


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY user_id")
def stream_value_state(spark, sf_dir):
    state = readable(_streamed(spark, sf_dir, Counter(), "put", "key", "string(n)", ["key"]))
    return state.select("key", F.col("value").cast("long").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS elements FROM events GROUP BY user_id")
def stream_list_state(spark, sf_dir):
    state = readable(_streamed(spark, sf_dir, Appender(), "merge", "key", "value", ["key", "seq"]))
    return state.select("key", F.col("value").alias("elements"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_type AS field, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id, event_type")
def stream_map_state(spark, sf_dir):
    state = readable(_streamed(spark, sf_dir, Fields(), "put", "concat_ws(':', key, field)", "value", ["key"]))
    return state.select(F.substring_index("key", ":", 1).alias("key"), F.expr("substring(key, instr(key, ':') + 1)").alias("field"), "value")


@query(f"SELECT * FROM {resolved()}")
def stream_into_store(spark, sf_dir):
    """The log replayed as a stream of micro-batches into a store."""
    at = scratch(spark)
    event_log(spark, sf_dir).repartitionByRange(4, "seq").write.parquet(f"{at}/log")
    store = Store.open(spark, f"{at}/store")
    q = ingest.into_store(ingest.replay(spark, f"{at}/log"), store, "replay", f"{at}/checkpoint", ["batch_id", "ordinal"])
    q.awaitTermination()
    return readable(store.refresh().scan())
