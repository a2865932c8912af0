import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import model
from tidelog.functions import filters
from tidelog.operators import compaction
from tidelog.operators.writes import BatchHandler, WriteBatch, multi_delete, multi_put
from tidelog.plans import resolve as plans
from tidelog.schema import InvalidArgument, NotFound
from tidelog.sources.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path / "store"))


def test_writes_and_reads(spark, store):
    assert store.write(WriteBatch()) == 0
    store.put(b"k", b"a")
    store.merge(b"k", b"b")
    store.flush()
    store.merge(b"k", b"c")
    snap = store.snapshot()
    store.put(b"k", b"z")
    assert store.get(b"k") == b"z" and store.get(b"k", read_seq=snap) == b"a,b,c" and store.get(b"none") is None
    store.compact()
    assert store.get(b"k", read_seq=snap) == b"a,b,c" and store.get(b"k") == b"z"
    store.release(snap)
    store.compact()
    assert store.get(b"k") == b"z" and store.log().count() == 1
    with pytest.raises(InvalidArgument):
        store.release(snap)
    with pytest.raises(InvalidArgument):
        store.scan(read_seq=99)


def test_keyspaces_are_apart_and_batches_whole(spark, store):
    store.create_keyspace("other", merge="counter")
    store.write(multi_put([(b"a", b"1"), (b"b", b"2"), (b"c", b"3")]))
    batch = WriteBatch().put(b"a", b"5", "other").merge(b"a", b"4", "other").delete(b"a").delete_range(b"b", b"c")
    version = store.version
    store.write(batch)
    assert store.version == version + 1
    assert model.rows(store.scan()) == {b"c": b"3"} and store.get(b"a", "other") == b"9"
    assert batch.count() == 4 and not batch.is_empty()
    store.write(multi_delete([b"c", b"nothing"]))
    assert store.scan().count() == 0
    with pytest.raises(InvalidArgument):
        store.create_keyspace("other")
    with pytest.raises(InvalidArgument):
        store.create_keyspace("third", merge="no such operator")
    with pytest.raises(InvalidArgument):
        store.drop_keyspace("default")
    with pytest.raises(NotFound):
        store.put(b"k", b"v", "nowhere")
    again = Store.open(spark, store.path)
    assert again.get(b"a", "other") == b"9"  # the operator is part of the store
    store.drop_keyspace("other")
    assert store.keyspaces() == ["default"]


def test_range_delete_outlives_runs(spark, store):
    store.write(multi_put([(b"a", b"1"), (b"b", b"2")]))
    snap = store.snapshot()
    store.delete_range(b"a", b"z")
    store.put(b"b", b"new")
    assert model.rows(store.scan()) == {b"b": b"new"} and store.get(b"a") is None
    assert model.rows(store.prefix_scan(b"b")) == {b"b": b"new"}
    store.compact()
    assert model.rows(store.scan()) == {b"b": b"new"} and model.rows(store.scan(read_seq=snap)) == {b"a": b"1", b"b": b"2"}


def test_checkpoint_and_restore(spark, store, tmp_path):
    store.write(multi_put([(b"user:%d" % i, b"%d" % i) for i in range(4)]))
    shared, copied = store.checkpoint(str(tmp_path / "shared")), store.checkpoint(str(tmp_path / "copied"), copy=True)
    store.put(b"user:0", b"changed")
    for other in (shared, copied):
        assert other.get(b"user:0") == b"0" and other.scan().count() == 4
        other.put(b"user:9", b"new")
        assert other.scan().count() == 5 and store.scan().count() == 4
    with pytest.raises(InvalidArgument):
        store.checkpoint(str(tmp_path / "shared"))
    with pytest.raises(NotFound):
        Store.open(spark, str(tmp_path / "nothing"), create=False)


def test_incremental_checkpoint_and_vacuum(spark, store):
    store.put(b"a", b"1")
    since = store.version
    store.put(b"b", b"2")
    added, removed = store.changed_runs(since)
    assert len(added) == 1 and not removed
    store.disable_file_deletions()
    store.compact()
    added, removed = store.changed_runs(since)
    assert len(added) == 1 and len(removed) == 1 and store.vacuum() == []
    store.enable_file_deletions()
    with pytest.raises(InvalidArgument):
        store.enable_file_deletions()
    assert len(store.vacuum()) == 2 and model.rows(store.scan()) == {b"a": b"1", b"b": b"2"}
    assert Store.open(spark, store.path).scan().count() == 2


def test_ingest(spark, store, tmp_path):
    path = str(tmp_path / "in")
    model.frame(spark, [(5, "put", b"ik1", None, b"1"), (9, "put", b"ik2", None, b"2")]).coalesce(1).write.parquet(path)
    store.create_keyspace("target")
    store.ingest([path], "target")
    assert model.rows(store.scan("target")) == {b"ik1": b"1", b"ik2": b"2"} and store.last_seq == 9
    store.create_keyspace_with_import("imported", [path])
    assert store.scan("imported").count() == 2
    with pytest.raises(InvalidArgument):
        store.create_keyspace_with_import("broken", [str(tmp_path / "missing")])
    assert "broken" not in store.keyspaces()
    spark.range(3).write.parquet(str(tmp_path / "odd"))
    with pytest.raises(InvalidArgument):
        store.ingest([str(tmp_path / "odd")])
    store.ingest([path], move=True)
    assert store.scan().count() == 2


def test_runs_and_properties(spark, store):
    for i in range(4):
        store.write(multi_put([(b"%d%d" % (i, j), b"v") for j in range(3)]))
    runs = store.runs().orderBy("run_id").collect()
    assert [(bytes(r["smallest_key"]), bytes(r["largest_key"]), r["n_entries"]) for r in runs][0] == (b"00", b"02", 3)
    assert store.get_property("num-files-at-level0") == 4 and store.get_property("vendor.compaction-pending") == 1
    assert store.get_property("no such name") is None
    assert store.delete_files_in_ranges([(b"0", b"1")]) == 1 and store.scan().count() == 9
    assert store.maybe_compact() is None
    store.put(b"x", b"y")
    assert store.maybe_compact() == "default" and store.get_property("num-files-at-level1") == 1 and store.scan().count() == 10
    assert len(store.live_files()) == 1


def test_time_to_live(spark, store):
    store.create_keyspace("short", ttl_kind="value", ttl_ms=1000)
    stamp = lambda t: t.to_bytes(8, "big") + b"x"
    store.write(WriteBatch().put(b"old", stamp(1), "short").put(b"new", stamp(9000), "short"))
    with pytest.raises(InvalidArgument):
        store.compact("short")
    assert store.scan("short").count() == 2
    store.compact("short", now_ms=9500)
    assert {bytes(r["key"]) for r in store.scan("short").collect()} == {b"new"}


def test_writers_conflict(spark, store):
    other = Store.open(spark, store.path)
    store.put(b"a", b"1")
    with pytest.raises(Conflict):
        other.put(b"b", b"2")
    other.refresh().put(b"b", b"2")
    assert store.refresh().scan().count() == 2


def test_frames_and_streams_commit_once(spark, store):
    rows = spark.range(100).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit("put").alias("op"), F.lit("v").cast("binary").alias("value"), "id")
    assert store.write(rows, ["id"], stream=("q", 0)) == 100
    assert store.write(rows, ["id"], stream=("q", 0)) == 100
    assert store.log().count() == 100 and store.log().select("seq").distinct().count() == 100


def test_batch_replay():
    seen = []

    class Handler(BatchHandler):
        def put(self, cf, key, value):
            seen.append(("put", key))

        def delete_range(self, cf, begin, end):
            seen.append(("range", begin, end))

    WriteBatch().put(b"a", b"1").delete(b"b").merge(b"c", b"2").single_delete(b"d").delete_range(b"a", b"z").replay(Handler())
    assert seen == [("put", b"a"), ("range", b"a", b"z")]


def test_checkpoint_outlives_its_source(spark, store, tmp_path):
    store.write(multi_put([(b"a", b"1"), (b"b", b"2")]))
    copy = store.checkpoint(str(tmp_path / "shared"))
    store.put(b"a", b"changed")
    store.compact()
    Store.open(spark, store.path).vacuum()
    assert model.rows(copy.scan()) == {b"a": b"1", b"b": b"2"} and store.checkpoints() == [copy.path]
    again = copy.checkpoint(str(tmp_path / "second"))  # of a checkpoint, which owns none of its runs
    assert model.rows(again.scan()) == {b"a": b"1", b"b": b"2"}
    copy.compact()
    assert model.rows(copy.scan()) == {b"a": b"1", b"b": b"2"}
    store.refresh().release_checkpoint(copy.path)
    with pytest.raises(InvalidArgument):
        store.release_checkpoint(copy.path)
    store.put(b"z", b"1")
    assert len(store.vacuum()) == 0 and model.rows(store.scan()) == {b"a": b"changed", b"b": b"2", b"z": b"1"}


def test_vacuum_spares_a_write_in_flight(spark, store, monkeypatch):
    """A second handle cleans up while a writer has its run and not yet its manifest."""
    store.put(b"a", b"1")
    store.compact()
    commit, removed = Store._commit, []

    def late(self, **changes):
        if not removed:
            removed.append(Store.open(spark, store.path).vacuum())
        return commit(self, **changes)

    monkeypatch.setattr(Store, "_commit", late)
    store.put(b"b", b"2")
    assert len(removed) == 1 and model.rows(Store.open(spark, store.path).scan()) == {b"a": b"1", b"b": b"2"}
    orphan = os.path.join(store.path, "runs", "000099-orphan")
    os.mkdir(orphan)
    assert "000099-orphan" not in store.vacuum() and "000099-orphan" in store.vacuum(orphan_ms=-1) and not os.path.exists(orphan)
    assert store.scan().count() == 2


def test_a_torn_manifest_is_passed_over(spark, store):
    store.put(b"a", b"1")
    for text in ("", '{"version": 9', "[]"):
        with open(f"{store.path}/manifests/{store._highest + 1:012}.json", "w") as f:
            f.write(text)
        store = Store.open(spark, store.path)
        assert model.rows(store.scan())[b"a"] == b"1"
        store.put(text.encode() or b"empty", b"2")
        assert Store.open(spark, store.path).get(text.encode() or b"empty") == b"2"
    store.vacuum()
    assert Store.open(spark, store.path).scan().count() == 4


def test_one_of_two_creators_wins_and_no_file_is_half_written(store):
    at = f"{store.path}/manifests/x.json"
    assert store.files.create(at, "first") and not store.files.create(at, "second") and store.files.read(at) == "first"
    assert [n for n in os.listdir(f"{store.path}/manifests") if n.startswith(".")] == []


def test_a_rename_takes_a_free_name_only(store):
    """What other file systems than this machine's own do."""
    at, asides = f"{store.path}/manifests/y.json", [f"{store.path}/manifests/.{i}" for i in range(2)]
    for i, aside in enumerate(asides):
        with open(aside, "w") as f:
            f.write(str(i))
    assert store.files._take_name(asides[0], at) and not store.files._take_name(asides[1], at)
    assert store.files.read(at) == "0" and not os.path.exists(asides[1])


def test_a_store_at_a_uri(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/store")
    store.write(multi_put([(b"a", b"1"), (b"b", b"2")]))
    copy = store.checkpoint(f"file://{tmp_path}/copy")
    store.compact()
    store.vacuum()
    assert model.rows(copy.scan()) == model.rows(Store.open(spark, f"file://{tmp_path}/store", create=False).scan()) == {b"a": b"1", b"b": b"2"}


def test_runs_have_bloom_filters_on_keys(spark, store):
    store.write(spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"), F.lit("put").alias("op"), F.lit(b"v").alias("value"), "id"), ["id"])
    files = f"{store.live_files()[0]}/*.parquet"
    found = duckdb.sql(f"SELECT path_in_schema, count(*) FILTER (bloom_filter_offset > 0) FROM parquet_metadata('{files}') GROUP BY ALL").fetchall()
    assert dict(found)["key"] > 0 and store.get(b"absent") is None and store.scan().count() == 2000


def test_compaction_leaves_other_runs_alone(spark, store):
    """Level-1 runs that no new run overlaps keep their files; a delete over an older run below is not lost."""
    store.create_keyspace("k", run_bytes=1, trigger=2)
    store.write(multi_put([(b"%02d" % i, b"x" * 50) for i in range(40)], "k"))
    store.compact("k")
    before = {p: os.path.getmtime(p) for p in store.live_files()}
    assert len(before) > 5 and all(r["level"] == 1 for r in store.runs().collect())
    edges = sorted((bytes(r["smallest_key"]), bytes(r["largest_key"])) for r in store.runs().collect())
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    store.write(WriteBatch().put(b"01", b"new", "k").merge(b"02", b"more", "k"))
    store.write(WriteBatch().delete(b"00", "k"))
    wanted = {bytes(r["key"]): bytes(r["value"]) for r in store.scan("k").collect()}
    assert store.maybe_compact() == "k"
    kept = set(store.live_files()) & set(before)
    assert 0 < len(kept) < len(before) and all(os.path.getmtime(p) == before[p] for p in kept)
    assert model.rows(store.scan("k")) == wanted and len(wanted) == 39 and wanted[b"02"].endswith(b",more")
    store.vacuum()
    assert model.rows(Store.open(spark, store.path).scan("k")) == wanted
    store.put(b"01", b"newest", "k")
    with pytest.raises(InvalidArgument):
        store.compact("k", run_ids=[r["run_id"] for r in store.runs().collect()][:1])


def test_few_tasks_write_many_runs(spark, store):
    """A compaction into very many small runs starts a few tasks, and not one for each run."""
    store.create_keyspace("k", run_bytes=1)
    store.write(multi_put([(b"%03d" % i, b"x" * 50) for i in range(200)], "k"))
    store.compact("k")
    files = store.live_files()
    tasks = {p.rsplit("/", 1)[-1].split("-")[1] for p in files}
    assert len(files) > 20 and len(tasks) <= spark.sparkContext.defaultParallelism
    edges = sorted((bytes(r["smallest_key"]), bytes(r["largest_key"])) for r in store.runs().collect())
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    assert all(os.path.getsize(r["path"]) == r["size"] for r in store.runs().collect()) and store.scan("k").count() == 200


def test_few_tasks_list_many_runs(spark, store):
    """A scan of very many runs lists them by a bounded number of tasks; the session's own setting comes back."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    store.create_keyspace("k", run_bytes=1)
    store.write(multi_put([(b"%03d" % i, b"x" * 50) for i in range(100)], "k"))
    store.compact("k")
    assert len(store.live_files()) > 60
    before, tracker = spark.conf.get(name, None), spark.sparkContext.statusTracker()
    old = set(tracker.getJobIdsForGroup(None))
    store.scan("k")
    jobs = set(tracker.getJobIdsForGroup(None)) - old
    sizes = [tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert sizes and max(sizes) <= 48 and spark.conf.get(name, None) == before


def test_a_compaction_shuffles_once(spark, store, monkeypatch):
    """Records are sent to the ranges of their keys as they are read; they are not grouped by a shuffle of its own before."""
    plans_seen, write_level = [], Store._write_level
    seen = lambda self, rows, *a: (plans_seen.append(rows._jdf.queryExecution().executedPlan().toString()), write_level(self, rows, *a))[1]
    monkeypatch.setattr(Store, "_write_level", seen)
    store.create_keyspace("k", run_bytes=500)
    store.write(multi_put([(b"%03d" % i, b"old") for i in range(300)], "k"))
    for op in (b"new", b"newer"):
        store.write(multi_put([(b"%03d" % i, op) for i in range(0, 300, 2)], "k"))
        store.write(multi_delete([b"%03d" % i for i in range(0, 300, 3)], "k"))
        store.compact("k")
        assert model.rows(store.scan("k")) == {b"%03d" % i: b"old" if i % 2 else op for i in range(300) if i % 3}
        edges = sorted((bytes(r["smallest_key"]), bytes(r["largest_key"])) for r in store.runs().collect())
        assert len(edges) > 4 and all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    assert len(plans_seen) == 2 and all("rangepartitioning" in p and "hashpartitioning" not in p for p in plans_seen)


@pytest.mark.parametrize("kind", ["merges", "ranges", "snapshot", "skip", "strict"])
def test_runs_are_apart_whatever_is_compacted(spark, store, kind):
    """Many small runs of a log with operands, range deletes or versions, and where every shuffle has to name all columns."""
    store.create_keyspace("k", run_bytes=100)
    wanted = {b"%03d" % i: b"v" for i in range(200)}
    store.write(multi_put(wanted.items(), "k"))
    batch, filters_, name = WriteBatch(), [], "spark.sql.requireAllClusterKeysForDistribution"
    if kind == "snapshot":
        held = store.snapshot()
    if kind == "merges":
        for i in range(0, 200, 5):
            batch.merge(b"%03d" % i, b"w", "k")
            wanted[b"%03d" % i] = b"v,w"
    elif kind == "ranges":
        batch.delete_range(b"050", b"100", "k")
        wanted = {k: v for k, v in wanted.items() if not b"050" <= k < b"100"}
    else:
        for i in range(0, 200, 5):
            batch.put(b"%03d" % i, b"w", "k")
            wanted[b"%03d" % i] = b"w"
    if kind == "skip":
        filters_ = [filters.CompactionFilter("s", lambda k, v, ts: F.when(k == F.lit(b"020"), filters.SKIP).otherwise(filters.KEEP), skip_until=lambda k, v: F.lit(b"030"))]
        wanted = {k: v for k, v in wanted.items() if not b"020" <= k < b"030"}
    store.write(batch)
    if kind == "strict":
        spark.conf.set(name, "true")
    try:
        store.compact("k", filters=filters_)
    finally:
        spark.conf.unset(name)
    runs = sorted((bytes(r["smallest_key"]), bytes(r["largest_key"])) for r in store.runs().collect())
    assert len(runs) > 10 and all(a[1] < b[0] for a, b in zip(runs, runs[1:])) and model.rows(store.scan("k")) == wanted
    if kind == "snapshot":
        assert model.rows(store.scan("k", read_seq=held)) == {b"%03d" % i: b"v" for i in range(200)}


def test_a_read_of_keys_with_one_record_does_not_group(spark, store):
    """What a compaction has left with a record per key is read as it stands, until something lies over it or a snapshot holds more."""
    grouped = lambda at=None: "Aggregate" in store.scan("k", at)._jdf.queryExecution().executedPlan().toString()
    store.create_keyspace("k", run_bytes=200)
    store.write(multi_put([(b"%03d" % i, b"a") for i in range(60)], "k"))
    store.write(WriteBatch().merge(b"001", b"b", "k").delete(b"002", "k").delete_range(b"010", b"020", "k"))
    wanted = {b"%03d" % i: b"a,b" if i == 1 else b"a" for i in range(60) if i != 2 and not 10 <= i < 20}
    assert grouped() and model.rows(store.scan("k")) == wanted
    store.compact("k")
    assert not grouped() and model.rows(store.scan("k")) == wanted and store.get(b"001", "k") == b"a,b" and store.get(b"002", "k") is None
    assert not grouped(store.last_seq)
    snap = store.snapshot()
    store.put(b"001", b"new", "k")
    assert grouped() and store.get(b"001", "k") == b"new" and store.get(b"001", "k", snap) == b"a,b"
    store.compact("k")
    assert grouped() and model.rows(store.scan("k")) == wanted | {b"001": b"new"} and model.rows(store.scan("k", snap)) == wanted
    store.release(snap)
    store.compact("k")
    assert not grouped() and model.rows(store.scan("k")) == wanted | {b"001": b"new"}
    assert model.rows(Store.open(spark, store.path).prefix_scan(b"00", "k")) == {k: v for k, v in (wanted | {b"001": b"new"}).items() if k.startswith(b"00")}


def test_tasks_share_many_runs(spark, store, monkeypatch):
    """A file has a cost of its own, so that more runs are written by more tasks."""
    monkeypatch.setattr("tidelog.sources.store.TASK_RUNS", 10, raising=False)
    store.create_keyspace("k", run_bytes=1)
    store.write(multi_put([(b"%03d" % i, b"x" * 50) for i in range(200)], "k"))
    store.compact("k")
    runs = [p.rsplit("/", 1)[-1].split("-")[1] for p in store.live_files()]
    assert len(runs) == 200 and max(map(runs.count, runs)) <= 30
    assert model.rows(store.scan("k")) == {b"%03d" % i: b"x" * 50 for i in range(200)}


def test_a_run_holds_what_a_task_can_sort(spark, store, monkeypatch):
    """Records that take few bytes are not all sorted by one task."""
    monkeypatch.setattr("tidelog.sources.store.TASK_ROWS", 20, raising=False)
    store.write(multi_put([(b"%03d" % i, b"x") for i in range(200)]))
    store.compact()
    runs = sorted((bytes(r["smallest_key"]), bytes(r["largest_key"]), r["n_entries"]) for r in store.runs().collect())
    assert len(runs) >= 8 and max(r[2] for r in runs) <= 40 and all(a[1] < b[0] for a, b in zip(runs, runs[1:]))
    assert model.rows(store.scan()) == {b"%03d" % i: b"x" for i in range(200)}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_against_the_model(spark, store, seed):
    rng = random.Random(seed)
    records, held = [], []
    store.create_keyspace("k", run_bytes=200, trigger=2)
    for _ in range(5):
        batch = WriteBatch()
        for _, op, key, end, value in model.random_records(rng, 12):
            getattr(batch, op)(*[x for x in ((key, end) if op == "delete_range" else (key, value) if value is not None else (key,))], cf="k")
            records.append((len(records) + 1, op, key, end, value))
        store.write(batch)
        if rng.random() < 0.4:
            held.append(store.snapshot())
        store.maybe_compact()
        assert model.rows(store.scan("k")) == model.apply(records)
        for s in held:
            assert model.rows(store.scan("k", read_seq=s)) == model.apply(records, s)


def log_of(spark, *records):
    return model.frame(spark, [(seq, op, key, None, value) for seq, op, key, value in records])


def test_a_skip_keeps_merges_and_deletes_below(spark):
    log = log_of(spark, (1, "put", b"a", b"1"), (2, "merge", b"b", b"x"), (3, "delete", b"c", None), (4, "put", b"d", b"4"), (5, "put", b"z", b"5"))
    skip = filters.CompactionFilter("s", lambda k, v, ts: F.when(k == F.lit(b"a"), filters.SKIP).otherwise(filters.KEEP), skip_until=lambda k, v: F.lit(b"e"))
    found = {(bytes(r["key"]), r["op"]) for r in compaction.compact(log, filters=[skip], bottom=False).collect()}
    assert found == {(b"a", "delete"), (b"b", "merge"), (b"c", "delete"), (b"d", "delete"), (b"z", "put")}
    whole = {(bytes(r["key"]), r["op"]) for r in compaction.compact(log, filters=[skip]).collect()}
    assert whole == {(b"z", "put")}  # b is folded into a put, which the skip covers


def test_a_time_to_live_spares_what_a_snapshot_reads(spark):
    old = filters.CompactionFilter("old", lambda k, v, ts: F.when(v.cast("string").startswith("v"), filters.REMOVE).otherwise(filters.KEEP))
    log = log_of(spark, (1, "put", b"k", b"v"), (2, "merge", b"k", b"x"), (3, "put", b"n", b"v"), (4, "put", b"m", b"w"))
    after = compaction.compact(log, snapshots=(1,), filters=[old])
    assert model.rows(plans.resolve(after, 1)) == {b"k": b"v"}
    assert model.rows(plans.resolve(after)) == {b"k": b"v,x", b"m": b"w"}  # the operand's base is read by the snapshot
    over = compaction.compact(log_of(spark, (1, "put", b"k", b"a"), (2, "put", b"k", b"v")), snapshots=(1,), filters=[old])
    assert model.rows(plans.resolve(over, 1)) == {b"k": b"a"} and model.rows(plans.resolve(over)) == {}
    below = compaction.compact(log_of(spark, (2, "put", b"k", b"v")), filters=[old], bottom=False)
    assert [(r["op"], r["value"]) for r in below.collect()] == [("delete", None)]


def test_a_full_level_stops_writers_until_it_is_compacted(spark, store):
    store.create_keyspace("k", stop=3)
    for i in range(3):
        assert not store.write_stopped("k")
        store.put(b"%d" % i, b"v", "k")
    assert store.write_stopped("k") and store.get_property("is-write-stopped", "k") == 1
    store.put(b"3", b"v", "k")
    assert [r["level"] for r in store.runs().where("cf = 'k'").orderBy("level").collect()] == [0, 1] and store.scan("k").count() == 4


def test_files_of_a_snapshot(spark, store):
    store.put(b"a", b"1")
    snap, first = store.snapshot(), store.live_files()
    store.put(b"b", b"2")
    assert store.snapshot_live_files(snap) == first and len(store.snapshot_live_files(store.last_seq)) == 2
    with pytest.raises(InvalidArgument):
        store.snapshot_live_files(99)


def test_rescale(spark, store, tmp_path):
    store.create_keyspace("sums", merge="counter")
    store.write(WriteBatch().put(b"a", b"1").put(b"m", b"2").put(b"z", b"3").merge(b"m", b"4", "sums").merge(b"m", b"5", "sums"))
    snap = store.snapshot()
    store.delete_range(b"b", b"zz")
    store.put(b"n", b"6")
    whole = {s: model.rows(store.scan(read_seq=s)) for s in (snap, store.last_seq)}
    parts = store.split([(str(tmp_path / "low"), None, b"m"), (str(tmp_path / "high"), b"m", None)])
    assert [model.rows(p.scan()) for p in parts] == [{b"a": b"1"}, {b"n": b"6"}] and parts[1].get(b"m", "sums") == b"9"
    assert {k: v for p in parts for k, v in model.rows(p.scan(read_seq=snap)).items()} == whole[snap]
    ends = [(bytes(r["key"]), bytes(r["end_key"])) for p in parts for r in p.log().where("op = 'delete_range'").collect()]
    assert ends == [(b"b", b"m"), (b"m", b"zz")]
    again = Store.union(spark, str(tmp_path / "again"), parts)
    assert {s: model.rows(again.scan(read_seq=s)) for s in whole} == whole and again.last_seq == store.last_seq and again.get(b"m", "sums") == b"9"
    with pytest.raises(InvalidArgument):
        store.split([(str(tmp_path / "low"), None, None)])


def test_a_keyspace_in_reverse_order(spark, store):
    store.create_keyspace("r", order="reverse")
    store.write(multi_put([(b"%d" % i, b"v") for i in range(6)], "r"))
    keys = lambda df: [bytes(r["key"]) for r in df.collect()]
    assert keys(store.chunk(None, 3, "r")) == [b"5", b"4", b"3"] and keys(store.chunk(b"3", 9, "r")) == [b"2", b"1", b"0"]
    assert keys(store.seek(b"35", "r")) == [b"3"] and keys(store.seek(b"35")) == []
    store.put(b"4", b"v")
    assert keys(store.seek(b"35")) == [b"4"] and keys(store.chunk(None, 2)) == [b"4"]
    with pytest.raises(InvalidArgument):
        store.create_keyspace("odd", order="sideways")


def test_a_closed_store(store):
    store.put(b"a", b"1")
    store.close()
    for call in (store.scan, lambda: store.put(b"a", b"2"), store.live_files, lambda: store.last_seq):
        with pytest.raises(InvalidArgument):
            call()


def test_operands(spark):
    log = log_of(spark, (1, "merge", b"a", b"0"), (2, "put", b"a", b"1"), (3, "merge", b"a", b"2"), (4, "merge", b"a", b"3"), (5, "merge", b"b", b"4"), (6, "put", b"c", b"5"), (7, "delete", b"d", None), (8, "merge", b"d", b"6"))
    found = {bytes(r["key"]): (r["base"] and bytes(r["base"]), [bytes(x) for x in r["operands"]]) for r in plans.operands(log).collect()}
    assert found == {b"a": (b"1", [b"2", b"3"]), b"b": (None, [b"4"]), b"d": (None, [b"6"])}


def test_names_of_keyspaces_and_wrong_ones(spark, store):
    odd = "a/b=c %?é 'x'"
    store.create_keyspace(odd)
    rows = spark.range(6).select(F.when(F.col("id") < 3, odd).otherwise("default").alias("cf"), F.col("id").cast("string").cast("binary").alias("key"), F.lit("put").alias("op"), F.lit(b"v").alias("value"), "id")
    store.write(rows, ["id"])
    assert store.scan(odd).count() == 3 and store.scan().count() == 3 and len(store.live_files()) == 2
    version = store.version
    with pytest.raises(NotFound):
        store.write(rows.withColumn("cf", F.lit("nowhere")), ["id"])
    assert store.version == version and store.refresh().version == version and store.last_seq == 6


def test_reads_use_what_the_manifest_counts(spark, store):
    """No gathering where no run has merges, and no job for range deletes where there are none."""
    store.write(multi_put([(b"a", b"1"), (b"b", b"2")]))
    assert "collect_list" not in store.scan()._jdf.queryExecution().toString()
    store.merge(b"b", b"3")
    assert "collect_list" in store.scan()._jdf.queryExecution().toString()
    assert json.loads(store.files.read(f"{store.path}/manifests/{store.version:012}.json"))["runs"][-1]["n_merges"] == 1
