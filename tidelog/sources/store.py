"""A store: immutable sorted Parquet runs and an append-only list of manifests.

A manifest names all that is live: keyspaces with their options, runs with their key and sequence ranges, pinned
snapshots, and the checkpoints that share this store's runs.  A commit creates the next manifest file whole, which fails
if another writer has created it; readers take the highest that can be read.  Runs never change, so a checkpoint is a
manifest, and an older manifest can be read at any time until `vacuum` drops what no kept manifest names.

Level 0 holds one run per write and keyspace, level 1 runs of one file each whose keys do not overlap.  A compaction
merges level 0 with the level-1 runs that it overlaps and leaves the others alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.filters import TtlConfig
from tidelog.functions.keys import prefix_successor
from tidelog.functions.merge import MergeOperator, operator
from tidelog.operators import compaction, reads, stats
from tidelog.operators.writes import WriteBatch, assign_sequence
from tidelog.schema import DEFAULT_CF, DELETE_RANGE, MERGE, OP_LOG, InvalidArgument, NotFound, as_log, empty_log
from tidelog.sources.files import Files

RUN_COLUMNS = """cf string, run_id long, level int, path string, n_entries long, size long, smallest_key binary,
largest_key binary, min_seq long, max_seq long, n_merges long, n_ranges long"""
DEFAULT_OPTIONS = {"merge": "string_append", "delimiter": ",", "ttl_kind": "disabled", "ttl_ms": 0, "trigger": compaction.TRIGGER, "codec": "zstd"}
#: More options: the order of iteration, how many level-0 runs stop writers, and the size of a level-1 run.
DEFAULT_OPTIONS |= {"order": "bytewise", "stop": stats.STOP_WRITES, "run_bytes": 256 << 20}
#: Bloom filters on keys, of the size that a file's keys ask for.
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Runs that no manifest ever named may belong to a write in flight; vacuum leaves them for so long.
ORPHAN_MS = 24 * 3600 * 1000


#: A task of a compaction writes the runs of about so many bytes, which may be very many small ones.
TASK_BYTES = 16 << 20
#: A task of a compaction sorts about so many records, and a run has no more, however few bytes they take.
TASK_ROWS = 1_000_000
#: A task of a compaction writes about so many runs, since a file has its own cost, however small it is.
TASK_RUNS = 100
#: Tasks that list a store's files; by default Spark starts one for each path.
LISTERS = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "48"}


class Conflict(RuntimeError):
    """Another writer has committed first; read again and retry."""


def _manifests(files: Files, at: str) -> list[str]:
    return [n for n in files.names(f"{at}/manifests") if n.endswith(".json") and not n.startswith(".")]


def _parsed(files: Files, path: str) -> dict | None:
    try:
        found = json.loads(files.read(path))
    except ValueError:
        return None
    return found if isinstance(found, dict) and "version" in found else None


class Store:
    def __init__(self, spark: SparkSession, path: str, manifest: dict, highest: int | None = None):
        self.spark, self.path, self.files, self._state = spark, path.rstrip("/"), Files(spark), manifest
        self._highest = manifest["version"] if highest is None else highest

    @property
    def _manifest(self) -> dict:
        if self._state is None:
            raise InvalidArgument("the store is closed")
        return self._state

    # -- opening and committing ---------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, create: bool = True, version: int | None = None) -> Store:
        """The store at `path`, at its newest manifest or a given one.

        A manifest that cannot be read, such as one that a crash has cut short, was never committed: it is passed over.
        """
        files, at = Files(spark), path.rstrip("/")
        names = _manifests(files, at)
        if not names:
            if not create:
                raise NotFound(f"no store at {path}")
            first = {"version": 0, "last_seq": 0, "next_run": 1, "cfs": {DEFAULT_CF: dict(DEFAULT_OPTIONS)}, "runs": [], "snapshots": [], "holds": 0, "streams": {}, "pins": {}}
            files.mkdirs(f"{at}/manifests")
            files.mkdirs(f"{at}/runs")
            files.create(f"{at}/manifests/{0:012}.json", json.dumps(first))
            names = _manifests(files, at)
        highest = int(names[-1].removesuffix(".json"))
        for name in reversed(names) if version is None else [f"{version:012}.json"]:
            if name in names and (found := _parsed(files, f"{at}/manifests/{name}")) is not None:
                return cls(spark, at, {"pins": {}} | found, highest)
        raise NotFound(f"no manifest {'that can be read' if version is None else version} at {path}")

    def refresh(self) -> Store:
        now = Store.open(self.spark, self.path, create=False)
        self._state, self._highest = now._state, now._highest
        return self

    def close(self) -> None:
        """Every later call is an error; all that was written is durable."""
        self._state = None

    def _commit(self, **changes) -> int:
        after = self._manifest | changes | {"version": self._highest + 1}
        if not self.files.create(f"{self.path}/manifests/{after['version']:012}.json", json.dumps(after)):
            raise Conflict(f"manifest {after['version']} exists")
        self._state, self._highest = after, after["version"]
        return after["version"]

    @property
    def version(self) -> int:
        return self._manifest["version"]

    @property
    def last_seq(self) -> int:
        return self._manifest["last_seq"]

    # -- keyspaces ----------------------------------------------------------------------------------------------

    def keyspaces(self) -> list[str]:
        return sorted(self._manifest["cfs"])

    def options(self, cf: str) -> dict:
        if cf not in self._manifest["cfs"]:
            raise NotFound(f"no keyspace {cf!r}")
        return self._manifest["cfs"][cf]

    def create_keyspace(self, cf: str, **options) -> None:
        if cf in self._manifest["cfs"]:
            raise InvalidArgument(f"keyspace {cf!r} exists")
        self._checked(options)
        self._commit(cfs=self._manifest["cfs"] | {cf: DEFAULT_OPTIONS | options})

    def drop_keyspace(self, cf: str) -> None:
        self.options(cf)
        if cf == DEFAULT_CF:
            raise InvalidArgument("the default keyspace cannot be dropped")
        left = {k: v for k, v in self._manifest["cfs"].items() if k != cf}
        self._commit(cfs=left, runs=[r for r in self._manifest["runs"] if r["cf"] != cf])

    def _checked(self, options: dict) -> dict:
        """All options of a keyspace that sets some; what is wrong fails here and not at the first read."""
        if unknown := set(options) - set(DEFAULT_OPTIONS):
            raise InvalidArgument(f"unknown options {sorted(unknown)}")
        full = DEFAULT_OPTIONS | options
        self._operator(full)
        if full["order"] not in ("bytewise", "reverse"):
            raise InvalidArgument(f"no order {full['order']!r}")
        return full

    @staticmethod
    def _operator(options: dict) -> MergeOperator:
        name = options["merge"]
        return operator(name, delimiter=options["delimiter"].encode()) if name == "string_append" else operator(name)

    def merge_operator(self, cf: str) -> MergeOperator:
        return self._operator(self.options(cf))

    # -- writing ------------------------------------------------------------------------------------------------

    def _new_folder(self, number: int) -> str:
        return f"{number:06}-{uuid.uuid4().hex[:8]}"

    def _save(self, rows: DataFrame, folder: str, cfs: Sequence[str], codec: str) -> list[dict]:
        """Write `rows`, sorted within their partitions, once: a folder per keyspace, and a run entry of level 0 for each.

        The entries' figures are gathered by the tasks that write.
        """
        watch, own = Observation(), {cf: F.col("cf") == cf for cf in cfs}
        figures = {f"{name}_{i}": c for i, cf in enumerate(cfs) for name, c in _figures(own[cf]).items()}
        known = F.coalesce(F.col("cf").isin(list(cfs)), F.lit(False))
        ordered = rows.withColumn("cf_", F.col("cf")).sortWithinPartitions("cf_", "key", F.desc("seq"))
        watched = ordered.observe(watch, F.count_if(~known).alias("strange"), *[c.alias(k) for k, c in figures.items()])
        out = watched.write.partitionBy("cf_")
        out.options(compression=codec, **BLOOM).parquet(f"{self.path}/runs/{folder}")
        seen = watch.get
        if seen["strange"]:
            self.files.delete(f"{self.path}/runs/{folder}")
            raise NotFound("a record is of no keyspace of this store")
        entries = []
        for i, cf in enumerate(cfs):
            if seen[f"n_entries_{i}"]:
                place = next(n for n in self.files.names(f"{self.path}/runs/{folder}") if n == f"cf_={_escaped(cf)}")
                entries.append(self._entry({k: seen[f"{k}_{i}"] for k in _figures(F.lit(True))}, cf, f"{folder}/{place}"))
        return entries

    def _entry(self, figures: dict, cf: str, place: str, level: int = 0) -> dict:
        return self._sized(figures | {"size": self.files.size(f"{self.path}/runs/{place}")}, cf, place, level)

    @staticmethod
    def _sized(figures: dict, cf: str, place: str, level: int) -> dict:
        return figures | {"cf": cf, "level": level, "path": place} | {k: bytes(figures[k]).hex() for k in ("smallest_key", "largest_key")}

    def _numbered(self, entries: list[dict], first: int) -> list[dict]:
        return [e | {"run_id": first + i} for i, e in enumerate(entries)]

    def _codec(self, cfs: Sequence[str]) -> str:
        """The codec of a write: its keyspaces' own where they agree, else the default."""
        found = {self._manifest["cfs"][cf]["codec"] for cf in cfs if cf in self._manifest["cfs"]}
        return found.pop() if len(found) == 1 else DEFAULT_OPTIONS["codec"]

    def write(self, batch: WriteBatch | DataFrame, order: Sequence[str] = ("batch_id", "ordinal"), stream: tuple[str, int] | None = None) -> int:
        """Append a batch atomically, over all its keyspaces; the store's last sequence number after it.

        A DataFrame is numbered in the order of its columns `order`, sorted by keyspace and key, and written once.
        `stream` (name, batch id) makes a repeated call with the same batch a no-op.  An empty batch is a no-op too.
        A writer that finds a keyspace's level 0 full (option stop) has to compact it first.
        """
        if stream and self._manifest["streams"].get(stream[0], -1) >= stream[1]:
            return self.last_seq
        if isinstance(batch, WriteBatch):
            if batch.is_empty():
                return self.last_seq
            cfs = sorted(batch.keyspaces())
            for cf in cfs:
                self.options(cf)
            rows = batch.frame(self.spark, self.version + 1, self.last_seq).coalesce(1)
        else:
            cfs = self.keyspaces()
            rows = as_log(assign_sequence(batch, list(order), self.last_seq)).repartitionByRange("cf", "key")
        self._make_room(cfs)
        number = self._manifest["next_run"]
        entries = self._save(rows, self._new_folder(number), cfs, self._codec(cfs))
        runs = self._numbered(entries, number)
        last = max([self.last_seq, *(r["max_seq"] for r in runs)])
        streams = self._manifest["streams"] | ({stream[0]: stream[1]} if stream else {})
        self._commit(runs=self._manifest["runs"] + runs, next_run=number + len(runs), last_seq=last, streams=streams)
        return last

    def _fresh(self, cf: str) -> int:
        return sum(r["cf"] == cf and r["level"] == 0 for r in self._manifest["runs"])

    def write_stopped(self, cf: str = DEFAULT_CF) -> bool:
        return self._fresh(cf) >= self.options(cf)["stop"]

    def _make_room(self, cfs: Sequence[str]) -> None:
        """Write stall: compacts keyspaces whose level 0 is full, without their time to live, which needs a clock."""
        for cf in cfs:
            if self.write_stopped(cf):
                self.compact(cf, ttl=False)

    def _one(self, method: str, *args, cf: str) -> int:
        return self.write(getattr(WriteBatch(), method)(*args, cf=cf))

    def put(self, key: bytes, value: bytes, cf: str = DEFAULT_CF) -> int:
        return self._one("put", key, value, cf=cf)

    def delete(self, key: bytes, cf: str = DEFAULT_CF) -> int:
        return self._one("delete", key, cf=cf)

    def single_delete(self, key: bytes, cf: str = DEFAULT_CF) -> int:
        return self._one("single_delete", key, cf=cf)

    def merge(self, key: bytes, operand: bytes, cf: str = DEFAULT_CF) -> int:
        return self._one("merge", key, operand, cf=cf)

    def delete_range(self, begin: bytes, end: bytes, cf: str = DEFAULT_CF) -> int:
        return self._one("delete_range", begin, end, cf=cf)

    def flush(self) -> int:
        """Nothing is buffered: a write is durable when it returns."""
        return self.version

    def ingest(self, paths: Sequence[str], cf: str = DEFAULT_CF, move: bool = False) -> None:
        """Register Parquet files of records as the newest runs; the last sequence rises to their highest.

        A file needs key, op and seq; it is checked and read before anything is committed.
        """
        self._commit(**self._ingested(paths, cf, move))

    def _ingested(self, paths: Sequence[str], cf: str, move: bool) -> dict:
        self.options(cf)
        entries, first = [], self._manifest["next_run"]
        for path in paths:
            if not self.files.exists(path):
                raise InvalidArgument(f"no file {path}")
            source = self.spark.read.parquet(path)
            if missing := {"key", "op", "seq"} - set(source.columns):
                raise InvalidArgument(f"{path} lacks {sorted(missing)}")
            folder = self._new_folder(first + len(entries))
            if move and source.schema == OP_LOG:
                figures = source.agg(*[c.alias(k) for k, c in _figures(F.lit(True)).items()]).first().asDict()
                if figures["n_entries"]:
                    self.files.move(path, f"{self.path}/runs/{folder}")
                    entries.append(self._entry(figures, cf, folder))
            else:
                entries += self._import(source, cf, folder)
                if move:
                    self.files.delete(path)
        runs = self._numbered(entries, first)
        last = max([self.last_seq, *(r["max_seq"] for r in runs)])
        return {"runs": self._manifest["runs"] + runs, "next_run": first + len(runs), "last_seq": last}

    def _import(self, log: DataFrame, cf: str, folder: str) -> list[dict]:
        """Write a log with its own sequence numbers as a run of one keyspace."""
        rows = as_log(log).withColumn("cf", F.lit(cf)).repartitionByRange("key")
        return self._save(rows, folder, [cf], self._codec([cf]))

    def import_log(self, log: DataFrame, cf: str = DEFAULT_CF) -> None:
        """Add records that have their sequence numbers as a run; the last sequence rises to their highest."""
        self.options(cf)
        runs = self._numbered(self._import(log, cf, self._new_folder(self._manifest["next_run"])), self._manifest["next_run"])
        last = max([self.last_seq, *(r["max_seq"] for r in runs)])
        self._commit(runs=self._manifest["runs"] + runs, next_run=self._manifest["next_run"] + len(runs), last_seq=last)

    def create_keyspace_with_import(self, cf: str, paths: Sequence[str], **options) -> None:
        """Create and ingest in one commit; on failure nothing has changed."""
        if cf in self._manifest["cfs"]:
            raise InvalidArgument(f"keyspace {cf!r} exists")
        before, full = self._manifest, self._checked(options)
        self._state = before | {"cfs": before["cfs"] | {cf: full}}
        try:
            changes = self._ingested(paths, cf, False)
            cfs = self._manifest["cfs"]
        finally:
            self._state = before
        self._commit(cfs=cfs, **changes)

    def delete_files_in_ranges(self, ranges: Sequence[tuple[bytes, bytes]], cf: str = DEFAULT_CF) -> int:
        """Drop the runs that lie wholly inside a range; how many went."""
        inside = lambda r: any(bytes.fromhex(r["smallest_key"]) >= b and bytes.fromhex(r["largest_key"]) < e for b, e in ranges)
        gone = [r for r in self._manifest["runs"] if r["cf"] == cf and inside(r)]
        if gone:
            ids = {r["run_id"] for r in gone}
            self._commit(runs=[r for r in self._manifest["runs"] if r["run_id"] not in ids])
        return len(gone)

    # -- reading ------------------------------------------------------------------------------------------------

    def _path(self, run: dict) -> str:
        return run["path"] if _absolute(run["path"]) else f"{self.path}/runs/{run['path']}"

    def _picked(self, cf: str | None = None, lower: bytes | None = None, upper: bytes | None = None) -> list[dict]:
        """The runs of a keyspace (None: of all) that may hold a key of [lower, upper)."""
        inside = lambda r: (upper is None or bytes.fromhex(r["smallest_key"]) < upper) and (lower is None or bytes.fromhex(r["largest_key"]) >= lower)
        return [r for r in self._manifest["runs"] if (cf is None or r["cf"] == cf) and inside(r)]

    def _read(self, runs: Sequence[dict]) -> DataFrame:
        return self._listed(*map(self._path, runs)) if runs else empty_log(self.spark)

    def _listed(self, *paths: str) -> DataFrame:
        """The records of Parquet files or folders, which are listed now."""
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in LISTERS}
        try:
            for k, v in LISTERS.items():
                conf.set(k, v)
            return self.spark.read.schema(OP_LOG).parquet(*paths)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def log(self, cf: str | None = None, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        """The records of a keyspace (None: of all), without the runs that cannot hold a key of [lower, upper)."""
        return self._read(self._picked(cf, lower, upper))

    def _known(self, runs: Sequence[dict]) -> reads.Known:
        """What the manifest says, so that reads plan nothing for merges, range deletes and older records that are not there."""
        apart = all(r["level"] > 0 and r.get("single", False) for r in runs)  # keys of level 1 do not overlap
        return reads.Known(any(r["n_merges"] for r in runs), any(r["n_ranges"] for r in runs), apart)

    def _how(self, cf: str, read_seq: int | None, runs: Sequence[dict]) -> dict:
        return {"cf": cf, "read_seq": read_seq, "merge": self.merge_operator(cf), "last_seq": self.last_seq, "known": self._known(runs)}

    def scan(self, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
        runs = self._picked(cf)
        return reads.scan(self._read(runs), **self._how(cf, read_seq, runs))

    def get(self, key: bytes, cf: str = DEFAULT_CF, read_seq: int | None = None) -> bytes | None:
        runs = self._picked(cf, key, key + b"\x00")
        row = reads.get(self._read(runs), key, **self._how(cf, read_seq, runs)).first()
        return None if row is None else bytes(row["value"])

    def multi_get(self, keys, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
        runs = self._picked(cf)
        return reads.multi_get(self._read(runs), keys, **self._how(cf, read_seq, runs))

    def prefix_scan(self, prefix: bytes, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
        runs = self._picked(cf, prefix, prefix_successor(prefix))
        return reads.prefix_scan(self._read(runs), prefix, **self._how(cf, read_seq, runs))

    def range_scan(self, lower: bytes | None, upper: bytes | None, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
        runs = self._picked(cf, lower, upper)
        return reads.range_scan(self._read(runs), lower, upper, **self._how(cf, read_seq, runs))

    def chunk(self, after: bytes | None, n: int, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
        """Up to `n` rows behind the key `after` (None: from the start) in the keyspace's own order."""
        step = reads.prev_chunk if self.options(cf)["order"] == "reverse" else reads.next_chunk
        return step(self.scan(cf, read_seq), after, n)

    def seek(self, target: bytes, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
        """The first key at or behind `target` in the keyspace's own order."""
        step = reads.seek_for_prev if self.options(cf)["order"] == "reverse" else reads.seek
        return step(self.scan(cf, read_seq), target)

    def runs(self) -> DataFrame:
        """One row per live run, with its path, level, entries, size and key and sequence ranges."""
        names = [c.strip().split()[0] for c in RUN_COLUMNS.replace("\n", " ").split(",")]
        rows = []
        for r in self._manifest["runs"]:
            full = r | {"path": self._path(r), "smallest_key": bytearray.fromhex(r["smallest_key"]), "largest_key": bytearray.fromhex(r["largest_key"])}
            rows.append(tuple(full[n] for n in names))
        return self.spark.createDataFrame(rows, RUN_COLUMNS)

    def live_files(self) -> list[str]:
        return [self._path(r) for r in self._manifest["runs"]]

    def snapshot_live_files(self, snapshot: int) -> list[str]:
        """The live runs that hold a record which a snapshot may read."""
        if not 0 <= snapshot <= self.last_seq:
            raise InvalidArgument(f"snapshot {snapshot} is not in the log (last sequence {self.last_seq})")
        return [self._path(r) for r in self._manifest["runs"] if r["min_seq"] <= snapshot]

    def get_property(self, name: str, cf: str = DEFAULT_CF) -> int | None:
        self.options(cf)
        rows = self.runs().where(F.col("cf") == cf)
        if rows.isEmpty():  # a keyspace without runs has all its figures at zero
            blank = self.spark.createDataFrame([(cf, 0, 2, "", 0, 0, None, None, 0, 0, 0, 0)], RUN_COLUMNS)
            value = stats.get_property(stats.properties(blank), name, cf)
            return 0 if value is not None else None
        options = self.options(cf)
        return stats.get_property(stats.properties(rows, trigger=options["trigger"], stop=options["stop"]), name, cf)

    # -- snapshots, checkpoints, maintenance --------------------------------------------------------------------

    def snapshot(self) -> int:
        """Pin the current sequence number; compaction keeps what it sees until it is released as often."""
        self._commit(snapshots=[*self._manifest["snapshots"], self.last_seq])
        return self.last_seq

    def release(self, snapshot: int) -> None:
        held = list(self._manifest["snapshots"])
        if snapshot not in held:
            raise InvalidArgument(f"snapshot {snapshot} is not held")
        held.remove(snapshot)
        self._commit(snapshots=held)

    def compact(
        self, cf: str = DEFAULT_CF, now_ms: int | None = None, filters: Sequence = (), run_ids: Sequence[int] | None = None, ttl: bool = True
    ) -> int:
        """Merge runs of a keyspace into level-1 runs of one file each whose keys do not overlap; the new version.

        `run_ids` names the runs, by default all; they must be all of level 0 and the level-1 runs that those overlap
        (or more of level 1).  Runs that are not named stay as they are.  `now_ms` is the clock of the keyspace's time to live,
        which `ttl` may leave out.
        """
        options = self.options(cf)
        own = [_with_keys(r) for r in self._manifest["runs"] if r["cf"] == cf]
        named = {r["run_id"] for r in own} if run_ids is None else set(run_ids)
        chosen, rest = [r for r in own if r["run_id"] in named], [r for r in own if r["run_id"] not in named]
        if any(r["level"] == 0 for r in rest) or len({r["run_id"] for r in compaction.with_overlaps(own)} & {r["run_id"] for r in rest}):
            raise InvalidArgument("a compaction takes all of level 0 and what it overlaps")
        if not chosen:
            return self.version
        config = TtlConfig(options["ttl_kind"], options["ttl_ms"]) if ttl else TtlConfig()
        if config.kind != "disabled" and now_ms is None:
            raise InvalidArgument("a keyspace with a time to live is compacted at an explicit time")
        active = [*filters, *([f] if (f := config.filter(now_ms or 0)) else [])]
        bottom = not compaction.overlapped(rest, chosen)
        snapshots, known = sorted(set(self._manifest["snapshots"])), self._known(chosen)
        size, n_entries = sum(r["size"] for r in chosen), sum(r["n_entries"] for r in chosen)
        parts = -(-n_entries // TASK_ROWS)
        n_runs = min(max(1, round(size / options["run_bytes"]), parts), n_entries)
        n_tasks = max(self.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES), parts, -(-n_runs // TASK_RUNS))
        n_tasks = min(n_runs, n_tasks)
        single = bottom and not snapshots  # a key then has one record at most
        # by key from the start where nothing below shuffles again, so that one shuffle serves the folding and the runs
        ranged = single and not known.has_ranges and all(f.skip_until is None for f in active) and not self._strict()
        log = self._read(chosen).repartitionByRange(n_tasks, "key") if ranged else self._read(chosen)
        merged = as_log(compaction.compact(log, snapshots, self.merge_operator(cf), active, bottom, known.has_merges, known.has_ranges))
        if single:
            rows = _cut_by_place(merged if ranged else merged.repartitionByRange(n_tasks, "key"), -(-n_entries // n_runs) if n_runs > n_tasks else None)
        else:
            rows = merged.repartitionByRange(n_runs, "key").withColumn("cut", F.spark_partition_id()).coalesce(n_tasks)
        runs = [r | {"single": single} for r in self._write_level(rows, cf, self._manifest["next_run"], options["codec"])]
        gone = {r["run_id"] for r in chosen}
        left = [r for r in self._manifest["runs"] if r["run_id"] not in gone]
        return self._commit(runs=left + runs, next_run=self._manifest["next_run"] + len(runs))

    def _strict(self) -> bool:
        """Whether the session has a log by key shuffled again before it is grouped by keyspace and key."""
        return self.spark.conf.get("spark.sql.requireAllClusterKeysForDistribution", "false") == "true"

    def _write_level(self, rows: DataFrame, cf: str, number: int, codec: str) -> list[dict]:
        """Write a log that is partitioned by ranges of its keys; a level-1 entry for each file.  One aggregate reads their figures.

        A task writes a file for each value of `cut` that it has; all records of a key have the same.
        """
        folder = self._new_folder(number)
        path = f"{self.path}/runs/{folder}"
        rows = rows.sortWithinPartitions("cut", "key", F.desc("seq"))
        rows.write.partitionBy("cut").options(compression=codec, **BLOOM).parquet(path)
        if not any(n.startswith("cut=") for n in self.files.names(path)):
            self.files.delete(path)
            return []
        written = self._listed(path).withColumns({"file": F.col("_metadata.file_name"), "bytes": F.col("_metadata.file_size")})
        figures = {k: c.alias(k) for k, c in _figures(F.lit(True)).items()} | {"size": F.first("bytes").alias("size")}
        found = written.groupBy("cut", "file").agg(*figures.values()).orderBy("smallest_key").collect()  # a row per file
        entries = [self._sized({k: r[k] for k in figures}, cf, f"{folder}/cut={r['cut']}/{r['file']}", level=1) for r in found]
        return self._numbered(entries, number)

    def maybe_compact(self, now_ms: int | None = None) -> str | None:
        """Compact the first keyspace whose level 0 has reached its trigger, only the runs that the picker names; its name."""
        plan = compaction.pick([_with_keys(r) for r in self._manifest["runs"]], {cf: o["trigger"] for cf, o in self._manifest["cfs"].items()})
        if plan:
            self.compact(plan["cf"], now_ms, run_ids=plan["runs"])
        return plan and plan["cf"]

    def checkpoint(self, target: str, copy: bool = False) -> Store:
        """A store at `target` with this one's state.  Runs are copied, or shared by path.

        Shared runs are pinned here: compaction and vacuum of this store keep them until `release_checkpoint`.
        """
        at = target.rstrip("/")
        if self.files.exists(at):
            raise InvalidArgument(f"{target} exists")
        runs = []
        for r in self._manifest["runs"]:
            if copy:
                place = f"{r['run_id']:06}-{uuid.uuid4().hex[:8]}"
                self.files.copy(self._path(r), f"{at}/runs/{place}/{self._path(r).rsplit('/', 1)[-1]}")
                runs.append(r | {"path": f"{place}/{self._path(r).rsplit('/', 1)[-1]}"})
            else:
                runs.append(r | {"path": self._path(r)})
        if not copy:
            shared = [r["path"] for r in self._manifest["runs"] if not _absolute(r["path"])]
            self._commit(pins=self._manifest["pins"] | {at: shared})
        self.files.mkdirs(f"{at}/manifests")
        self.files.mkdirs(f"{at}/runs")
        self.files.create(f"{at}/manifests/{self.version:012}.json", json.dumps(self._manifest | {"runs": runs, "holds": 0, "pins": {}}))
        return Store.open(self.spark, at, create=False)

    def checkpoints(self) -> list[str]:
        """Where stores are that share this one's runs."""
        return sorted(self._manifest["pins"])

    def release_checkpoint(self, target: str) -> None:
        """Let go of the runs that a checkpoint shares, when it has been deleted or has compacted them away."""
        at = target.rstrip("/")
        if at not in self._manifest["pins"]:
            raise InvalidArgument(f"{target} shares no runs")
        self._commit(pins={k: v for k, v in self._manifest["pins"].items() if k != at})

    def split(self, parts: Sequence[tuple[str, bytes | None, bytes | None]]) -> list[Store]:
        """Rescale: a new store for each (path, lower, upper) with the keys of [lower, upper) of all keyspaces.

        Records keep their sequence numbers, so snapshots stay readable; range deletes are clipped.
        """
        out = []
        for path, lower, upper in parts:
            if self.files.exists(path.rstrip("/")):
                raise InvalidArgument(f"{path} exists")
            part = Store.open(self.spark, path)
            part._commit(cfs=self._manifest["cfs"], snapshots=self._manifest["snapshots"])
            for cf in self.keyspaces():
                part.import_log(_clipped(self.log(cf, lower, upper), lower, upper), cf)
            part._commit(last_seq=self.last_seq)
            out.append(part)
        return out

    @classmethod
    def union(cls, spark: SparkSession, path: str, parts: Sequence[Store]) -> Store:
        """Rescale the other way: one new store of stores whose keys do not overlap, such as those that `split` made."""
        whole = cls.open(spark, path, create=True)
        cfs = {cf: part.options(cf) for part in parts for cf in part.keyspaces()}
        whole._commit(cfs=cfs, snapshots=sorted({s for p in parts for s in p._manifest["snapshots"]}))
        for part in parts:
            for cf in part.keyspaces():
                whole.import_log(part.log(cf), cf)
        whole._commit(last_seq=max(p.last_seq for p in parts))
        return whole

    def changed_runs(self, since: int) -> tuple[list[str], list[str]]:
        """Paths added and removed since an older manifest: what an incremental checkpoint copies and forgets."""
        old = set(Store.open(self.spark, self.path, create=False, version=since).live_files())
        now = set(self.live_files())
        return sorted(now - old), sorted(old - now)

    def disable_file_deletions(self) -> None:
        self._commit(holds=self._manifest["holds"] + 1)

    def enable_file_deletions(self) -> None:
        if not self._manifest["holds"]:
            raise InvalidArgument("file deletions are not disabled")
        self._commit(holds=self._manifest["holds"] - 1)

    def vacuum(self, orphan_ms: int = ORPHAN_MS) -> list[str]:
        """Delete the runs and manifests that the newest manifest no longer needs; what went.  None while deletions are disabled.

        Runs that an older manifest named go if neither the newest one nor a checkpoint needs them.  Runs that no manifest
        has named may be a write in flight, and go when they are older than `orphan_ms`.
        """
        self.refresh()
        if self._manifest["holds"]:
            return []
        needed = {r["path"] for r in self._manifest["runs"]} | {p for pinned in self._manifest["pins"].values() for p in pinned}
        folders = {p.split("/")[0] for p in needed if not _absolute(p)}
        older = [n for n in _manifests(self.files, self.path) if n < f"{self.version:012}.json"]
        named = [r["path"] for n in older for r in (_parsed(self.files, f"{self.path}/manifests/{n}") or {"runs": []})["runs"]]
        named_folders = {p.split("/")[0] for p in named if not _absolute(p)}
        gone = sorted({p for p in named if not _absolute(p)} - needed)
        for p in gone:
            self.files.delete(f"{self.path}/runs/{p}")
        for n in self.files.names(f"{self.path}/runs"):
            at = f"{self.path}/runs/{n}"
            if n not in folders and (n in named_folders or time.time() * 1000 - self.files.modified_ms(at) > orphan_ms):
                self.files.delete(at)
                gone += [] if n in named_folders else [n]
        for n in older:
            self.files.delete(f"{self.path}/manifests/{n}")
        return gone


def _cut_by_place(log: DataFrame, per_run: int | None) -> DataFrame:
    """A log with a record per key, partitioned by ranges of keys, with a `cut` for each `per_run` records of a partition (None: one cut)."""
    if per_run is None:
        return log.withColumn("cut", F.lit(0))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    return log.sortWithinPartitions("key").withColumn("cut", F.floor(place / per_run))


def _absolute(path: str) -> bool:
    """Whether a run's path is that of another store's run, and not below this one's runs."""
    return path.startswith("/") or ":" in path.split("/")[0]


def _with_keys(run: dict) -> dict:
    return run | {k: bytes.fromhex(run[k]) for k in ("smallest_key", "largest_key")}


def _escaped(name: str) -> str:
    """A keyspace's name as the writer spells it in a folder's name."""
    special = "\"#%'*/:=?\\\x7f{[]^"
    return "".join(f"%{ord(c):02X}" if c in special or ord(c) < 0x20 else c for c in name)


def _figures(own) -> dict:
    """What a manifest says of the records for which `own` holds."""
    end = F.when(F.col("op") == DELETE_RANGE, F.col("end_key")).otherwise(F.col("key"))
    return {
        "n_entries": F.count_if(own),
        "smallest_key": F.min(F.when(own, F.col("key"))),
        "largest_key": F.max(F.when(own, end)),
        "min_seq": F.min(F.when(own, F.col("seq"))),
        "max_seq": F.max(F.when(own, F.col("seq"))),
        "n_merges": F.count_if(own & (F.col("op") == MERGE)),
        "n_ranges": F.count_if(own & (F.col("op") == DELETE_RANGE)),
    }


def _clipped(log: DataFrame, lower: bytes | None, upper: bytes | None) -> DataFrame:
    """The records with a key of [lower, upper); range deletes are cut to it."""
    low, high = (F.lit(None if x is None else bytearray(x)).cast("binary") for x in (lower, upper))
    is_range = F.col("op") == DELETE_RANGE
    start = F.when(is_range, F.greatest("key", low)).otherwise(F.col("key"))  # greatest and least pass over null
    end = F.when(is_range, F.least("end_key", high))
    rows = log.withColumn("end_key", end).withColumn("key", start)
    inside = (low.isNull() | (F.col("key") >= low)) & (high.isNull() | (F.col("key") < high))
    return rows.where(inside & (~is_range | (F.col("key") < F.col("end_key"))))
