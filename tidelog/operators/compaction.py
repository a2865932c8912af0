"""Compaction: rewriting a log so that every live snapshot still reads the same, with less.

Merge chains are folded before anything is dropped, filters see folded values, and a filter only touches records
that no snapshot below can still ask for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.filters import REMOVE, SKIP, CompactionFilter
from tidelog.functions.merge import MergeOperator, string_append
from tidelog.plans.resolve import BROADCAST_RANGES, hide_ranges
from tidelog.schema import DEFAULT_CF, DELETE, DELETE_RANGE, MERGE, PUT, SINGLE_DELETE

TRIGGER = 4


def pick_oldest(n_runs: int, trigger: int = TRIGGER, batch: int | None = None) -> list[int] | None:
    """Indices, in a newest-first list, of the oldest `batch` runs; None below `trigger` runs."""
    if n_runs < trigger:
        return None
    take = min(n_runs, trigger if batch is None else batch)
    return list(range(n_runs - take, n_runs))


def pick(runs: Sequence[dict], triggers: dict[str, int] | None = None) -> dict | None:
    """The first keyspace (by name) with enough level-0 runs: all of those and the level-1 runs they overlap."""
    for cf in sorted({r["cf"] for r in runs}):
        fresh = [r for r in runs if r["cf"] == cf and r["level"] == 0]
        if fresh and len(fresh) >= (triggers or {}).get(cf, TRIGGER):
            return {"cf": cf, "runs": [r["run_id"] for r in with_overlaps([r for r in runs if r["cf"] == cf])]}
    return None


def with_overlaps(runs: Sequence[dict]) -> list[dict]:
    """Of one keyspace's runs those of level 0 and the level-1 runs whose keys they overlap."""
    fresh = [r for r in runs if r["level"] == 0]
    return [*fresh, *overlapped([r for r in runs if r["level"] > 0], fresh)]


def overlaps(run: dict, others: Sequence[dict]) -> bool:
    """Whether a run's keys lie between the smallest and the largest of `others`."""
    return bool(overlapped([run], others))


def overlapped(runs: Sequence[dict], others: Sequence[dict]) -> list[dict]:
    """Those of `runs` whose keys lie between the smallest and the largest of `others`."""
    if not others:
        return []
    lo, hi = min(bytes(r["smallest_key"]) for r in others), max(bytes(r["largest_key"]) for r in others)
    return [r for r in runs if bytes(r["largest_key"]) >= lo and bytes(r["smallest_key"]) <= hi]


def overlapping(runs: DataFrame) -> DataFrame:
    """The level-1 runs that some level-0 run of their keyspace overlaps: cf, run_id."""
    fresh = runs.where("level = 0").groupBy("cf").agg(F.min("smallest_key").alias("lo"), F.max("largest_key").alias("hi"))
    return runs.where("level = 1").join(fresh, "cf").where("largest_key >= lo and smallest_key <= hi").select("cf", "run_id")


def covered_runs(runs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Runs that lie wholly inside one of the half-open `ranges` (cf, begin, end) of their keyspace: what a file-level range drop deletes.

    Ranges without a column cf are those of the default keyspace.
    """
    named = ranges if "cf" in ranges.columns else ranges.withColumn("cf", F.lit(DEFAULT_CF))
    ranges = named.select(F.col("cf").alias("r_cf"), "begin", "end")
    inside = (F.col("cf") == F.col("r_cf")) & (F.col("smallest_key") >= F.col("begin")) & (F.col("largest_key") < F.col("end"))
    few = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    return runs.join(F.broadcast(ranges) if few else ranges, inside, "left_semi")


def retained(log: DataFrame, snapshots: Sequence[int] = ()) -> DataFrame:
    """The records that the latest read or a live snapshot can tell apart, as plain retention by version.

    Per key the newest stays, all above the oldest snapshot stay, and of those at or below it the newest stays.
    """
    points = log.where(F.col("op") != DELETE_RANGE)
    low = min(snapshots, default=None)
    turn = F.row_number().over(Window.partitionBy("cf", "key").orderBy(F.desc("seq")))
    if low is None:
        return points.withColumn("turn", turn).where("turn = 1").drop("turn")
    below = F.row_number().over(Window.partitionBy("cf", "key", F.col("seq") <= low).orderBy(F.desc("seq")))
    return points.withColumn("turn", turn).withColumn("below", below).where((F.col("turn") == 1) | (F.col("seq") > low) | (F.col("below") == 1)).drop("turn", "below")


def compact(
    log: DataFrame,
    snapshots: Sequence[int] = (),
    merge: MergeOperator | None = None,
    filters: Sequence[CompactionFilter] = (),
    bottom: bool = True,
    has_merges: bool = True,
    has_ranges: bool = True,
) -> DataFrame:
    """The rewritten log: cf, key, seq, op, value, ts (and end_key for range deletes that a snapshot still needs).

    The snapshots cut the sequence numbers into bands; reads can only stand at a band's upper end.  Within a band
    the newest barrier hides what is below it and the operands above it are folded, onto a put where there is
    one.  If `bottom` (no older runs exist) the lowest band loses its deletes and turns chains without a base
    into puts.  Filters see folded values of the highest band only, which no snapshot reads; where an older record of the
    key may be left below, what they remove becomes a delete.  Set `has_merges` or `has_ranges` to False where a log is known
    to hold no merge records or no range deletes: nothing is then planned for them.  A log that comes partitioned by key is
    not shuffled again.
    """
    merge = merge or string_append()
    points = log.where(F.col("op") != DELETE_RANGE).select("cf", "key", "seq", "op", "value", "ts")
    ranges = log.where(F.col("op") == DELETE_RANGE).select("cf", "key", "end_key", "seq")
    cuts = F.array(*[F.lit(int(s)).cast("long") for s in sorted(set(snapshots))]).cast("array<bigint>")
    band = lambda seq: F.size(F.filter(cuts, lambda s: s < seq)) if snapshots else F.lit(0)
    if has_ranges:  # a range delete hides a record for good only where no snapshot stands between the two
        points = hide_ranges(points, ranges, band=band if snapshots else None)
    rows = _folded(points, band, merge, bottom) if has_merges else _newest(points, band)
    top = len(set(snapshots))
    for f in filters:
        rows = _filtered(rows, f, F.col("band") == top, whole=bottom and not top)
    if bottom:
        rows = rows.where(~((F.col("band") == 0) & F.col("op").isin(DELETE, SINGLE_DELETE)))
    rows = rows.select("cf", "key", "seq", "op", "value", "ts", F.lit(None).cast("binary").alias("end_key"))
    needed = ranges.where(band(F.col("seq")) > 0) if bottom else ranges
    if has_ranges and (top or not bottom):
        none = lambda kind: F.lit(None).cast(kind)
        rows = rows.unionByName(
            needed.select("cf", "key", "seq", F.lit(DELETE_RANGE).alias("op"), none("binary").alias("value"), none("timestamp").alias("ts"), "end_key")
        )
    return rows


def _newest(points: DataFrame, band) -> DataFrame:
    """Of records without merges the newest of each key and band."""
    newest = F.max_by(F.struct("seq", "op", "value", "ts"), "seq").alias("r")
    state = points.withColumn("band", band(F.col("seq"))).groupBy("key", "cf", "band").agg(newest)
    return state.select("cf", "key", "band", "r.seq", "r.op", "r.value", "r.ts")


def _folded(points: DataFrame, band, merge: MergeOperator, bottom: bool) -> DataFrame:
    """What is left of each key and band when its operands are folded."""
    is_merge = F.col("op") == MERGE
    state = points.withColumn("band", band(F.col("seq"))).groupBy("key", "cf", "band").agg(
        F.max_by(F.when(~is_merge, F.struct("op", "value", "seq", "ts")), F.when(~is_merge, F.col("seq"))).alias("b"),
        F.collect_list(F.when(is_merge, F.struct("seq", "value", "ts"))).alias("all"),
    )
    above = F.sort_array(F.filter("all", lambda x: x.seq > F.coalesce(F.col("b.seq"), F.lit(-1))))
    state = state.select("cf", "key", "band", "b", above.alias("ops"))
    chain = F.size("ops") > 0
    values = F.transform("ops", lambda x: x.value)
    based = F.col("b").isNotNull()
    lowest = (F.col("band") == 0) & F.lit(bottom)
    folded = F.struct(
        F.element_at("ops", -1)["seq"].alias("seq"),
        F.lit(PUT).alias("op"),
        merge.fold(F.when(F.col("b.op") == PUT, F.col("b.value")), values).alias("value"),
        F.element_at("ops", -1)["ts"].alias("ts"),
    )
    whole = F.struct(F.col("b.seq").alias("seq"), F.col("b.op").alias("op"), F.col("b.value").alias("value"), F.col("b.ts").alias("ts"))
    kept_ops = F.transform("ops", lambda x: F.struct(x.seq.alias("seq"), F.lit(MERGE).alias("op"), x.value.alias("value"), x.ts.alias("ts")))
    out = F.when(chain & (based | lowest), F.array(folded)).when(chain, kept_ops).otherwise(F.array(whole))
    return state.select("cf", "key", "band", F.explode(out).alias("r")).select("cf", "key", "band", "r.seq", "r.op", "r.value", "r.ts")


def _filtered(rows: DataFrame, f: CompactionFilter, reach, whole: bool) -> DataFrame:
    """`rows` after one filter.  It decides on the newest put of a key within `reach`, a folded value in any case.

    What it removes is gone if `rows` are the `whole` history of their keys, and else is a delete over what is below.
    """
    asked = reach & (F.col("op") == PUT)
    decided = f.decided(rows, asked)
    if f.skip_until is not None:
        # each skip removes the puts from its key up to the bound: as a range over what the filter sees
        skips = decided.where(F.col("decision") == SKIP).select(
            "cf", "key", f.skip_until(F.col("key"), F.col("value")).alias("end_key"), F.lit(1 << 60).alias("seq")
        )
        seen = F.coalesce(asked, F.lit(False))
        left = hide_ranges(decided.where(seen), skips)
        if whole:
            decided = left.unionByName(decided.where(~seen))
        else:
            stay = left.select("cf", "key", "band").withColumn("stays", F.lit(True))
            marked = decided.join(stay, ["cf", "key", "band"], "left")
            decided = marked.withColumn("decision", F.when(seen & F.col("stays").isNull(), REMOVE).otherwise(F.col("decision"))).drop("stays")
    gone = F.coalesce(F.col("decision").isin(REMOVE, SKIP), F.lit(False))
    if whole:
        return decided.where(~gone).drop("decision")
    null = lambda c: F.when(~gone, F.col(c))
    return decided.withColumn("op", F.when(gone, DELETE).otherwise(F.col("op"))).withColumn("value", null("value")).drop("decision")


def ttl_view(state: DataFrame, f: CompactionFilter) -> DataFrame:
    """`state` as it would be after a compaction with `f`, read eagerly.  State without ts has a null one."""
    stamped = state if "ts" in state.columns else state.withColumn("ts", F.lit(None).cast("timestamp"))
    return f.decided(stamped, F.lit(True)).where(F.col("decision") != REMOVE).select(*state.columns)
