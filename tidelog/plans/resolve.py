"""Resolving a change log to state: one shuffle on (cf, key).

Per key the newest visible put or delete is the barrier.  The result is the fold of the operands above the barrier
onto the barrier's value, if it is a put.  Range deletes hide the records that are older than they are, in every read.

Only predicates on cf, key and seq may go below `resolve`; value and op predicates belong above it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.merge import MergeOperator, string_append
from tidelog.schema import DELETE, DELETE_RANGE, MERGE, PUT, InvalidArgument
from tidelog.sources.durable import durable

#: Up to so many range deletes are broadcast; beyond that they meet the records by key.
BROADCAST_RANGES = 5_000
#: Where ranges are spelled out, the ends of so many cut the keys into intervals beyond that.
CUTS = 4_096
#: Blocks of more than two to this power of ends are spelled out as such blocks first.
FINE = 10


def visible(log: DataFrame, read_seq: int | None = None, last_seq: int | None = None) -> DataFrame:
    """The records with seq <= read_seq.  A snapshot beyond `last_seq` is an error."""
    if read_seq is None:
        return log
    if read_seq < 0 or (last_seq is not None and read_seq > last_seq):
        raise InvalidArgument(f"snapshot {read_seq} is not in the log (last sequence {last_seq})")
    return log.where(F.col("seq") <= read_seq)


def _cuts(ranges: DataFrame) -> list[bytes]:
    """Up to `CUTS` of the ranges' ends, spread evenly over them in key order, from all of them; a bounded list."""
    ends = ranges.select(F.explode(F.array("r_lo", "r_hi")).alias("k")).distinct()
    tile = F.ntile(CUTS // 64).over(Window.partitionBy("part").orderBy("k"))
    parts = ends.repartitionByRange(64, "k").withColumn("part", F.spark_partition_id()).withColumn("tile", tile)
    found = parts.groupBy("part", "tile").agg(F.min("k").alias("k")).select("k").collect()
    return sorted(bytes(r["k"]) for r in found)


def _interval(key: Column, cuts: list[bytes]) -> Column:
    """How many of the sorted `cuts` are at or below the key: by halving, in the JVM."""
    array = F.array(*[F.lit(bytearray(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    # the largest n with cuts[n - 1] <= key, built from its highest bit down
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(cuts)) & (F.get(array, n + step - 1) <= key), n + step).otherwise(n))


def hide_ranges(points: DataFrame, ranges: DataFrame, broadcast_ranges: int = BROADCAST_RANGES, band: Callable[[Column], Column] | None = None) -> DataFrame:
    """`points` without the records that a newer range delete covers.  `ranges` has cf, key, end_key and seq.

    `band` may narrow the match to sequence numbers of one band.

    The number of ranges is checked first.  A few are broadcast.  Of many, the newest over each key is found first, however
    they lie over each other, and the records meet that one by their key.
    """
    by = [] if band is None else ["r_band"]
    r = ranges.where("key < end_key").select(F.col("cf").alias("r_cf"), F.col("key").alias("r_lo"), F.col("end_key").alias("r_hi"), "seq", *[band(F.col("seq")).alias(b) for b in by])
    r = r.groupBy("r_cf", "r_lo", "r_hi", *by).agg(F.max("seq").alias("r_seq"))
    hides = (F.col("cf") == F.col("r_cf")) & (F.col("seq") < F.col("r_seq"))
    hides = hides if band is None else hides & (band(F.col("seq")) == F.col("r_band"))
    n = r.limit(broadcast_ranges + 1).count()
    if n == 0:
        return points
    if n <= broadcast_ranges:
        return points.join(F.broadcast(r), hides & (F.col("key") >= F.col("r_lo")) & (F.col("key") < F.col("r_hi")), "left_anti")
    return points.join(_newest_over(points, r, by), hides & (F.col("key") == F.col("r_key")), "left_anti")


def _newest_over(points: DataFrame, r: DataFrame, by: list[str]) -> DataFrame:
    """r_cf, r_key, r_seq (and `by`): the newest of the ranges over each key of `points`; keys that none covers are absent.

    Ends are numbered in key order, and a key has the number of the last end at or before it.  A range is then an interval of
    numbers, cut into the few blocks of a power of two that make it up, and a block keeps its newest range only.  Blocks are
    spelled out in two steps, so the rows grow as the ends times the logarithm of their number.
    """
    ends = r.select(F.col("r_cf").alias("cf"), F.explode(F.array("r_lo", "r_hi")).alias("key"), F.lit(1).alias("is_end"))
    spots = ends.unionByName(points.select("cf", "key", F.lit(0).alias("is_end"))).groupBy("cf", "key").agg(F.max("is_end").alias("is_end"))
    # kept, since it is read again below, and a second sampling of the ranges might cut them elsewhere
    placed = durable(spots.repartitionByRange("cf", "key").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.sum("is_end").alias("size"))  # one row per range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("is_end").over(Window.partitionBy("part").orderBy("cf", "key"))
    ranked = placed.withColumn("within", within).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("within") - 1)
    end = lambda key, rank: ranked.where("is_end = 1").select(F.col("cf").alias("r_cf"), F.col("key").alias(key), F.col("rank").alias(rank))
    spans = r.join(end("r_lo", "lo"), ["r_cf", "r_lo"]).join(end("r_hi", "hi"), ["r_cf", "r_hi"])
    levels = int(sizes.agg(F.sum("size")).first()[0]).bit_length()
    blocks = _blocks(spans, levels, ["r_seq", *by])
    newest = lambda rows, *at: rows.groupBy(*at, *by).agg(F.max("r_seq").alias("r_seq"))
    spelled = lambda up: F.explode(F.expr(f"sequence(shiftleft(i, {up}), shiftleft(i + 1, {up}) - 1)"))
    coarse = newest(blocks, "level", "i")
    fine = newest(coarse.select(F.least("level", F.lit(FINE)).alias("level"), spelled(f"greatest(level - {FINE}, 0)").alias("i"), "r_seq", *by), "level", "i")
    each = newest(fine.select(spelled("level").alias("rank"), "r_seq", *by), "rank")
    return ranked.join(each, "rank").select(F.col("cf").alias("r_cf"), F.col("key").alias("r_key"), "r_seq", *by)


def _blocks(spans: DataFrame, levels: int, kept: list[str]) -> DataFrame:
    """level, i and `kept`: the blocks of 2^level numbers from i * 2^level on that make up each [lo, hi) of `spans`; at most two a level."""
    left, right = "shiftright(lo + shiftleft(1L, j) - 1, j)", "shiftright(hi, j)"
    block = lambda odd, i: f"CASE WHEN {left} < {right} AND {odd} % 2 = 1 THEN named_struct('level', j, 'i', {i}) END"
    pair = f"array({block(left, left)}, {block(right, f'{right} - 1')})"
    found = F.expr(f"filter(flatten(transform(sequence(0, {levels}), j -> {pair})), x -> x IS NOT NULL)")
    return spans.select(F.explode(found).alias("x"), *kept).select("x.level", "x.i", *kept)


def _filed(points: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`points` with their interval, and the ranges with each one that they touch."""
    cuts = _cuts(r)
    spread = r.withColumn("r_interval", F.explode(F.sequence(_interval(F.col("r_lo"), cuts), _interval(F.col("r_hi"), cuts))))
    return points.withColumn("interval", _interval(F.col("key"), cuts)), spread


def resolve(
    log: DataFrame,
    read_seq: int | None = None,
    merge: MergeOperator | None = None,
    ranges: DataFrame | None = None,
    has_merges: bool = True,
    last_seq: int | None = None,
    has_ranges: bool = True,
    single: bool = False,
) -> DataFrame:
    """Current state at `read_seq`: cf, key, value, seq (of the newest record that counts), n_operands.

    `ranges` are the range deletes to apply, by default those in `log` itself; pass them if the log was filtered by
    key.  Set `has_merges` to False where a log is known to hold no merge records: operands are then not gathered.  Set
    `has_ranges` to False where no range deletes are known to be: they are then neither counted nor joined.  Set `single` where
    a key of a keyspace is known to have one record at most, which is no merge: nothing is then grouped.
    An empty value is a value; keys whose newest barrier is a delete and that have no operand are absent.
    """
    merge = merge or string_append()
    seen = visible(log, read_seq, last_seq)
    points = seen.where(F.col("op") != DELETE_RANGE).select("cf", "key", "op", "seq", "value")
    if has_ranges:
        points = hide_ranges(points, visible(ranges, read_seq) if ranges is not None else seen.where(F.col("op") == DELETE_RANGE))
    if single:
        return points.where(F.col("op") == PUT).select("cf", "key", "value", "seq", F.lit(0).alias("n_operands"))
    if not has_merges:
        last = points.groupBy("cf", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("b"), F.max("seq").alias("seq"))
        return last.where(F.col("b.op") == PUT).select("cf", "key", "b.value", "seq", F.lit(0).alias("n_operands"))
    if merge.combine is not None:
        return _resolve_associative(points, merge)
    is_merge = F.col("op") == MERGE
    state = points.groupBy("cf", "key").agg(
        F.max_by(F.when(~is_merge, F.struct("op", "value")), F.when(~is_merge, F.col("seq"))).alias("b"),
        F.max(F.when(~is_merge, F.col("seq"))).alias("b_seq"),
        F.collect_list(F.when(is_merge, F.struct("seq", "value"))).alias("all"),
    )
    above = F.sort_array(F.filter("all", lambda x: x.seq > F.coalesce(F.col("b_seq"), F.lit(-1))))
    base = F.when(F.col("b.op") == PUT, F.col("b.value"))
    values = F.transform("operands", lambda x: x.value)
    value = F.when(F.size("operands") > 0, merge.fold(base, values)).otherwise(base)
    newest = F.when(F.size("operands") > 0, F.element_at("operands", -1)["seq"]).otherwise(F.col("b_seq"))
    alive = (F.col("b.op") == PUT) | F.exists("all", lambda x: x.seq > F.coalesce(F.col("b_seq"), F.lit(-1)))
    state = state.where(alive).select("cf", "key", "b", "b_seq", above.alias("operands"))
    return state.select(
        "cf", "key", value.alias("value"), newest.alias("seq"), F.size("operands").alias("n_operands")
    )


def _resolve_associative(points: DataFrame, merge: MergeOperator) -> DataFrame:
    """For operands that combine in any grouping: barriers first, then partial sums of what lies above them."""
    is_merge = F.col("op") == MERGE
    barriers = points.where(~is_merge).groupBy("cf", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("b"), F.max("seq").alias("b_seq"))
    b = barriers.select(F.col("cf").alias("b_cf"), F.col("key").alias("b_key"), "b", "b_seq")
    above = points.where(is_merge).join(b, (F.col("cf") == F.col("b_cf")) & (F.col("key") == F.col("b_key")) & (F.col("seq") <= F.col("b_seq")), "left_anti")
    sums = above.groupBy("cf", "key").agg(merge.combine(F.col("value")).alias("total"), F.max("seq").alias("m_seq"), F.count(F.lit(1)).cast("int").alias("n"))
    both = barriers.join(sums, ["cf", "key"], "full_outer")
    base = F.when(F.col("b.op") == PUT, F.col("b.value"))
    return both.where(F.col("n").isNotNull() | (F.col("b.op") == PUT)).select(
        "cf",
        "key",
        F.when(F.col("n").isNotNull(), merge.finish(base, F.col("total"))).otherwise(base).alias("value"),
        F.coalesce("m_seq", "b_seq").alias("seq"),
        F.coalesce("n", F.lit(0)).alias("n_operands"),
    )


def spell_out_ranges(log: DataFrame) -> DataFrame:
    """`log` with each range delete turned into one delete per key that has an older record inside the range.

    For operators that follow a key's records one by one.
    """
    ranges = log.where(F.col("op") == DELETE_RANGE).select(F.col("cf").alias("r_cf"), F.col("key").alias("r_lo"), F.col("end_key").alias("r_hi"), F.col("seq").alias("r_seq"))
    points = log.where(F.col("op") != DELETE_RANGE).select("cf", "key", "seq", "op", "value")
    n = ranges.limit(BROADCAST_RANGES + 1).count()
    if n == 0:
        return points
    first = points.groupBy("cf", "key").agg(F.min("seq").alias("first"))
    hit = (F.col("cf") == F.col("r_cf")) & (F.col("key") >= F.col("r_lo")) & (F.col("key") < F.col("r_hi")) & (F.col("first") < F.col("r_seq"))
    if n <= BROADCAST_RANGES:
        gone = first.join(F.broadcast(ranges), hit)
    else:
        filed, spread = _filed(first, ranges.where("r_lo < r_hi"))
        gone = filed.join(spread, (F.col("interval") == F.col("r_interval")) & hit)
    deletes = gone.select("cf", "key", F.col("r_seq").alias("seq"), F.lit(DELETE).alias("op"), F.lit(None).cast("binary").alias("value"))
    return points.unionByName(deletes)


def intervals(log: DataFrame) -> DataFrame:
    """Each put, delete or merge with the half-open interval [seq, next_seq) in which it is its key's newest record."""
    along = Window.partitionBy("cf", "key").orderBy("seq")
    points = spell_out_ranges(log)
    return points.select("cf", "key", "op", "value", "seq", F.lead("seq").over(along).alias("next_seq"))


def operands(log: DataFrame, read_seq: int | None = None) -> DataFrame:
    """cf, key, base (null without one) and operands (oldest first) of each key that has operands above its newest barrier."""
    seen = visible(log, read_seq)
    points = hide_ranges(seen.where(F.col("op") != DELETE_RANGE).select("cf", "key", "op", "seq", "value"), seen.where(F.col("op") == DELETE_RANGE))
    is_merge = F.col("op") == MERGE
    state = points.groupBy("cf", "key").agg(
        F.max_by(F.when(~is_merge, F.struct("op", "value", "seq")), F.when(~is_merge, F.col("seq"))).alias("b"),
        F.collect_list(F.when(is_merge, F.struct("seq", "value"))).alias("all"),
    )
    above = F.sort_array(F.filter("all", lambda x: x.seq > F.coalesce(F.col("b.seq"), F.lit(-1))))
    found = state.select("cf", "key", F.when(F.col("b.op") == PUT, F.col("b.value")).alias("base"), F.transform(above, lambda x: x.value).alias("operands"))
    return found.where(F.size("operands") > 0)


def _runs_of(log: DataFrame) -> DataFrame:
    """The log's puts, deletes and merges with run, which counts their key's barriers up to them."""
    along = Window.partitionBy("cf", "key").orderBy("seq")
    return spell_out_ranges(log).withColumn("run", F.sum((F.col("op") != MERGE).cast("long")).over(along))


def running(log: DataFrame, merge: MergeOperator | None = None) -> DataFrame:
    """State after each record: cf, key, seq, op, value (null where the key is absent).

    A barrier starts a new run.  Operators that combine in any grouping are aggregated along the run; for the others
    each record holds its run's operands up to itself, so the output of a run grows with the square of its length, as its
    values do.
    """
    merge = merge or string_append()
    in_run = Window.partitionBy("cf", "key", "run").orderBy("seq")
    base = F.first(F.when(F.col("op") == PUT, F.col("value"))).over(in_run)
    operand = F.when(F.col("op") == MERGE, F.col("value"))
    if merge.combine is not None:
        points = _runs_of(log).withColumn("base", base).withColumn("total", merge.combine(operand).over(in_run)).withColumn("n", F.count(operand).over(in_run))
        return points.select("cf", "key", "seq", "op", F.when(F.col("n") > 0, merge.finish(F.col("base"), F.col("total"))).otherwise(F.col("base")).alias("value"))
    points = _runs_of(log).withColumn("base", base).withColumn("operands", F.collect_list(operand).over(in_run))
    value = F.when(F.size("operands") > 0, merge.fold(F.col("base"), F.col("operands"))).otherwise(F.col("base"))
    return points.select("cf", "key", "seq", "op", value.alias("value"))


def states_at(log: DataFrame, at: DataFrame, merge: MergeOperator | None = None) -> DataFrame:
    """The state at some places of a key's history only: cf, key, at, value (null where absent), for distinct (cf, key, at) asked.

    Records and places are sorted along their key once; a place that asks becomes a row among the records, takes the number
    of its run, and meets the run's operands, which are gathered once per run and folded up to the place.
    """
    merge = merge or string_append()
    none = lambda kind: F.lit(None).cast(kind)
    points = spell_out_ranges(log).select("cf", "key", "seq", "op", "value", F.lit(0).alias("asks"))
    asked = at.select("cf", "key", F.col("at").alias("seq"), none("string").alias("op"), none("binary").alias("value"), F.lit(1).alias("asks"))
    along = Window.partitionBy("cf", "key").orderBy("seq", "asks").rowsBetween(Window.unboundedPreceding, 0)
    barrier = F.when(F.col("op") != MERGE, F.struct("seq", "op", "value"))
    rows = points.unionByName(asked).withColumn("b", F.last(barrier, True).over(along)).withColumn("run", F.coalesce(F.col("b.seq"), F.lit(-1)))
    operand = F.when(F.col("op") == MERGE, F.struct("seq", "value"))
    runs = rows.groupBy("cf", "key", "run").agg(
        F.first("b").alias("b"),
        F.sort_array(F.collect_list(operand)).alias("all"),
        F.collect_list(F.when(F.col("asks") == 1, F.col("seq"))).alias("ats"),
    )
    each = runs.where(F.size("ats") > 0).withColumn("at", F.explode("ats"))
    each = each.withColumn("ops", F.transform(F.filter("all", lambda x: x.seq <= F.col("at")), lambda x: x.value))
    base = F.when(F.col("b.op") == PUT, F.col("b.value"))
    return each.select("cf", "key", "at", F.when(F.size("ops") > 0, merge.fold(base, F.col("ops"))).otherwise(base).alias("value"))
