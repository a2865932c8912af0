"""Reads: point, batch, range, prefix, ordered and as-of, all over a log at a snapshot.

Key predicates are applied below `resolve` and reach the Parquet scan; the log's range deletes are kept aside first,
since their own key is not the key that they hide.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import binary, has_prefix, in_range
from tidelog.functions.merge import MergeOperator
from tidelog.operators.writes import numbered
from tidelog.plans.resolve import resolve, states_at, visible
from tidelog.schema import DEFAULT_CF, DELETE_RANGE, InvalidArgument

#: Up to so many requested keys become an IN list, which is pushed down; more are joined.
IN_LIST = 200


class Known(NamedTuple):
    """What is known of a log before it is read, such as from a store's manifest; plans leave out what is not there."""

    has_merges: bool = True
    has_ranges: bool = True
    single: bool = False


def _at(log: DataFrame, cf: str | None, keys, read_seq, merge, last_seq, known: Known = Known()) -> DataFrame:  # noqa: B008
    """Resolve the part of `log` that `keys` (a predicate, or None) selects in keyspace `cf` (None: all)."""
    own = log if cf is None else log.where(F.col("cf") == cf)
    ranges = own.where(F.col("op") == DELETE_RANGE)
    points = own.where(F.col("op") != DELETE_RANGE)
    return resolve(points if keys is None else points.where(keys), read_seq, merge, ranges, known.has_merges, last_seq, known.has_ranges, known.single)


def scan(log: DataFrame, cf: str | None = DEFAULT_CF, read_seq: int | None = None, merge: MergeOperator | None = None, last_seq: int | None = None, known: Known = Known()) -> DataFrame:  # noqa: B008
    """All live keys of a keyspace, or of all keyspaces for None.  Unordered; sort where an order is wanted."""
    return _at(log, cf, None, read_seq, merge, last_seq, known)


def get(log: DataFrame, key: bytes, cf: str = DEFAULT_CF, read_seq: int | None = None, merge: MergeOperator | None = None, last_seq: int | None = None, known: Known = Known()) -> DataFrame:  # noqa: B008
    """No row, or the key's one."""
    return _at(log, cf, F.col("key") == binary(key), read_seq, merge, last_seq, known)


def range_scan(
    log: DataFrame, lower: bytes | None, upper: bytes | None, cf: str = DEFAULT_CF, read_seq: int | None = None, merge: MergeOperator | None = None,
    last_seq: int | None = None, known: Known = Known(),  # noqa: B008
) -> DataFrame:
    """Live keys with lower <= key < upper."""
    return _at(log, cf, in_range(F.col("key"), lower, upper), read_seq, merge, last_seq, known)


def prefix_scan(
    log: DataFrame, prefix: bytes, cf: str = DEFAULT_CF, read_seq: int | None = None, merge: MergeOperator | None = None,
    last_seq: int | None = None, known: Known = Known(),  # noqa: B008
) -> DataFrame:
    return _at(log, cf, has_prefix(F.col("key"), prefix), read_seq, merge, last_seq, known)


def multi_get(
    log: DataFrame,
    keys: Sequence[bytes] | DataFrame,
    cf: str = DEFAULT_CF,
    read_seq: int | None = None,
    merge: MergeOperator | None = None,
    last_seq: int | None = None,
    known: Known = Known(),  # noqa: B008
) -> DataFrame:
    """pos, key, value for each requested key, in the order of pos: one row per request, value null where absent.

    `keys` is a list, or a DataFrame with pos and key for requests of any number.  A short list is pushed to the scan;
    a DataFrame filters the log by a semi-join, whose strategy the optimizer picks by size.
    """
    spark = log.sparkSession
    if isinstance(keys, DataFrame):
        asked = keys.select("pos", "key")
        own = log.where(F.col("cf") == cf)
        points = own.where(F.col("op") != DELETE_RANGE).join(asked.select("key").distinct(), "key", "left_semi")
        found = resolve(points, read_seq, merge, own.where(F.col("op") == DELETE_RANGE), known.has_merges, last_seq, known.has_ranges, known.single)
    else:
        asked = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "pos int, key binary")
        if len(keys) > IN_LIST:
            return multi_get(log, asked, cf, read_seq, merge, last_seq, known)
        wanted = F.col("key").isin([binary(k) for k in set(keys)]) if keys else F.lit(False)
        found = _at(log, cf, wanted, read_seq, merge, last_seq, known)
    value = found.select(F.col("key").alias("f_key"), "value")
    return asked.join(value, F.col("key") == F.col("f_key"), "left").select("pos", "key", "value")


def seek_to_first(state: DataFrame) -> DataFrame:
    return state.orderBy("key").limit(1)


def seek_to_last(state: DataFrame) -> DataFrame:
    return state.orderBy(F.desc("key")).limit(1)


def seek(state: DataFrame, target: bytes) -> DataFrame:
    """The first key at or after `target`."""
    return seek_to_first(state.where(F.col("key") >= binary(target)))


def seek_for_prev(state: DataFrame, target: bytes) -> DataFrame:
    """The last key at or before `target`."""
    return seek_to_last(state.where(F.col("key") <= binary(target)))


def next_chunk(state: DataFrame, after: bytes | None, n: int) -> DataFrame:
    """Up to `n` rows behind the key `after` (None: from the start) in key order; short only at the end."""
    if n < 0:
        raise InvalidArgument("a chunk's size cannot be negative")
    rest = state if after is None else state.where(F.col("key") > binary(after))
    return rest.orderBy("key").limit(n)


def prev_chunk(state: DataFrame, before: bytes | None, n: int) -> DataFrame:
    """Up to `n` rows in front of `before`, in falling key order."""
    rest = state if before is None else state.where(F.col("key") < binary(before))
    return rest.orderBy(F.desc("key")).limit(n)


def chunks(state: DataFrame, n: int = 1024):
    """All rows in key order, `n` at a time, for a reader on the driver, which holds one partition; `chunk_bounds` leaves them where they are."""
    held = []
    for row in state.orderBy("key").toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def numbered_chunks(state: DataFrame, n: int) -> DataFrame:
    """`state` with the number of the chunk of `n` rows in key order that each row falls into."""
    return numbered(state, ["key"], "chunk").withColumn("chunk", F.floor(F.col("chunk") / n).cast("long"))


def chunk_bounds(state: DataFrame, n: int) -> DataFrame:
    """One row per chunk of `n` rows in key order: chunk, n, first_key and last_key.

    A cursor's stops: each chunk is what `next_chunk` gives behind the last key of the one before.  No row goes to the driver.
    """
    if n < 1:
        raise InvalidArgument("a chunk has one row at least")
    bounds = (F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    return numbered_chunks(state.select("key"), n).groupBy("chunk").agg(*bounds)


def all_versions(log: DataFrame, read_seq: int | None = None) -> DataFrame:
    """Every record, not resolved: hexadecimal key, seq, op, hexadecimal value."""
    seen = visible(log, read_seq)
    return seen.select("cf", F.hex("key").alias("key_hex"), "seq", "op", F.hex("value").alias("value_hex"))


def as_of(probes: DataFrame, log: DataFrame, merge: MergeOperator | None = None) -> DataFrame:
    """Each probe (probe_id, key, at) with its key's value at sequence `at`; null where absent.

    The log is cut to the probed keys, and folded only where a probe asks.
    """
    asked = probes.select("key", "at").distinct()
    ranges = log.where(F.col("op") == DELETE_RANGE)
    own = log.where(F.col("op") != DELETE_RANGE).join(asked.select("key").distinct(), "key", "left_semi").select(*log.columns)
    places = own.select("cf", "key").distinct().join(asked, "key")
    found = states_at(own.unionByName(ranges), places, merge).select(F.col("key").alias("s_key"), F.col("at").alias("s_at"), "value")
    return probes.join(found, (F.col("key") == F.col("s_key")) & (F.col("at") == F.col("s_at")), "left").select("probe_id", "key", "at", "value")


def multi_snapshot(log: DataFrame, snapshots: Sequence[int], merge: MergeOperator | None = None) -> DataFrame:
    """State at each of a few snapshots in one pass over the log: snapshot, key, value.

    Each key is folded once per snapshot, not once per record.
    """
    points = log.where(F.col("op") != DELETE_RANGE).select("cf", "key").distinct()
    asked = points.withColumn("at", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in sorted(set(snapshots))]).cast("array<bigint>")))
    return states_at(log, asked, merge).where(F.col("value").isNotNull()).select("cf", F.col("at").alias("snapshot"), "key", "value")


def pack_chunk(rows: DataFrame, by: str) -> DataFrame:
    """One buffer per value of `by`: 4-byte count, then 4-byte length and bytes of each key and value, in key order."""
    u32 = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    pair = F.concat(u32(F.octet_length("key")), F.col("key"), u32(F.octet_length("value")), F.col("value"))
    listed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("key", pair.alias("pair")))).alias("pairs"))
    joined = F.unhex(F.array_join(F.transform("pairs", lambda x: F.hex(x.pair)), ""))  # one pass over the pairs
    return listed.select(by, F.concat(u32(F.size("pairs")), joined).alias("packed"))


def unpack_chunk(packed: bytes) -> list[tuple[bytes, bytes]]:
    """The pairs of a packed buffer."""
    count, at, out = int.from_bytes(packed[:4], "big"), 4, []
    for _ in range(count):
        pair = []
        for _ in range(2):
            size = int.from_bytes(packed[at : at + 4], "big")
            pair.append(packed[at + 4 : at + 4 + size])
            at += 4 + size
        out.append((pair[0], pair[1]))
    if at != len(packed):
        raise InvalidArgument("a packed chunk has bytes behind its pairs")
    return out


def unpacked(chunks: DataFrame, packed: str = "packed") -> DataFrame:
    """The rows of `chunks` with one row per pair of their packed buffers: key and value beside the other columns."""

    @F.udtf(returnType="key binary, value binary")
    class Unpack:
        def eval(self, buffer: bytes):
            yield from unpack_chunk(bytes(buffer))

    return chunks.lateralJoin(Unpack(F.col(packed).outer())).drop(packed)
