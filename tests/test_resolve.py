import random

import pytest
from pyspark.sql import functions as F

from tests import model
from tidelog.functions import merge
from tidelog.operators import compaction, reads
from tidelog.plans import resolve as plans
from tidelog.plans.resolve import hide_ranges, resolve
from tidelog.schema import InvalidArgument

P, D, M, R = "put", "delete", "merge", "delete_range"
#: name, records (op, key, end, value), expected latest state
SCENARIOS = [
    ("merge with base", [(P, b"k", None, b"a"), (M, b"k", None, b"b"), (M, b"k", None, b"c")], {b"k": b"a,b,c"}),
    ("merge without base", [(M, b"k", None, b"x"), (M, b"k", None, b"y")], {b"k": b"x,y"}),
    ("merge single", [(M, b"k", None, b"only")], {b"k": b"only"}),
    ("merge after delete", [(P, b"k", None, b"old"), (D, b"k", None, None), (M, b"k", None, b"new")], {b"k": b"new"}),
    ("range delete", [(P, x, None, x) for x in (b"a", b"b", b"c", b"d")] + [(R, b"b", b"d", None)], {b"a": b"a", b"d": b"d"}),
    ("put newer than a range delete", [(R, b"a", b"z", None), (P, b"k", None, b"v")], {b"k": b"v"}),
    ("merge newer than a range delete", [(P, b"k", None, b"v"), (R, b"a", b"z", None), (M, b"k", None, b"w")], {b"k": b"w"}),
    ("empty value is a value", [(P, b"k", None, b"")], {b"k": b""}),
    ("empty elements", [(M, b"k", None, b""), (M, b"k", None, b"a"), (M, b"k", None, b""), (M, b"k", None, b"b")], {b"k": b"a,,b"}),
    ("empty range", [(P, b"k", None, b"v"), (R, b"z", b"a", None)], {b"k": b"v"}),
]


@pytest.mark.parametrize("name,ops,expected", SCENARIOS, ids=[s[0] for s in SCENARIOS])
def test_scenarios(spark, name, ops, expected):
    records = [(i + 1, *r) for i, r in enumerate(ops)]
    assert model.apply(records) == expected
    log = model.frame(spark, records)
    assert model.rows(resolve(log)) == expected
    assert model.rows(resolve(compaction.compact(log))) == expected


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    records = model.random_records(rng, 60)
    log = model.frame(spark, records).cache()
    snaps = sorted(rng.sample(range(1, 60), 2))
    for at in (*snaps, None):
        assert model.rows(resolve(log, at)) == model.apply(records, at)
    kept = compaction.compact(log, snaps).cache()
    for at in (*snaps, None):
        assert model.rows(resolve(kept, at)) == model.apply(records, at)
    assert kept.count() <= len(records)
    again = compaction.compact(kept, snaps)
    assert model.rows(resolve(again, snaps[0])) == model.apply(records, snaps[0])
    multi = reads.multi_snapshot(log, snaps).collect()
    for at in snaps:
        assert {bytes(r["key"]): bytes(r["value"]) for r in multi if r["snapshot"] == at} == model.apply(records, at)
    low, high = b"k2", b"k5"
    assert model.rows(reads.range_scan(log, low, high)) == {k: v for k, v in model.apply(records).items() if low <= k < high}
    asked = [b"k1", b"zz", b"k1", b"k7"]
    got = reads.multi_get(log, asked, read_seq=snaps[1]).orderBy("pos").collect()
    state = model.apply(records, snaps[1])
    assert [r["value"] and bytes(r["value"]) or r["value"] for r in got] == [state.get(k) if state.get(k) != b"" else got[i]["value"] for i, k in enumerate(asked)]


def test_snapshots_are_checked(spark):
    log = model.frame(spark, [(1, P, b"k", None, b"v")])
    with pytest.raises(InvalidArgument):
        resolve(log, 7, last_seq=1)
    with pytest.raises(InvalidArgument):
        resolve(log, -1)
    assert resolve(log, 0).count() == 0


def test_empty_log(spark):
    log = model.frame(spark, [])
    assert resolve(log).count() == 0 and compaction.compact(log, [3]).count() == 0
    assert reads.multi_get(log, []).count() == 0 and reads.next_chunk(reads.scan(log), None, 5).count() == 0


def test_next_chunk(spark):
    log = model.frame(spark, [(i + 1, P, b"%05d" % i, None, b"v") for i in range(500)])
    state, seen, after = reads.scan(log).cache(), [], None
    assert reads.next_chunk(state, None, 0).count() == 0
    while chunk := reads.next_chunk(state, after, 128).collect():
        seen += [bytes(r["key"]) for r in chunk]
        after = seen[-1]
    assert seen == [b"%05d" % i for i in range(500)]
    assert [len(c) for c in reads.chunks(state, 200)] == [200, 200, 100]
    packed = reads.pack_chunk(reads.numbered_chunks(state, 250), "chunk").orderBy("chunk").collect()
    assert [k for p in packed for k, _ in reads.unpack_chunk(bytes(p["packed"]))] == seen


def test_chunk_bounds_are_a_cursors_stops(spark, monkeypatch):
    """The stops are those of chunks that are drawn one after the other, and no row is drawn for them."""
    log = model.frame(spark, [(i + 1, P, b"%05d" % (i * 7919 % 503), None, b"v") for i in range(503)])
    state = reads.scan(log).cache()
    drawn = [(i, len(c), bytes(c[0]["key"]), bytes(c[-1]["key"])) for i, c in enumerate(reads.chunks(state, 50))]
    monkeypatch.setattr(type(state), "toLocalIterator", None)
    found = sorted((r.chunk, r.n, bytes(r.first_key), bytes(r.last_key)) for r in reads.chunk_bounds(state, 50).collect())
    assert found == drawn and len(drawn) == 11
    with pytest.raises(InvalidArgument):
        reads.chunk_bounds(state, 0)


def test_operators_agree(spark):
    records = [(1, P, b"a", None, b"5"), (2, M, b"a", None, b"7"), (3, M, b"b", None, b"2"), (4, D, b"b", None, None), (5, M, b"b", None, b"1"), (6, P, b"c", None, b"9")]
    log = model.frame(spark, records)
    assert model.rows(resolve(log, merge=merge.counter())) == {b"a": b"12", b"b": b"1", b"c": b"9"}
    plain = merge.MergeOperator("c", merge.counter().fold)
    assert model.rows(resolve(log, merge=plain)) == {b"a": b"12", b"b": b"1", b"c": b"9"}
    assert model.rows(resolve(log, merge=merge.newest())) == {b"a": b"7", b"b": b"1", b"c": b"9"}
    with pytest.raises(InvalidArgument):
        merge.operator("no such operator")


def test_key_filters_reach_the_scan(spark, tmp_path):
    log = model.frame(spark, [(1, P, b"abc", None, b"v"), (2, P, b"abd", None, b"w")])
    log.write.parquet(str(tmp_path / "log"))
    read = spark.read.parquet(str(tmp_path / "log"))
    plan = reads.prefix_scan(read, b"abc")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    plan = reads.get(read, b"abc")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan


@pytest.mark.parametrize("banded", [False, True])
def test_many_nested_ranges(spark, monkeypatch, banded):
    """Ranges that lie over each other are not met one by one: of all over a key the newest decides, in each band."""
    monkeypatch.setattr(plans, "FINE", 2)  # blocks of both steps
    rng = random.Random(5)
    text = lambda n: b"%04d" % n
    ranges = [(cf, text(lo), text(rng.choice([900, rng.randrange(lo, 900)])), rng.randrange(1000)) for cf in "ab" for lo in rng.sample(range(900), 150)]
    points = [(cf, text(rng.randrange(950)), rng.randrange(1000)) for cf in "abc" for _ in range(400)]
    band = (lambda seq: F.floor(seq / 400)) if banded else None
    same = lambda x, y: not banded or x // 400 == y // 400
    wanted = sorted(p for p in points if not any(cf == p[0] and lo <= p[1] < hi and p[2] < seq and same(p[2], seq) for cf, lo, hi, seq in ranges))
    r = spark.createDataFrame(ranges, "cf string, key binary, end_key binary, seq long")
    p = spark.createDataFrame(points, "cf string, key binary, seq long")
    for few in (1, 5000):
        found = hide_ranges(p, r, broadcast_ranges=few, band=band)
        assert sorted((x.cf, bytes(x.key), x.seq) for x in found.collect()) == wanted
    assert 0 < len(wanted) < len(points)


def test_nested_ranges_make_few_rows(spark):
    """A range makes two rows a level at most, however many ends it lies over, and they make it up."""
    n = 3000
    spans = spark.range(n).select(F.col("id").alias("lo"), F.lit(n).cast("long").alias("hi"))
    made = plans._blocks(spans, n.bit_length(), ["lo", "hi"])
    figures = made.groupBy("lo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("shiftleft(1L, level)")).alias("size"), F.min(F.expr("shiftleft(i, level)")).alias("first")).collect()
    assert len(figures) == n and all(r.n <= 2 * n.bit_length() and r.size == n - r.lo and r.first == r.lo for r in figures)
