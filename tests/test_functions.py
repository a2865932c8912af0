import struct

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import filters, keys, random, scalar
from tidelog.operators import compaction
from tidelog.schema import InvalidArgument
from tidelog.sources import filenames


@given(st.binary(max_size=4), st.binary(max_size=5))
def test_prefix_bounds(prefix, key):
    end = keys.prefix_successor(prefix)
    assert key.startswith(prefix) == (key >= prefix and (end is None or key < end))


@given(st.binary(max_size=4), st.binary(max_size=4))
def test_separators(a, b):
    low, high = min(a, b), max(a, b)
    if low < high:
        assert low <= keys.shortest_separator(low, high) < high
    assert keys.short_successor(a) >= a


def test_bounds_by_hand():
    assert keys.prefix_successor(b"a\xff") == b"b" and keys.prefix_successor(b"\xff\xff") is None and keys.prefix_successor(b"") is None
    assert keys.short_successor(b"\xff\x01z") == b"\xff\x02" and keys.shortest_separator(b"abc", b"abx") == b"abd"


@given(st.integers(0, 2**64 - 1))
def test_varints(n):
    assert scalar.read_varint(scalar.varint(n)) == (n, len(scalar.varint(n)))


def test_varint_errors():
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(ValueError):
            scalar.read_varint(bad)


def test_checksums():
    assert scalar.crc32c_of(b"123456789") == 0xE3069283
    assert scalar.crc32c_of(b"6789", scalar.crc32c_of(b"12345")) == 0xE3069283
    assert scalar.unmask_of(scalar.mask_of(0xE3069283)) == 0xE3069283 != scalar.mask_of(0xE3069283)
    assert scalar.fnv32_of(b"a") == 0xE40C292C
    assert scalar.hash64_of(b"a") != scalar.hash64_of(b"a", 1)


def test_codes_of_whole_batches(spark):
    """Values of all lengths, null and empty ones among them, in slices too."""
    rng = __import__("random").Random(5)
    values = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 70))) for _ in range(120)] + [None, b"", None, b"x" * 3000]
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    plain = ((scalar.crc32c, scalar.crc32c_of), (scalar.masked_crc32c, lambda b: scalar.mask_of(scalar.crc32c_of(b))), (scalar.fnv32, scalar.fnv32_of), (scalar.hash64, lambda b: signed(scalar.hash64_of(b))))
    for code, one in plain:
        wanted = [None if v is None else one(v) for v in values]
        assert code.codes(pa.array(values, pa.binary())).to_pylist() == wanted
        assert code.codes(pa.array(values, pa.binary()).slice(30, 94)).to_pylist() == wanted[30:124]
        assert code.codes(pa.array([], pa.binary())).to_pylist() == []
    frame = spark.createDataFrame([(v and bytearray(v),) for v in values], "v binary")
    found = frame.select("v", scalar.crc32c(F.col("v")).alias("c"), scalar.unmasked_crc32c(scalar.masked_crc32c(F.col("v"))).alias("u")).collect()
    assert all(r["c"] == r["u"] == (None if r["v"] is None else scalar.crc32c_of(bytes(r["v"]))) for r in found)


def test_varints_are_decoded_in_the_engine(spark):
    numbers = [0, 1, 127, 128, 300, 2**31, 2**62, 2**63 - 1, 2**63, 2**64 - 1] + [3 << 7 * i for i in range(9)]
    rows = [(bytearray(scalar.varint(n) + b"rest" * (i % 2)), n - (1 << 64) if n >> 63 else n) for i, n in enumerate(numbers)] + [(None, None)]
    frame = spark.createDataFrame(rows, "c binary, n long")
    assert all(r["d"] == r["n"] for r in frame.select("n", scalar.decode_varint(F.col("c")).alias("d")).collect())
    for bad in (b"", b"\x80", b"\xff" * 11, b"\xff" * 9 + b"\x02"):
        with pytest.raises(Exception, match="not a varint"):
            spark.createDataFrame([(bytearray(bad),)], "c binary").select(scalar.decode_varint(F.col("c"))).collect()


def test_generators():
    g = random.MinimalStandard(1)
    assert [g.next() for _ in range(3)] == [16807, 282475249, 1622650073]
    assert random.MinimalStandard(0).next() == 16807 and random.MinimalStandard(2**31 - 1).next() == 16807
    assert all(0 <= g.skewed(5) < 32 for _ in range(50)) and random.XorShiftStar(0).next() == random.XorShiftStar(0).next()
    with pytest.raises(ValueError):
        g.uniform(0)


def test_unsigned_columns(spark):
    row = spark.range(1).select(
        F.hex(scalar.encode_varint(F.lit(-1))).alias("most"), scalar.from_fixed_be(F.unhex(F.lit("FF" * 8))).alias("minus"), scalar.from_fixed_be(F.unhex(F.lit("00FF"))).alias("short")
    )
    assert row.first() == ("FF" * 9 + "01", -1, None)


def test_file_names():
    assert filenames.parse("000012.sst") == ("table", 12) and filenames.make("table", 12) == "000012.sst"
    assert filenames.parse("LOG.old.5") == ("info_log", 0) and filenames.make("descriptor", 3) == "MANIFEST-000003"
    for bad in ("x", "x.sst", "5.exe", "MANIFEST-"):
        with pytest.raises(InvalidArgument):
            filenames.parse(bad)


def test_pickers():
    assert compaction.pick_oldest(3) is None and compaction.pick_oldest(6) == [2, 3, 4, 5] and compaction.pick_oldest(5, 2, 9) == [0, 1, 2, 3, 4]
    run = lambda i, level, lo, hi, cf="a": {"cf": cf, "run_id": i, "level": level, "smallest_key": lo, "largest_key": hi}
    runs = [run(1, 1, b"a", b"c"), run(2, 1, b"x", b"z"), run(3, 0, b"b", b"d"), run(4, 0, b"c", b"e"), run(5, 0, b"a", b"a", "b")]
    assert compaction.pick(runs, {"a": 2}) == {"cf": "a", "runs": [3, 4, 1]} and compaction.pick(runs) is None


def frames(*stamps):
    return b"".join(struct.pack(">Iq", 9, t) + b"%d" % i for i, t in enumerate(stamps))


def test_framed_lists():
    now, ttl = 100_000, 45_000
    assert filters.framed_tail(frames(now - 60_000, now - 30_000, now), now, ttl) == frames(now - 60_000, now - 30_000, now)[13:]
    assert filters.framed_tail(frames(now, now), now, ttl) == frames(now, now)
    assert filters.framed_tail(frames(0, 1), now, ttl) is None
    assert filters.framed_tail(b"", now, ttl) == b"" and filters.framed_tail(b"odd", now, ttl) == b"odd"


def test_value_ttl_is_strict(spark):
    stamped = lambda t: bytearray(struct.pack(">q", t) + b"x")
    state = spark.createDataFrame([("edge", stamped(500)), ("old", stamped(499)), ("future", stamped(5000)), ("short", bytearray(b"s"))], "k string, value binary")
    left = compaction.ttl_view(state.withColumn("key", F.col("k").cast("binary")), filters.value_ttl(1000, 500))
    assert {r["k"] for r in left.collect()} == {"edge", "future", "short"}
    little = filters.value_ttl(1000, 500, filters.timestamp_at(0, little=True))
    rows = spark.createDataFrame([("old", bytearray(struct.pack("<q", 1)))], "k string, value binary").withColumn("key", F.col("k").cast("binary"))
    assert compaction.ttl_view(rows, little).count() == 0
    assert filters.TtlConfig("disabled").filter(0) is None
    with pytest.raises(InvalidArgument):
        filters.TtlConfig("odd", 5).filter(0)
