import time

from pyspark.sql import functions as F

from tests import model
from tidelog.sources.store import Store
from tidelog.streaming import ingest
from tidelog.streaming.state import Appender, Counter, Fields, keep_state

SCHEMA = "key string, seq long, field string, value string"


def feed(spark, path, start, n):
    rows = spark.range(start, start + n).select(
        (F.col("id") % 3).cast("string").alias("key"), F.col("id").alias("seq"), (F.col("id") % 2).cast("string").alias("field"), F.col("id").cast("string").alias("value")
    )
    rows.coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, processor, op, key, value, order):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    store = Store.open(spark, str(tmp_path / "state"))
    q = ingest.state_into_store(keep_state(stream, processor), op, F.expr(key), F.expr(value), order, store, "state", str(tmp_path / "check"))
    q.awaitTermination(120)
    assert q.exception() is None
    return {k.decode(): v.decode() for k, v in model.rows(store.refresh().scan()).items()}


COUNTS = ("put", "key", "string(n)", ["key"])
LISTS = ("merge", "key", "value", ["key", "seq"])
MAPS = ("put", "concat_ws(':', key, field)", "value", ["key"])


def test_counters_survive_a_restart(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), 0, 40)
    assert sum(map(int, run(spark, tmp_path, Counter(), *COUNTS).values())) == 40
    feed(spark, str(tmp_path / "in"), 40, 100)
    assert run(spark, tmp_path, Counter(), *COUNTS) == {"0": "47", "1": "47", "2": "46"}
    held = spark.read.format("statestore").option("stateVarName", "count").load(str(tmp_path / "check"))
    assert sum(r["value"]["n"] for r in held.collect()) == 140


def test_lists(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), 0, 9)
    run(spark, tmp_path, Appender(), *LISTS)
    feed(spark, str(tmp_path / "in"), 9, 3)
    assert run(spark, tmp_path, Appender(), *LISTS)["0"] == "0,3,6,9"
    held = spark.read.format("statestore").option("stateVarName", "items").load(str(tmp_path / "check"))
    assert held.count() == 12


def test_maps(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), 0, 12)
    wanted = {f"{k}:{f}": str(max(i for i in range(12) if i % 3 == k and i % 2 == f)) for k in range(3) for f in range(2)}
    assert run(spark, tmp_path, Fields(), *MAPS) == wanted
    feed(spark, str(tmp_path / "in"), 12, 1)
    assert run(spark, tmp_path, Fields(), *MAPS) == wanted | {"0:0": "12"}
    store = Store.open(spark, str(tmp_path / "state"))
    assert store.log().count() == 7  # a batch adds what it changed


def test_each_batch_asks_the_clock(spark, tmp_path):
    source, asked = str(tmp_path / "log"), []
    store = Store.open(spark, str(tmp_path / "store"))
    for i in range(2):
        model.frame(spark, [(i + 1, "put", b"a", None, b"1")]).coalesce(1).write.mode("append").parquet(source)
    clock = lambda: asked.append(len(asked)) or asked[-1]
    ingest.into_store(ingest.replay(spark, source, 1), store, "feed", str(tmp_path / "check"), ["seq"], compact=True, clock=clock).awaitTermination(120)
    assert asked == [0, 1]


def test_time_to_live(spark, tmp_path):
    """Needs processing time, whose queries do not end by themselves."""
    feed(spark, str(tmp_path / "in"), 0, 6)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = keep_state(stream, Counter(ttl_ms=3_600_000))
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.format("noop").mode("overwrite").save()).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for _ in range(120):
            if sum(p["numInputRows"] for p in q.recentProgress) >= 6:
                break
            time.sleep(0.5)
        assert q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) == 6
    finally:
        q.stop()


def test_batch_state(spark):
    rows = spark.createDataFrame([("a", 1, "f", "v"), ("a", 2, "g", "w"), ("b", 3, "f", "x")], SCHEMA)
    assert {tuple(r) for r in keep_state(rows, Counter()).collect()} == {("a", 2), ("b", 1)}


def test_stream_into_store(spark, tmp_path):
    source = str(tmp_path / "log")
    model.frame(spark, [(1, "put", b"a", None, b"1"), (2, "merge", b"a", None, b"2")]).coalesce(1).write.mode("append").parquet(source)
    store = Store.open(spark, str(tmp_path / "store"))

    def turn():
        q = ingest.into_store(ingest.replay(spark, source, 1), store, "feed", str(tmp_path / "check"), ["batch_id", "ordinal", "seq"], compact=True)
        q.awaitTermination(120)
        assert q.exception() is None
        return store.refresh().get(b"a")

    assert turn() == b"1,2"
    assert turn() == b"1,2"
    model.frame(spark, [(3, "merge", b"a", None, b"3")]).coalesce(1).write.mode("append").parquet(source)
    assert turn() == b"1,2,3"
