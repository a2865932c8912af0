"""Every registered query that has SQL is held against it on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidelog.sources.store import Store

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr([plain(v) for v in r]) for r in df.select(columns).collect())
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert found == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_whole_prefix_scan_gives_every_key(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    wanted = {f"{r.o_custkey:08}:{r.o_orderkey:010}" for r in orders if f"{r.o_custkey:08}".startswith("000000")}
    found = [r.key for r in entry.queries()["prefix_scan"](spark, SF).collect()]
    assert len(found) == len(wanted) and set(found) == wanted and any(not k.startswith("1:", 7) for k in found)


def test_probes_reach_the_end_of_the_log(spark):
    last = spark.read.parquet(f"{SF}/events.parquet").count()
    at = {r.at for r in entry.queries()["as_of_join"](spark, SF).select("at").collect()}
    assert min(at) == 0 and max(at) == last


def test_varint_codes_of_all_lengths(spark):
    found = entry.queries()["varint_codes"](spark, SF).collect()
    assert {len(r.code) // 2 for r in found} == set(range(1, 10)) and all(r.back == r.o_orderkey for r in found if r.kind == "key")


def test_keys_wrongly_shown_at_a_snapshot_are_seen(spark, monkeypatch):
    scan = Store.scan
    wrong = lambda self, **at: scan(self, **at).unionByName(scan(self, **at).limit(1).withColumn("key", F.lit(b"wrong")))
    monkeypatch.setattr(Store, "scan", wrong)
    assert "wrong" in {r.key for r in entry.queries()["store_snapshot_after_compaction"](spark, SF).collect()}


def test_every_query_has_sql():
    assert set(entry.queries()) - set(ORACLES) <= {"pipeline"} | {n for n in entry.queries() if n.startswith("op")}
