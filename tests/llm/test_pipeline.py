import os
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import brute  # noqa: E402
from tests.llm.fixtures import corpus, docs, varied  # noqa: E402
from tests.llm.test_text import check_packing  # noqa: E402
from tidelog.llm.common import checkpoint_dir  # noqa: E402


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(1)
    shared = varied(rng, 60)
    rows = corpus(7, 80, varied) + [(5000 + i, varied(rng, 30) + " " + shared) for i in range(5)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, held = now.columns, dict(rows)
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns
        left = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality rules":
            assert set(left) <= {i for i, t in held.items() if not brute.rule_counts(t)[-1]}
            assert all(i in left for i, t in held.items() if not brute.rule_counts(t)[-1] and i >= 5000)
        elif name == "exact dedup":
            assert set(left) == {i for i, x in brute.exact(list(held.items())).items() if x[2]}
        elif name == "SimHash near-dedup":
            assert set(left) == {i for i, x in brute.near(list(held.items())).items() if x[1] == i}
        else:
            assert set(left) == set(held)
            wanted = brute.substring(list(held.items()))
            assert {i: len((t or "").encode().split()) for i, t in left.items()} == {i: n - gone for i, (n, gone, _) in wanted.items()}
        if name != "substring dedup":
            assert all(left[i] == held[i] for i in left)
        held = left
    last = pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert check_packing(last, list(held.items()), 2048) < 0.2
    whole = pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert {tuple(r) for r in whole} == {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in last}


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, ""), (None, None)]])
def test_empty_tables_and_texts(spark, tmp_path, rows):
    table = docs(spark, rows)
    for name in ("__row", "__keep", "__rid", "__spans", "helper0", "print", "digest", "rid", "id", "words"):
        table = table.withColumn(name, F.lit(1))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == now.columns
        after.collect()
    pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_finished_stages_leave_no_tables(spark, tmp_path):
    docs(spark, corpus(9, 20, varied)).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))
    pipeline.run(spark, str(tmp_path)).collect()
    assert len([n for n in set(os.listdir(checkpoint_dir(spark).removeprefix("file:"))) - before if n.startswith("table-")]) == 1
