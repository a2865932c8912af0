import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.fixtures import by_id, corpus, docs, prose
from tidelog.llm import exact_dedup, graph, simhash, substring
from tidelog.llm.common import checkpoint_dir


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_against_brute_force(spark, seed):
    rows = corpus(seed)
    found = by_id(exact_dedup.exact_dedup(docs(spark, rows)), "keep_id", "group_size", "kept", "text_sha256")
    assert found == brute.exact(rows)


def test_exact_with_colliding_digests(spark):
    """A digest of two values only: the full texts decide."""
    rows = corpus(3)
    weak = lambda body: (F.length(body) % 2).cast("string")
    found = by_id(exact_dedup.exact_dedup(docs(spark, rows), digest=weak), "keep_id", "group_size", "kept")
    assert found == {i: x[:3] for i, x in brute.exact(rows).items()}


def test_exact_odd_rows(spark):
    table = docs(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (5, None), (6, "")])
    clashing = table.withColumn("keep_id", F.lit(0)).withColumn("digest", F.lit("x")).withColumn("body", F.lit(1)).withColumn("__row", F.lit("r"))
    clashing = clashing.withColumn("__keep", F.lit("k")).withColumn("helper0", F.lit(1)).withColumn("Helper_1", F.lit(2))
    found = exact_dedup.exact_dedup(clashing).collect()
    assert len(found) == 7
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in found) == [
        ("1", "1", 3, False), ("1", "1", 3, True), ("2", "1", 3, False), ("5", "5", 2, True), ("6", "5", 2, False), ("None", "None", 2, False), ("None", "None", 2, True),
    ]
    left = exact_dedup.drop_exact_copies(clashing)
    assert left.columns == clashing.columns and {(r["__row"], r["__keep"], r["helper0"], r["Helper_1"]) for r in left.collect()} == {("r", "k", 1, 2)}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "5", "None"]
    assert exact_dedup.exact_dedup(table.limit(0)).count() == 0 == exact_dedup.drop_exact_copies(table.limit(0)).count()


@pytest.mark.parametrize("salt_from", [0, graph.SALT_FROM])
def test_components(spark, salt_from):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long"), salt_from).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert found == brute.components([p for p in pairs if p[0] != p[1]], nodes)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_brute_force(spark, seed):
    rows = corpus(seed)
    found = by_id(simhash.near_dedup(docs(spark, rows)), "fingerprint", "component_id")
    assert found == brute.near(rows)


@pytest.mark.parametrize("crowded", [2, 64])
def test_links_join_all_close_prints(spark, crowded):
    """Clouds of prints around a few centres, with buckets paired off and by flipped bits."""
    rng = random.Random(9)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(12):
            value = centre
            for _ in range(rng.randrange(5)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    got = [(r["u"], r["v"]) for r in simhash.links(frame, crowded).collect()]
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(far(a, b) <= 3 for a, b in got)
    close = [(a, b) for a in signed for b in signed if a < b and far(a, b) <= 3]
    assert brute.components(got, signed) == brute.components(close, signed)


def test_near_odd_rows(spark):
    table = docs(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None), (9, " \n"), (8, "A B\tC")]).withColumn("print", F.lit(1)).withColumn("root", F.lit(1))
    table = table.withColumn("__keep", F.lit(1)).withColumn("helper0", F.lit(1)).withColumn("n", F.lit(1))
    found = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_dedup(table).collect())
    same, none = f"{brute.simhash('a b c'):016x}", "0" * 16
    assert found == [("2", none, 2), ("4", same, 4), ("4", same, 4), ("8", same, 4), ("9", none, 2), ("None", same, 4)]
    left = simhash.drop_near_copies(table)
    assert left.columns == table.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "4", "4", "None"]
    assert simhash.near_dedup(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("buffer,hot", [(40, 2), (1_000_000, 0), (1_000_000, 4_096)])
def test_substring_against_brute_force(spark, seed, buffer, hot):
    """With small and large buffers, and with some, all and none of the anchors spread."""
    rows = corpus(seed)
    found = by_id(substring.substring_dedup(docs(spark, rows), keep="digest", buffer=buffer, hot=hot), "n_words", "n_removed", "kept_sha256")
    assert found == brute.substring(rows)


@pytest.mark.parametrize("hot", [3, 4_096])
def test_factors_name_earlier_places_of_the_same_words(spark, hot):
    rows = corpus(4)
    words = {i: brute.WORD.findall(t or "") for i, t in rows}
    covered = {i: set() for i in words}
    for r in substring.factors(docs(spark, rows), hot=hot, buffer=60).collect():
        i, at, n = r["doc_id"], r["start"], r["length"]
        assert n >= 20 and (r["source_id"], r["source_start"]) < (i, at)
        assert words[i][at : at + n] == words[r["source_id"]][r["source_start"] : r["source_start"] + n]
        covered[i] |= set(range(at, at + n))
    assert {i: len(c) for i, c in covered.items()} == {i: x[1] for i, x in brute.substring(rows).items()}


def test_the_parse_is_greedy():
    """A block gives the longest factor that its earliest source allows, and asks again across the boundary."""
    block = substring.Block(3)
    assert block.parse(b"a b c d e", 1, 0) == [] and block.parse(b"x b c d e f", 2, 10) == [(11, 2, 1, 1)]
    assert block.parse(b"a b c d e f", 3, 5) == [(5, 3, 1, 0), (8, 1, 2, 13)]
    assert block.parse(b"a b c d e", 9, 7) == [(7, 3, 1, 0)] and block.parse(b"q r s", 9, 20) == []
    assert substring.joined([{"at": 8 << 32 | 1, "from_rid": 1, "from_at": 3}, {"at": 5 << 32 | 3, "from_rid": 1, "from_at": 0}], 3) == [(5, 6, 1, 0)]


def test_one_passage_in_most_rows(spark):
    """Half of all rows hold one passage, and one phrase of ten words stands in all of them in different contexts."""
    rng = random.Random(11)
    passage, phrase = prose(rng, 40), prose(rng, 10)
    rows = [(i, f"{prose(rng, 15)} {phrase} {prose(rng, 15)} " + (passage if i % 2 else prose(rng, 10))) for i in range(200)]
    found = by_id(substring.substring_dedup(docs(spark, rows, 6), keep="digest", buffer=300, hot=5), "n_words", "n_removed", "kept_sha256")
    assert found == brute.substring(rows)


def test_substring_low_entropy(spark):
    """Texts of two words repeat most of their sequences, also inside themselves."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(15, 60)))) for i in range(40)]
    for span, gram in ((20, 6), (7, 3)):
        found = by_id(substring.substring_dedup(docs(spark, rows), span=span, gram=gram, keep="digest"), "n_words", "n_removed", "kept_sha256")
        assert found == brute.substring(rows, span)


def test_substring_odd_rows(spark):
    rng = random.Random(4)
    passage, other = prose(rng, 30), prose(rng, 25)
    rows = [(7, passage), (7, passage), (3, "intro " + passage), (None, other), (9, "x " + other), (9, "y " + other), (1, None), (2, "")]
    table = docs(spark, rows)
    for name in ("rid", "spans", "__rid", "__spans", "__of", "__h", "__id", "helper0", "HELPER_1"):
        table = table.withColumn(name, F.lit(1))
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring.substring_dedup(table).collect())
    assert found == sorted(
        [("None", 25, 0, other), ("1", 0, 0, None), ("2", 0, 0, ""), ("3", 31, 0, "intro " + passage), ("7", 30, 30, ""), ("7", 30, 30, ""), ("9", 26, 25, "x"), ("9", 26, 25, "y")],
        key=lambda r: (r[0], r[1], r[2], r[3]),
    )
    again = substring.rewrite(table)
    assert again.columns == table.columns
    assert sorted((str(r["doc_id"]), r["text"] or "", r["n_chars"]) for r in again.collect()) == sorted((a, d or "", None if d is None else len(d)) for a, _, _, d in found)
    assert substring.substring_dedup(table.limit(0)).count() == 0 == substring.rewrite(table.limit(0)).count()


def test_rewrite_leaves_the_rest(spark):
    rng = random.Random(6)
    passage = prose(rng, 30)
    rows = [(1, "kept  as\nit is"), (2, passage), (3, "a  b " + passage + "\n c")]
    left = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"]) for r in substring.rewrite(docs(spark, rows)).collect()}
    assert left == {1: (rows[0][1], len(rows[0][1]), "en"), 2: (passage, len(passage), "en"), 3: ("a b c", 5, "en")}


def test_most_rows_are_copies_of_one_text(spark):
    """Two thirds of all rows are one text, a third of them empty: groups are whole, one row of each stays."""
    rows = [(i, ["the same text here", "", f"own text number {i}"][i % 3]) for i in range(600)]
    table = docs(spark, rows, 7)
    assert by_id(exact_dedup.exact_dedup(table), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)
    assert by_id(simhash.near_dedup(table), "fingerprint", "component_id") == brute.near(rows)


def test_checkpoints_go_where_the_session_says(spark):
    assert checkpoint_dir(spark) in (spark.conf.get("spark.checkpoint.dir"), spark.sparkContext.getCheckpointDir())
