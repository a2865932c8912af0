"""Exact dedup by skew-safe combining, with DataFrame functions only.

Texts are equal when identical after each run of white space becomes one space.  Equal texts are combined in three
steps, each of which groups by the digest *and* the full normalised text, so that a digest collision never joins
two different texts:

1. each input partition combines its own copies (the aggregate's map side);
2. the partitions' winners meet by (digest, text, salt), so copies of one text spread over `salts` tasks;
3. the salt winners, at most `salts` rows a text, meet by digest.

Documents then look their winner up by digest; digests of very many rows are salted for that.  A digest that stands for several texts (never seen with SHA-256,
but handled) is looked up by the full text too; that second look-up runs only where such a digest exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WHITE, durable, free_names, hot_keys, salted_join


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _distinct_texts(docs: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: digest, body, keep_id, group_size; rows of one digest share a partition."""
    salted = docs.groupBy("digest", "body", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    return salted.repartition("digest").groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per input row: `id_col`, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays.  A null text counts as empty.  A null id is an id of its own
    that never wins over another; rows that repeat an id and its text are copies, and exactly one of them is kept.
    Ties cannot arise beyond that.  Very long texts are compared whole.  An empty table gives an empty result.  Other columns of `docs` are not read, so
    their names cannot clash.  `digest` is replaceable to test collisions.
    """
    body = normalised(F.col(text_col))
    source = docs.select(F.col(id_col).alias("id"), body.alias("body")).select("id", "body", digest(F.col("body")).alias("digest"))
    texts = _distinct_texts(source, salts)
    per_digest = texts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    winners = durable(per_digest.hint("rebalance"))  # a few files by size, not one per shuffle partition
    rows = source.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    hot = hot_keys(winners, ["digest"], "group_size")
    found = salted_join(rows, winners.where("n_texts = 1").drop("n_texts"), ["digest"], hot, "id").select("id", "digest", "copies", "keep_id", "group_size")
    shared = winners.where("n_texts > 1").select("digest")
    if not shared.isEmpty():  # those documents are compared by their full text
        exact = source.join(texts.join(shared, "digest", "left_semi"), ["digest", "body"]).groupBy("id", "body", "digest", "keep_id", "group_size")
        found = found.unionByName(exact.agg(F.count(F.lit(1)).alias("copies")).drop("body"))
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of `docs` that stay, with all their columns whatever their names; of rows that repeat an id and its text, one stays.

    Null, empty and very long texts, null ids, ties and empty tables are treated as `exact_dedup` says.
    """
    c_row, c_keep = free_names(docs, 2)
    row = lambda id_, digest: F.concat_ws(":", digest, F.coalesce(id_.cast("string"), F.lit("null")))
    stay = exact_dedup(docs, id_col, text_col, salts).where("kept").select(row(F.col(id_col), F.col("text_sha256")).alias(c_keep))
    marked = docs.withColumn(c_row, row(F.col(id_col), sha256(normalised(F.col(text_col)))))
    # one shuffle of the documents, by one key: it serves the join and the removal of repeated rows
    joined = marked.join(stay, F.col(c_row) == F.col(c_keep), "left_semi")
    return joined.dropDuplicates([c_row]).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
w AS (SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM w
"""
