"""SimHash near-dedup by pigeonhole blocks.

A fingerprint holds the majority bit of the XXH64 hashes of all word 3-shingles.  Documents of one fingerprint form
one class; from there on only distinct fingerprints are compared.  Their 64 bits are cut into six blocks.  Two
fingerprints that differ in at most three bits agree on three whole blocks at least, so each of the 20 choices of three
blocks (31 to 33 bits) is a table in which they share a bucket.  Pairs inside buckets are verified by their
Hamming distance.

Buckets of more than `CROWDED` fingerprints are not paired off, which would take the square of their size.  Their
members are linked exactly in another way, at a cost in proportion to their number: fingerprints x and y differ in at most
three bits if and only if some key is reached from x by flipping at most one bit and from y by flipping at most
two.  All that reach a key are linked to the smallest one that reaches it with at most one flip; each such link is
within three bits, and a chain of them joins every pair that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, free_names, hot_keys, salted_join
from tidelog.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bits of the six blocks, from the lowest.
BLOCKS = (11, 11, 11, 11, 10, 10)
CROWDED = 64


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a text; zero where it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    ends = [n - 1 for n in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(n + 1 for n in ends[:-1])]
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for lo in range(0, n, 1 << 15):  # whole texts, in bounded steps
        hi = min(n, lo + (1 << 15))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[lo:hi], ends[lo + SHINGLE - 1 : hi + SHINGLE - 1])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and print (the fingerprint's bits as a signed long)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("print", T.LongType())])
    return source.mapInArrow(_fingerprint_batches, schema)


def _masks(radius: int) -> list[int]:
    """Signed masks of the block choices on which prints within `radius` bits must agree in one at least."""
    at = [0, *accumulate(BLOCKS)]
    blocks = [((1 << size) - 1) << at[i] for i, size in enumerate(BLOCKS)]
    masks = [sum(x) for x in combinations(blocks, len(BLOCKS) - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _crowded_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect all prints within RADIUS bits of each other; linear in the number of prints."""
    flips = """flatten(transform(sequence(0, 63), i -> transform(sequence(0, i), j -> struct(
        print ^ shiftleft(1L, i) ^ if(j < i, shiftleft(1L, j), 0L) AS key, if(j < i, 2, 1) AS n))))"""
    reach = prints.select("print", F.explode(F.expr(f"concat(array(struct(print AS key, 0 AS n)), {flips})")).alias("r")).select("print", "r.key", "r.n")
    centre = reach.groupBy("key").agg(F.min(F.when(F.col("n") <= 1, F.col("print"))).alias("u"), F.count(F.lit(1)).alias("size"))
    centre = centre.where("u is not null and size > 1").select("key", "u")
    return reach.join(centre, "key").where("u <> print").select("u", F.col("print").alias("v")).distinct()


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (u, v) between distinct prints (column print) whose closure joins all pairs within RADIUS bits."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("table"), F.col("print").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(_masks(RADIUS))])
    filed = prints.select("print", F.explode(keys).alias("k")).select("k.table", "k.bucket", "print")
    sizes = durable(filed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").hint("rebalance"))
    shared = durable(salted_join(filed, sizes, ["table", "bucket"], hot_keys(sizes, ["table", "bucket"], "size"), "print"))
    one = shared.where(F.col("size") <= crowded).select("table", "bucket", "print")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    pairs = one.withColumnRenamed("print", "u").join(one.withColumnRenamed("print", "v"), ["table", "bucket"]).where((F.col("u") < F.col("v")) & close)
    hot = shared.where(F.col("size") > crowded).select("print").distinct()
    return pairs.select("u", "v").union(_crowded_links(hot))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row per input row: `id_col`, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Texts without a word, null ones among them, share fingerprint zero and are linked like any other.  A null id never
    becomes a component's id unless all its ids are null.  Rows that repeat an id each get a row.  Other columns are
    not read; an empty table gives an empty result.  All texts are read whole.
    """
    prints = durable(fingerprints(docs, id_col, text_col))
    classes = durable(prints.groupBy("print").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes.select("print"), crowded))
    rooted = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return salted_join(prints, named, ["print"], hot_keys(classes, ["print"], "n"), "id").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of their group, with all their columns whatever their names.

    Rows with a null id stay: nothing tells which of them is the first.  Null, empty and very long texts, repeated ids
    and empty tables are treated as `near_dedup` says.
    """
    (c_keep,) = free_names(docs, 1)
    stay = near_dedup(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(c_keep)).distinct()
    named = docs.join(stay, F.col(id_col) == F.col(c_keep), "left_semi")
    return named.unionByName(docs.where(F.col(id_col).isNull()))
