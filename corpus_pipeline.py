"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage reads what the one before it wrote, works on all of it, and makes its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import exact_dedup, packing, quality_rules, simhash, substring
from tidelog.llm.common import documents, drop_tables, durable_table, tables_made


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them.  Repeated rows are judged alike.

    Rows and columns that stay are as they were; an empty table stays empty.
    """
    return quality_rules.drop_rejected(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; null counts as empty, and of repeated rows one stays.

    Columns stay as they were, whatever their names; an empty table stays empty.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; rows with a null id all stay.

    Texts without a word, null ones among them, are a group.  Columns stay as they were, whatever their names; an
    empty table stays empty.
    """
    return simhash.drop_near_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier go; an untouched text stays as it is, and n_chars follows the text.

    Every row stays, null and empty texts and repeated rows too; all other columns are as they were, whatever their
    names; an empty table stays empty.
    """
    return substring.rewrite(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its place in a training sequence; a null or empty text is a piece with the end id alone.

    Repeated rows are packed each by itself; other columns are not read; an empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]
#: Fingerprints, greedy parsing and tokenisation are beyond SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table; every stage but the last is written to the shared checkpoint folder.

    A stage's tables, but for its result, go when it is finished, and its result goes when the next one's stands.
    """
    docs, read = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        with tables_made() as made:
            docs = durable_table(stage(spark, docs, sf_dir))
        *inner, result = made
        drop_tables(spark, read + inner)
        read = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
