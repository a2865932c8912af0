"""Helpers that the corpus operators share: durable intermediates and identifiers.

Intermediates are cut with reliable checkpoints in the folder that ``spark.checkpoint.dir`` names, which every
executor can read, so a lost executor costs a re-read and not a recomputation from the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.durable import checkpoint_dir, durable
from tidelog.sources.files import Files

__all__ = ["LOWER", "UPPER", "WHITE", "Table", "checkpoint_dir", "documents", "drop_tables", "durable", "durable_table", "free_names", "held_out", "hot_keys", "lower_ascii", "salted_join", "tables_made"]

#: One run of the white space that separates words; Java, DuckDB and Python read it alike.
WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths that `durable_table` writes inside the block, in their order."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    files = Files(spark)
    for path in paths:
        files.delete(path)


def durable_table(df: DataFrame) -> DataFrame:
    """Like `durable`, but as compressed Parquet: for intermediates whose bytes follow the corpus.

    The table stays until `drop_tables`, or the clean-up of the shared folder.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, n: int, *others: DataFrame) -> list[str]:
    """`n` column names that neither `df` nor `others` have, in any case."""
    taken, stem = {c.lower() for x in (df, *others) for c in x.columns}, "helper"
    while any(c.startswith(stem) for c in taken):
        stem += "_"
    return [f"{stem}{i}" for i in range(n)]


#: Keys that hold more than one in `HOT_KEYS` of all rows are hot; there cannot be more of them than that.
HOT_KEYS, SALTS = 4_096, 64


def hot_keys(sizes: DataFrame, on: list[str], n: str, one_in: int = HOT_KEYS, total: int | None = None) -> DataFrame:
    """The keys `on` that hold more than one in `one_in` of all rows; fewer than `one_in` of them, so they may be broadcast.

    `sizes` has one row per key and its number of rows in column `n`; it is read twice, so it should be durable.
    `total` is the sum of those, where it is known.
    """
    total = (sizes.agg(F.sum(n)).first()[0] or 0) if total is None else total
    return sizes.where(F.col(n) * one_in > total).select(*on)


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """`rows` joined with `table`, which has one row per key `on` at most, so that no hot key meets in one task.

    `hot` are keys from `hot_keys`.  Rows of a hot key are spread over `salts` tasks by a hash of column `spread`, and
    the table's rows of hot keys are repeated for each of them.  Keys are never null.
    """
    mark, salt = free_names(rows, 2, table)
    marked = F.broadcast(hot.withColumn(mark, F.lit(True)))
    salted = rows.join(marked, on, "left").withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop(mark)
    each = F.when(F.col(mark), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(marked, on, "left").withColumn(salt, F.explode(each)).drop(mark)
    return salted.join(copies, [*on, salt], how).drop(salt)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def held_out(id_column):
    """True where crc32 of the id's decimal text is divisible by 5."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


class Table:
    """A worker's map of about `size` entries at most that keeps what is in use.

    `fill` makes sure that `now` has the wanted keys; `trim`, after use, lets go of long keys and, when half the size
    is reached, of all entries that were not asked for since it last was.
    """

    def __init__(self, size: int, longest: int = 64):
        self.half, self.longest = size // 2, longest
        self.now, self.before, self.long = {}, {}, []

    def fill(self, keys: set[str], ask: Callable[[list[str]], Iterable]) -> dict:
        now, before = self.now, self.before
        new = [k for k in keys if k not in now]
        if before:
            now.update((k, before[k]) for k in new if k in before)
            new = [k for k in new if k not in now]
        now.update(zip(new, ask(new), strict=True))
        self.long += [k for k in new if len(k) > self.longest]
        return now

    def trim(self) -> None:
        for k in self.long:
            del self.now[k]
        self.long = []
        if len(self.now) > self.half:
            self.before, self.now = self.now, {}
