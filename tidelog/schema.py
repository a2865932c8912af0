"""The change log's schema and its record kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE, SINGLE_DELETE, MERGE, DELETE_RANGE = "put", "delete", "single_delete", "merge", "delete_range"
OPS = (PUT, DELETE, SINGLE_DELETE, MERGE, DELETE_RANGE)
DEFAULT_CF = "default"
#: Sequence numbers use 56 bits; the lowest 8 of a packed number hold the record kind.
MAX_SEQ = (1 << 56) - 1
#: The codes of the record kinds in packed numbers.
OP_CODES = {DELETE: 0x0, PUT: 0x1, MERGE: 0x2, SINGLE_DELETE: 0x7, DELETE_RANGE: 0xF}

OP_LOG = T.StructType(
    [
        T.StructField("cf", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("end_key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
CURRENT = "cf string, key binary, value binary, seq long, n_operands int"


class InvalidArgument(ValueError):
    """A call that the engine's contract forbids."""


class NotFound(KeyError):
    """A keyspace, run or snapshot that does not exist."""


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OP_LOG)


def as_log(df: DataFrame) -> DataFrame:
    """`df` with all columns of the log, in order and typed; what it lacks becomes null (cf: the default keyspace)."""
    given = set(df.columns)
    for needed in ("seq", "op", "key"):
        if needed not in given:
            raise InvalidArgument(f"a log needs the column {needed}")
    columns = []
    for f in OP_LOG:
        if f.name in given:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(DEFAULT_CF if f.name == "cf" else None).cast(f.dataType).alias(f.name))
    return df.select(*columns)
