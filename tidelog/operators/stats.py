"""Figures about logs, runs and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import DELETE_RANGE, MERGE

STOP_WRITES = 36


def run_metadata(log: DataFrame, by: str = "run_id") -> DataFrame:
    """Per keyspace and run: n_entries, size, smallest_key, largest_key, min_seq, max_seq, n_merges."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.groupBy("cf", by).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum(size).alias("size"),
        F.min("key").alias("smallest_key"),
        F.max(F.when(F.col("op") == DELETE_RANGE, F.col("end_key")).otherwise(F.col("key"))).alias("largest_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.count_if(F.col("op") == MERGE).alias("n_merges"),
    )


def histogram_buckets(values: DataFrame, value: str) -> DataFrame:
    """Counts by power of two: bucket i holds 2**i up to 2**(i+1) - 1, bucket 0 also 0."""
    v = F.col(value).cast("long")
    bucket = F.when(v < 2, 0).otherwise(F.length(F.bin(v)) - 1)
    return values.where(v >= 0).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram(values: DataFrame, value: str) -> DataFrame:
    """One row: count, sum, min, max, mean, and percentiles as the upper bound of the bucket that they fall into.

    Percentiles come of the 63 bucket counts, so the data is read and shuffled in aggregate only.
    """
    v = F.col(value).cast("long")
    totals = values.where(v >= 0).agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(v), F.lit(0)).alias("sum"), F.coalesce(F.min(v), F.lit(0)).alias("min"), F.coalesce(F.max(v), F.lit(0)).alias("max")
    )
    along = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 63 rows at most
    seen = histogram_buckets(values, value).withColumn("seen", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    upper = F.expr("shiftleft(1L, bucket + 1) - 1")

    def percentile(p: float) -> Column:
        return F.coalesce(F.min(F.when(F.col("seen") >= F.ceil(F.lit(p) * F.col("all")), upper)), F.lit(0))

    names = {"p50": 0.50, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
    points = seen.agg(*[percentile(p).alias(k) for k, p in names.items()])
    mean = F.when(F.col("count") == 0, 0.0).otherwise(F.col("sum") / F.col("count")).alias("mean")
    return totals.join(F.broadcast(points)).select("count", "sum", "min", "max", mean, *names)


def properties(runs: DataFrame, pending: dict[str, int] | None = None, trigger: int = 4, stop: int = STOP_WRITES) -> DataFrame:
    """Engine properties per keyspace as (cf, name, value).  Figures of write buffers are those of `pending` records."""
    levels = {f"num-files-at-level{i}": F.count_if(F.col("level") == i) for i in range(7)}
    fresh = F.count_if(F.col("level") == 0)
    named = levels | {
        "total-sst-files-size": F.sum("size"),
        "live-sst-files-size": F.sum("size"),
        "compaction-pending": F.when(fresh >= trigger, 1).otherwise(0),
        "num-running-compactions": F.lit(0),
        "num-running-flushes": F.lit(0),
        "estimate-pending-compaction-bytes": F.coalesce(F.sum(F.when(F.col("level") == 0, F.col("size"))), F.lit(0)),
        "is-write-stopped": F.when(fresh >= stop, 1).otherwise(0),
        "actual-delayed-write-rate": F.lit(0),
    }
    for name in ("num-immutable-mem-table", "mem-table-flush-pending", "block-cache-capacity", "block-cache-usage"):
        named[name] = F.lit(0)
    for name in ("cur-size-active-mem-table", "cur-size-all-mem-tables", "size-all-mem-tables", "num-entries-active-mem-table"):
        named[name] = F.lit((pending or {}).get("entries" if "entries" in name else "bytes", 0))
    wide = runs.groupBy("cf").agg(*[c.cast("long").alias(k) for k, c in named.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("value")) for k in named])
    return wide.select("cf", F.explode(pairs).alias("p")).select("cf", "p.name", "p.value")


def get_property(props: DataFrame, name: str, cf: str = "default") -> int | None:
    """One property; None if unknown.  A vendor prefix in front of a dot is ignored."""
    short = name.rsplit(".", 1)[-1]
    row = props.where((F.col("cf") == cf) & (F.col("name") == short)).first()
    return row and row["value"]


def tickers(log: DataFrame) -> DataFrame:
    """Counters of a log, one row: records and bytes written, by kind."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    kinds = ("put", "delete", "single_delete", "merge", "delete_range")
    return log.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_written"), *[F.count_if(F.col("op") == k).alias(f"n_{k}") for k in kinds]
    )
