"""Aggregates over a query log ``(ts, q, limit, status, shard, latency_s)``; they run on streams as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default histogram bounds, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
LABELS = ("status", "shard")


def shard_label(shard):
    """``shard-<i>``, or ``single`` without a shard."""
    return F.when(shard >= 0, F.concat(F.lit("shard-"), shard.cast("string"))).otherwise(F.lit("single"))


def query_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(*LABELS).agg(F.count("*").alias("n"))


def latency_summary(log: DataFrame) -> DataFrame:
    """One row per label pair: cumulative bucket counts as an array, sum and count."""
    below = [F.count_if(F.col("latency_s") <= b) for b in LATENCY_BOUNDS]
    return log.groupBy(*LABELS).agg(
        F.array(*below, F.count("latency_s")).alias("buckets"),
        F.round(F.sum("latency_s"), 6).alias("latency_sum"),
        F.count("latency_s").alias("latency_count"),
    )


def bucket_rows(summary: DataFrame) -> DataFrame:
    """One row per label pair and bucket: ``status, shard, le, n``, with ``le = +Inf`` last."""
    names = F.array(*[F.lit(str(b)) for b in LATENCY_BOUNDS], F.lit("+Inf"))
    pairs = F.arrays_zip(names.alias("le"), F.col("buckets").alias("n"))
    rows = summary.select(*LABELS, "latency_sum", "latency_count", F.inline(pairs))
    return rows.toDF(*LABELS, "latency_sum", "latency_count", "le", "n")


def latency_histogram(log: DataFrame) -> DataFrame:
    return bucket_rows(latency_summary(log))
