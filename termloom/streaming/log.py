"""Continuous query-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.querylog import latency_summary, query_counts
from ..operators.routing import last_hot_stats

CACHE_TTL = "5 minutes"


def stream_collapse(log: DataFrame, ttl: str = CACHE_TTL) -> DataFrame:
    """The first of each ``(q, limit)`` passes; repeats within ``ttl`` of it do not, and do not prolong it.

    State is one row per key and is dropped when the watermark passes its expiry.
    """
    return log.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["q", "limit"])


def stream_query_counts(log: DataFrame) -> DataFrame:
    """Running counts; state is one row per status and shard."""
    return query_counts(log)


def stream_latency(log: DataFrame) -> DataFrame:
    return latency_summary(log)


def stream_hot_stats(log: DataFrame) -> DataFrame:
    """The last write per hot term; state is one row per hot term."""
    return last_hot_stats(log)


def write_snapshots(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode results, the newest in ``<path>/batch-<n>``; a replayed batch overwrites itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        result.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
