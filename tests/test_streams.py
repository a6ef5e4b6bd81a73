"""Streams: the same results as batches, and nothing new after a restart."""

import pytest
from pyspark.sql import functions as F

from termloom.functions import clean_markup
from termloom.operators.indexing import build_index, postings_long
from termloom.operators.querylog import LATENCY_BOUNDS, latency_histogram
from termloom.operators.routing import last_hot_stats
from termloom.session import work_path
from termloom.sources.index_store import manifest, open_index
from termloom.sources.tables import local_table
from termloom.streaming.ingest import stream_upserts
from termloom.streaming.log import stream_collapse, stream_hot_stats, stream_latency, write_snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(spark, path, records, stamp):
    schema = "id string, title string, body string"
    df = local_table(spark, records, schema).withColumn("indexed_at", F.lit(stamp).cast("timestamp"))
    df.coalesce(1).write.mode("append").json(path)


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    source, target, checkpoint = (work_path(spark, n) for n in ("in", "idx", "cp"))
    text = "[[word]] number {} " + "filler " * 10
    first = [(f"d{i}", "t", text.format(i)) for i in range(20)] + [("short", "t", "x")]
    second = [(f"d{i}", "t", text.format(i + 100)) for i in range(10, 30)]
    put(spark, source, first, "2024-01-01 00:00:00")
    stream_upserts(spark, source, target, checkpoint).awaitTermination()
    put(spark, source, second, "2024-01-02 00:00:00")
    stream_upserts(spark, source, target, checkpoint).awaitTermination()
    versions = manifest(spark, target).count()
    assert versions == 2
    stream_upserts(spark, source, target, checkpoint).awaitTermination()
    assert manifest(spark, target).count() == versions
    newest = {i: b for i, _, b in first if i != "short"} | {i: b for i, _, b in second}
    docs = local_table(spark, [(i, "t", b) for i, b in newest.items()], "id string, title string, body string")
    batch = build_index(docs.withColumn("body", clean_markup(F.col("body"), None)), work_path(spark, "batch"))
    live = open_index(spark, target)
    assert rows(live.docs().select("id", "body")) == rows(batch.docs().select("id", "body"))
    assert rows(postings_long(live)) == rows(postings_long(batch))
    assert live.totals == batch.totals
    # A replay of the whole input under a lost checkpoint finds its batches in the manifest.
    stream_upserts(spark, source, target, work_path(spark, "cp2"), max_files=1).awaitTermination()
    assert rows(open_index(spark, target).docs().select("id", "body")) == rows(batch.docs().select("id", "body"))


def test_collapse_passes_once_per_ttl(spark):
    source, out, checkpoint = (work_path(spark, n) for n in ("log", "out", "cp"))
    schema = "ts timestamp, q string, limit int"
    at = lambda minute, q: (f"2024-01-01 00:{minute:02d}:00", q, 5)
    for batch in ([at(0, "a"), at(1, "a"), at(4, "a")], [at(30, "b")], [at(31, "a")]):
        df = local_table(spark, batch, "ts string, q string, limit int").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        passed = stream_collapse(spark.readStream.schema(schema).parquet(source))
        passed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).select(F.minute("ts"), "q")
    times = rows(got)
    assert [q for _, q in times].count("b") == 1 and (31, "a") in times and len(times) == 3


def test_latency_buckets(spark):
    log = local_table(spark, [("ok", "s", x) for x in (0.004, 0.005, 7.0, 20.0)], "status string, shard string, latency_s double")
    got = {r.le: r.n for r in latency_histogram(log).collect()}
    assert (got["0.005"], got["5.0"], got["10.0"], got["+Inf"]) == (2, 2, 3, 4)
    assert len(got) == len(LATENCY_BOUNDS) + 1


@pytest.mark.parametrize("make", [stream_hot_stats, stream_latency])
def test_running_results_equal_batch(spark, make):
    source, out, checkpoint = (work_path(spark, n) for n in ("log", "out", "cp"))
    log = spark.range(500).select(
        F.col("id").alias("query_id"),
        F.timestamp_seconds(F.col("id") * 13 % 501).alias("ts"),
        F.concat(F.lit("q"), F.col("id") % 7).alias("q"),
        F.when(F.col("id") % 3 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("routing_type"),
        (F.col("id") % 11).alias("hits"),
        (F.col("id") % 3).alias("shards"),
        F.lit("success").alias("status"),
        F.concat(F.lit("shard-"), F.col("id") % 4).alias("shard"),
        (F.col("id") / 100).alias("latency_s"),
    )
    log.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(source)
    write_snapshots(make(stream), out, checkpoint).awaitTermination()
    snapshots = spark.read.parquet(out)
    last = snapshots.agg(F.max("batch")).collect()[0][0]
    got = snapshots.where(F.col("batch") == last).drop("batch")
    assert rows(got) == rows(make(log) if make is stream_latency else last_hot_stats(log))
