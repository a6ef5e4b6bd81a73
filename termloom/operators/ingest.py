"""From pages to documents: cleaning, length filter, dense ids, shards, caps and counters."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.keys import shard_of
from ..functions.text import MIN_BODY_BYTES, clean_markup, long_enough
from ..functions.vectors import has_vector
from ..session import work_path
from ..sources.tables import local_table

ROW_BITS = 33  # monotonically_increasing_id() keeps the row number in the low 33 bits


def clean_pages(
    pages: DataFrame,
    max_len: int | None = None,
    min_bytes: int = MIN_BODY_BYTES,
    unit: str = "chars",
) -> DataFrame:
    """``text`` becomes a clean ``body``; pages whose body is too short are dropped.

    The body passes through an array of at most one element: a filter on it would be pushed below the projection
    and clean every text twice.
    """
    body = F.array(clean_markup(F.col("text"), max_len, unit))
    kept = F.filter(body, lambda b: long_enough(b, min_bytes))
    return pages.select(*[c for c in pages.columns if c != "text"], F.explode(kept).alias("body"))


def number_rows(df: DataFrame, order_by: str | None = None, column: str = "seq") -> DataFrame:
    """Numbers rows 1, 2, 3 ... without bringing them into one task.

    The rows are range-partitioned and sorted, then *written*, because a second evaluation might draw other range
    bounds. A number is the row's place in its partition plus the sizes of the partitions before it; only those
    sizes, one per partition, pass through the driver. Rows with equal keys follow their place in the input, which
    also lets the range partitioner split a key that holds a large share of all rows. Without ``order_by`` rows are
    numbered in scan order and nothing is shuffled.
    """
    spark = df.sparkSession
    if order_by is not None:
        df = df.withColumn("_at", F.monotonically_increasing_id())
        df = df.repartitionByRange(F.col(order_by), F.col("_at")).sortWithinPartitions(order_by, "_at").drop("_at")
    path = work_path(spark, "numbered")
    df.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part = F.shiftright("_place", ROW_BITS).cast("int")
    sizes = placed.groupBy(part.alias("_part")).count().collect()
    sizes.sort(key=lambda r: r["_part"])
    before = accumulate((r["count"] for r in sizes[:-1]), initial=0)
    rows = [(r["_part"], start) for r, start in zip(sizes, before)]
    offsets = local_table(spark, rows, "_part int, _before long")
    within = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # As many rows as there were partitions, so the broadcast is bounded by the scheduler's own limits.
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(column, F.col("_before") + within + 1).drop("_part", "_place", "_before")


def dense_ids(df: DataFrame, order_by: str | None = None, prefix: str = "wiki_") -> DataFrame:
    """Adds ``id`` = prefix and running number from 1."""
    numbered = number_rows(df, order_by, "_seq")
    return numbered.withColumn("id", F.concat(F.lit(prefix), F.col("_seq").cast("string"))).drop("_seq")


def take_first(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by a unique key, exact and without sorting the rows themselves.

    Only the key column is sorted; the n-th key then becomes a plain filter that reaches the scan.
    """
    last = number_rows(df.select(key), key, "_seq").where(F.col("_seq") == n).select(key).collect()
    return df.where(F.col(key) <= F.lit(last[0][0])) if last else df


def cap_pages(pages: DataFrame, max_docs: int, key: str = "page_no", compat: bool = False) -> DataFrame:
    """At most ``max_docs`` pages by key, counted before the length filter; 0 means all.

    ``compat=True`` stops before the last of them, as the original counter does.
    """
    if max_docs <= 0:
        return pages
    n = max_docs - 1 if compat else max_docs
    return take_first(pages, key, n) if n > 0 else pages.where(F.lit(False))


def stamp(docs: DataFrame, at: Column | None = None) -> DataFrame:
    return docs.withColumn("indexed_at", F.current_timestamp() if at is None else at)


def with_shard(docs: DataFrame, n_shards: int) -> DataFrame:
    return docs.withColumn("shard", shard_of(F.col("id"), n_shards))


def ingest_pages(
    pages: DataFrame,
    n_shards: int = 8,
    max_docs: int = 0,
    key: str = "page_no",
    max_len: int | None = None,
    at: Column | None = None,
) -> DataFrame:
    """``pages(page_no, title, text)`` to ``docs(id, title, body, indexed_at, shard)``.

    Pages are numbered as they are scanned, which is the order of ``page_no``; nothing is shuffled.
    """
    docs = dense_ids(clean_pages(cap_pages(pages, max_docs, key), max_len)).drop(key)
    return with_shard(stamp(docs, at), n_shards)


COUNTERS = {
    "indexed": lambda: F.count_if(~F.col("is_bad") & (F.col("id") != "")),
    "skipped": lambda: F.count_if("is_bad"),
    "embeds_ok": lambda: F.count_if(~F.col("is_bad") & has_vector(F.col("title_vector"))),
    "embeds_failed": lambda: F.count_if(~F.col("is_bad") & ~has_vector(F.col("title_vector"))),
}


def ingest_counters(records: DataFrame) -> DataFrame:
    """One row of counters over records that carry ``is_bad``."""
    return records.agg(*[make().alias(name) for name, make in COUNTERS.items()])


def observe_counters(records: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The same counters taken in passing, while another action reads the records."""
    seen = Observation(name)
    return records.observe(seen, *[make().alias(k) for k, make in COUNTERS.items()]), seen


def build_counters(outcome: Column) -> list[Column]:
    """Counters of a build, by what became of each document's text at the encoder."""
    failed = outcome.isNotNull() & (outcome != "ok")
    return [
        F.count("*").alias("indexed"),
        F.count_if(outcome == "ok").alias("embeds_ok"),
        F.count_if(failed).alias("embeds_failed"),
        F.count_if(outcome == "not tried").alias("embeds_not_tried"),
    ]


def shard_distribution(docs: DataFrame, n_shards: int) -> DataFrame:
    """Documents per shard, with 0 for empty ones."""
    counts = docs.groupBy("shard").agg(F.count("*").alias("n_docs"))
    every = docs.sparkSession.range(max(n_shards, 1)).select(F.col("id").cast("int").alias("shard"))
    return every.join(counts, "shard", "left").select("shard", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def shard_catalogue(docs: DataFrame) -> DataFrame:
    """The shards that hold documents, in one list, and how many they are."""
    return docs.select("shard").distinct().agg(
        F.array_sort(F.collect_list("shard")).alias("shards"), F.count("*").alias("count")
    )
