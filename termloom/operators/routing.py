"""Hot-term routing: which shards a query is sent to, and the statistics kept about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import int_list, path_parts
from ..sources.kv import HOT_TERMS, scan_prefix
from .queries import small

HOT, COLD = "hot", "cold"


def hot_shards(queries: DataFrame, kv: DataFrame, n_entries: int | None = None) -> DataFrame:
    """Adds ``hot_shards``: the shard list kept for exactly this query text, or NULL.

    Duplicate keys would repeat queries, so the last value by text wins. ``n_entries`` is a proven size of ``kv``.
    """
    lists = (
        scan_prefix(kv, HOT_TERMS)
        .where(F.col("key").endswith("/shards"))
        .groupBy(F.col("key").alias("_key"))
        .agg(int_list(F.max("value")).alias("hot_shards"))
    )
    side = lists if n_entries is None else small(lists, n_entries)
    keyed = queries.withColumn("_key", F.concat(F.lit(HOT_TERMS), F.col("q"), F.lit("/shards")))
    return keyed.join(side, "_key", "left").drop("_key")


def route(queries: DataFrame, kv: DataFrame, n_shards: int, n_entries: int | None = None) -> DataFrame:
    """Adds ``routing_type`` and ``route``, the shards to ask.

    A query with a non-empty list is hot and goes to the listed shards that exist, possibly none; any other query
    goes to all shards.
    """
    found = hot_shards(queries, kv, n_entries)
    is_hot = F.coalesce(F.size("hot_shards") > 0, F.lit(False))
    valid = F.filter(F.array_distinct("hot_shards"), lambda s: (s >= 0) & (s < n_shards))
    everywhere = F.sequence(F.lit(0), F.lit(n_shards - 1))
    return found.select(
        *queries.columns,
        F.when(is_hot, F.lit(HOT)).otherwise(F.lit(COLD)).alias("routing_type"),
        F.when(is_hot, valid).otherwise(everywhere).alias("route"),
    )


def route_all(queries: DataFrame, n_shards: int) -> DataFrame:
    """The routing of an empty table: everything is cold."""
    return queries.withColumn("routing_type", F.lit(COLD)).withColumn(
        "route", F.sequence(F.lit(0), F.lit(n_shards - 1))
    )


def last_hot_stats(log: DataFrame) -> DataFrame:
    """The last write per hot term from ``log(query_id, ts, q, routing_type, hits, shards)``."""
    latest = F.max_by(F.struct("hits", "shards", F.unix_timestamp("ts").alias("ts")), F.struct("ts", "query_id"))
    hot = log.where(F.col("routing_type") == HOT).groupBy(F.col("q").alias("term")).agg(latest.alias("s"))
    return hot.select("term", "s.hits", "s.shards", "s.ts")


def answered_hot_stats(responses: DataFrame, routed: DataFrame, asked: DataFrame) -> DataFrame:
    """The last write per hot term after a search: ``responses`` give the hits, ``routed`` the shards that were asked, and
    ``asked (query_id, ts)`` the time."""
    shards = routed.select("query_id", F.size("route").cast("long").alias("shards"))
    log = responses.select("query_id", F.col("query").alias("q"), "routing_type", F.col("total_hits").alias("hits"))
    return last_hot_stats(log.join(shards, "query_id").join(asked.select("query_id", "ts"), "query_id"))


def stats_entries(stats: DataFrame) -> DataFrame:
    """Statistics as routing entries."""
    value = F.format_string("hits:%d shards:%d ts:%d", "hits", "shards", "ts")
    return stats.select(F.concat(F.lit(HOT_TERMS), F.col("term"), F.lit("/stats")).alias("key"), value.alias("value"))


def put_entries(kv: DataFrame, entries: DataFrame) -> DataFrame:
    """``kv`` with the entries written over it."""
    return kv.join(entries, "key", "left_anti").unionByName(entries)


def hot_listing(kv: DataFrame) -> DataFrame:
    """``term, entries`` for keys of the form ``term/field``. One row per term; a term has few fields."""
    parts = path_parts(F.col("key"), HOT_TERMS)
    rows = scan_prefix(kv, HOT_TERMS).select(parts.alias("p"), "value").where(F.size("p") == 2)
    fields = rows.groupBy(F.get("p", F.lit(0)).alias("term"), F.get("p", F.lit(1)).alias("field")).agg(F.max("value").alias("value"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))
    return fields.groupBy("term").agg(entries.alias("entries"))


def hot_term_count(kv: DataFrame) -> DataFrame:
    """``n_terms``, the number of terms that ``hot_listing`` has: one row."""
    return hot_listing(kv).agg(F.count("term").alias("n_terms"))
