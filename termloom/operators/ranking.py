"""Top-N per shard, global top-K, and late fetch of stored fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import shard_of, slot_of
from ..sources.index_store import SearchIndex, union
from .queries import small

KEYWORD_DEPTH = 3  # candidates per shard, as a multiple of the limit
RRF_DEPTH = 100  # candidates per shard for rank fusion


def rank_within(hits: DataFrame, by: list[str], score: str, name: str, cap: int) -> DataFrame:
    """Rank by score, then id, up to ``cap``. The literal cap lets Spark drop rows before the shuffle."""
    order = W.partitionBy(*by).orderBy(F.desc(score), "id")
    return hits.withColumn(name, F.row_number().over(order)).where(F.col(name) <= F.lit(cap))


def shard_topn(hits: DataFrame, depth: DataFrame, depth_cap: int, n_queries: int) -> DataFrame:
    """The best ``depth`` hits of each query on each shard; ``depth`` is a table ``query_id, depth``."""
    ranked = rank_within(hits, ["query_id", "shard"], "score", "shard_rank", depth_cap)
    limits = small(depth.select("query_id", "depth"), n_queries)
    return ranked.join(limits, "query_id").where(F.col("shard_rank") <= F.col("depth")).drop("depth")


def global_topk(candidates: DataFrame, queries: DataFrame, cap: int, n_queries: int, score: str = "score") -> DataFrame:
    """The best ``limit`` candidates of each query, with ``rank``."""
    ranked = rank_within(candidates, ["query_id"], score, "rank", cap)
    limits = small(queries.select("query_id", "limit"), n_queries)
    return ranked.join(limits, "query_id").where(F.col("rank") <= F.col("limit")).drop("limit")


def fetch_fields(index: SearchIndex, winners: DataFrame, n_winners: int, *columns: Column | str) -> DataFrame:
    """Stored fields for rows with an ``id``, and ``seg`` where it is known; ``n_winners`` is a proven bound on their number.

    One join, whose small side prunes directories. Hits carry the segment of their document, so that replaced documents
    needn't be looked for again.
    """
    layout = index.layout
    place = ["shard", "slot", "id"]
    placed = winners.withColumn("shard", shard_of(F.col("id"), layout.n_shards)).withColumn(
        "slot", slot_of(F.col("id"), layout.doc_slots)
    )
    placed = placed.where(F.length("id") > 0)  # always true; allows partition pruning on the other side
    if "seg" in winners.columns:
        stored, place = union(index.parts("docs")), [*place, "seg"]
    else:
        stored = index.docs()
    return stored.select(*place, *columns).join(small(placed, n_winners), place).drop("slot", "seg")
