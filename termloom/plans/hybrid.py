"""Hybrid search: keyword candidates, scored again by cosine, fused by ranks or by weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import cosine, has_vector, norm
from ..operators.embedding import Encoder, embed_queries
from ..operators.queries import Bounds, hybrid_defaults, query_terms, small
from ..operators.ranking import KEYWORD_DEPTH, RRF_DEPTH, fetch_fields, rank_within, shard_topn
from ..operators.routing import route, route_all
from ..operators.scoring import SCORE_DIGITS, BestHits, score_hits
from ..sources.index_store import SearchIndex

RRF = "rrf"
RRF_K = 60


@dataclass(frozen=True)
class HybridSearch:
    """One batch of hybrid queries: ``query_id, q`` and optionally ``limit, alpha, fusion, query_vector``.

    With an ``encoder`` the query vectors are computed from ``q``; without one the column is used as given. A query
    without vector falls back to its keyword scores.
    """

    index: SearchIndex
    queries: DataFrame
    kv: DataFrame | None = None
    encoder: Encoder | None = None
    model: str = "bm25"
    scope: str = "shard"
    prune: bool = False

    @cached_property
    def clean_queries(self) -> DataFrame:
        asked = self.queries
        if self.encoder is not None:
            asked = embed_queries(asked.where(F.col("q") != ""), self.encoder)
        return hybrid_defaults(asked)

    @cached_property
    def bounds(self) -> Bounds:
        # The vectors are not needed for counting, so no encoder runs here.
        return Bounds.of(hybrid_defaults(self.queries))

    @cached_property
    def routed(self) -> DataFrame:
        n_shards = self.index.layout.shard_count
        plain = hybrid_defaults(self.queries).select("query_id", "q", "limit", "fusion")
        return route_all(plain, n_shards) if self.kv is None else route(plain, self.kv, n_shards)

    def candidates(self) -> DataFrame:
        """Per shard the best 100 for rank fusion, three times the limit for anything else."""
        b, routed = self.bounds, self.routed
        terms = query_terms(routed, "q", *(() if self.kv is None else ("route",)))
        wanted = F.when(F.col("fusion") == RRF, F.lit(RRF_DEPTH)).otherwise(F.col("limit") * KEYWORD_DEPTH)
        depth = routed.select("query_id", wanted.alias("depth"))
        if self.prune:
            by = ("query_id", "shard")
            best = BestHits(
                self.index, terms, b.n_words, depth, self.depth_cap, b.n_queries, by, "_all", self.model, self.scope
            )
            hits = best.hits()
        else:
            hits = score_hits(self.index, terms, b.n_words, "_all", self.model, self.scope)
        return shard_topn(hits, depth, self.depth_cap, b.n_queries).drop("shard_rank")

    @property
    def depth_cap(self) -> int:
        return max(RRF_DEPTH, KEYWORD_DEPTH * self.bounds.max_limit)

    def scored(self) -> DataFrame:
        """Candidates with ``has_vec`` and ``semantic``, the cosine to the query vector, 0 when either is missing."""
        b = self.bounds
        n_candidates = b.n_queries * self.index.layout.shard_count * self.depth_cap
        found = fetch_fields(self.index, self.candidates(), n_candidates, "title", "title_vector", "title_norm")
        asked = self.clean_queries.withColumn("query_norm", norm(F.col("query_vector")))
        rows = found.join(small(asked.drop("q"), b.n_queries), "query_id")
        both = F.col("query_vector").isNotNull() & has_vector(F.col("title_vector"))
        similarity = cosine(F.col("query_vector"), F.col("title_vector"), F.col("query_norm"), F.col("title_norm"))
        return rows.select(
            "query_id",
            "limit",
            "alpha",
            "fusion",
            F.col("query_vector").isNotNull().alias("has_query"),
            "id",
            F.coalesce("title", F.lit("")).alias("title"),
            "shard",
            F.col("score").alias("keyword_score"),
            both.alias("has_vec"),
            F.when(both, F.round(similarity, SCORE_DIGITS)).otherwise(F.lit(0.0)).alias("semantic_score"),
        )

    def fused(self) -> DataFrame:
        """Every candidate with both ranks and ``hybrid_score``. The method is chosen per row, so tables may mix."""
        of_query = W.partitionBy("query_id")
        keyword_rank = F.row_number().over(of_query.orderBy(F.desc("keyword_score"), "id"))
        semantic_rank = F.row_number().over(of_query.orderBy(F.desc("semantic_score"), "id"))
        ranked = self.scored().select("*", keyword_rank.alias("keyword_rank"), semantic_rank.alias("semantic_rank"))
        by_rank = (F.col("fusion") == RRF) & F.col("has_query")
        return fuse(ranked, by_rank)

    def ranked(self) -> DataFrame:
        counted = self.fused().withColumn("keyword_hits", F.count("*").over(W.partitionBy("query_id")))
        top = rank_within(counted, ["query_id"], "hybrid_score", "rank", self.bounds.max_limit)
        return top.where(F.col("rank") <= F.col("limit"))

    def results(self) -> DataFrame:
        """Hits as answered, in the columns of a hybrid result."""
        return self.ranked().select("query_id", "rank", *HIT)

    def responses(self) -> DataFrame:
        """One row per query: candidates, final hits, and the parameter of the fusion that was *asked for*."""
        # A group here is one query's answer, at most `limit` rows.
        answered = self.ranked().groupBy("query_id").agg(
            F.first("keyword_hits").alias("keyword_hits"),
            F.array_sort(F.collect_list(F.struct("rank", *HIT))).alias("hits"),
        )
        empty = F.array().cast(answered.schema["hits"].dataType)
        asked = self.clean_queries.join(self.routed.select("query_id", "routing_type"), "query_id")
        by_rank = F.col("fusion") == RRF
        return asked.join(answered, "query_id", "left").select(
            "query_id",
            F.col("q").alias("query"),
            "query_vector",
            F.coalesce("keyword_hits", F.lit(0)).alias("keyword_hits"),
            F.coalesce(F.size("hits"), F.lit(0)).alias("semantic_topk"),
            F.when(~by_rank, F.col("alpha")).alias("fusion_alpha"),
            F.col("fusion").alias("fusion_method"),
            F.when(by_rank, F.lit(RRF_K)).alias("fusion_k"),
            "routing_type",
            F.coalesce("hits", empty).alias("hits"),
        )


HIT = ("id", "title", "keyword_score", "semantic_score", "hybrid_score", "shard", "fusion_method")


def fuse(ranked: DataFrame, by_rank) -> DataFrame:
    """Rank fusion where ``by_rank`` holds, else the weighted sum of raw scores, keyword only without vector."""
    reciprocal = 1.0 / (RRF_K + F.col("keyword_rank")) + 1.0 / (RRF_K + F.col("semantic_rank"))
    alpha = F.col("alpha")
    weighted = F.when(
        F.col("has_vec"), alpha * F.col("keyword_score") + (1 - alpha) * F.col("semantic_score")
    ).otherwise(F.col("keyword_score"))
    # Weighted sums of rounded scores often end in an exact half, so these few rows are rounded in decimal, half up.
    score = F.round(F.when(by_rank, reciprocal).otherwise(weighted), SCORE_DIGITS)
    return ranked.withColumn("hybrid_score", score).withColumn(
        "fusion_method", F.when(by_rank, F.lit("RRF")).otherwise(F.lit("weighted"))
    )
