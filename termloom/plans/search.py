"""Keyword search: a table of queries in, ranked hits and response summaries out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.queries import Bounds, collapse_repeats, keyword_defaults, query_terms, small
from ..operators.ranking import KEYWORD_DEPTH, fetch_fields, global_topk, rank_within, shard_topn
from ..operators.routing import answered_hot_stats, route, route_all
from ..operators.scoring import BestHits, score_hits
from ..sources.index_store import SearchIndex


@dataclass(frozen=True)
class KeywordSearch:
    """One batch of keyword queries against one index; every step is a DataFrame.

    ``queries`` has ``query_id, q`` and optionally ``limit``; ``kv`` holds the routing entries. With ``prune`` the best hits
    are found without scoring all (see ``BestHits``): the same answers by more but smaller steps, which pays where frequent
    words have many millions of postings. With ``collapse`` equal ``(q, limit)`` are searched once, and ``results`` and
    ``responses`` go to everyone who asked; other steps are those of one asker each.
    """

    index: SearchIndex
    queries: DataFrame
    kv: DataFrame | None = None
    model: str = "bm25"
    scope: str = "shard"
    field: str = "_all"
    prune: bool = False
    collapse: bool = False

    @cached_property
    def _collapsed(self) -> tuple[DataFrame, DataFrame]:
        return collapse_repeats(keyword_defaults(self.queries))

    @cached_property
    def clean_queries(self) -> DataFrame:
        return self._collapsed[0].select("query_id", "q", "limit") if self.collapse else keyword_defaults(self.queries)

    def _to_askers(self, answers: DataFrame, n_rows: int) -> DataFrame:
        """Answers, at most ``n_rows``, once for everyone who asked. Any number may have asked the same: a bounded side is
        broadcast, so that they stay where they are."""
        if not self.collapse:
            return answers
        answers_side = small(answers.withColumnRenamed("query_id", "answer_id"), n_rows)
        return self._collapsed[1].join(answers_side, "answer_id").select(*answers.columns)

    @cached_property
    def bounds(self) -> Bounds:
        """The only eager step: three numbers about the query table."""
        return Bounds.of(self.clean_queries)

    @cached_property
    def routed(self) -> DataFrame:
        n_shards = self.index.layout.shard_count
        if self.kv is None:
            return route_all(self.clean_queries, n_shards)
        return route(self.clean_queries, self.kv, n_shards)

    def hits(self) -> DataFrame:
        """Every matching document of the shards asked: ``query_id, shard, id, score``."""
        carry = () if self.kv is None else ("route",)
        terms = query_terms(self.routed, "q", *carry)
        return score_hits(self.index, terms, self.bounds.n_words, self.field, self.model, self.scope)

    def best(self, times: int, *by: str) -> BestHits:
        """At least the best hits ``by`` query, or query and shard: ``times`` the limit each."""
        b = self.bounds
        terms = query_terms(self.routed, "q", *(() if self.kv is None else ("route",)))
        depth = self.clean_queries.select("query_id", (F.col("limit") * times).alias("depth"))
        return BestHits(
            self.index, terms, b.n_words, depth, times * b.max_limit, b.n_queries, by, self.field, self.model, self.scope
        )

    def candidates(self) -> DataFrame:
        """The union of all shards' best hits, three times the limit each."""
        best = self.best(KEYWORD_DEPTH, "query_id", "shard")
        return shard_topn(best.hits() if self.prune else self.hits(), best.depth, best.cap, best.n_queries)

    def top(self) -> DataFrame:
        """The global best ``limit``, straight from the hits: a depth of three limits per shard cannot change it."""
        best = self.best(1, "query_id")
        return global_topk(best.hits() if self.prune else self.hits(), self.clean_queries, best.cap, best.n_queries)

    def results(self) -> DataFrame:
        """Hits as answered: ``query_id, rank, id, score, title, shard``."""
        n_winners = self.bounds.n_queries * self.bounds.max_limit
        found = fetch_fields(self.index, self.top(), n_winners, "title")
        rows = found.select("query_id", "rank", "id", "score", F.coalesce("title", F.lit("")).alias("title"), "shard")
        return self._to_askers(rows, n_winners)

    def responses(self) -> DataFrame:
        """One row per query, or per asker: ``query_id, query, shards, total_hits, routing_type, hits``.

        ``total_hits`` counts the candidates the shards returned; ``shards`` is the number of all shards, even for
        a query that was routed to few.
        """
        b = self.bounds
        of_query = W.partitionBy("query_id")
        counted = self.candidates().drop("shard_rank").withColumn("total_hits", F.count("*").over(of_query))
        top = rank_within(counted, ["query_id"], "score", "rank", b.max_limit)
        limits = small(self.clean_queries.select("query_id", "limit"), b.n_queries)
        top = top.join(limits, "query_id").where(F.col("rank") <= F.col("limit"))
        found = fetch_fields(self.index, top, b.n_queries * b.max_limit, "title")
        hit = F.struct("rank", "id", "score", F.coalesce("title", F.lit("")).alias("title"), "shard")
        # A group here is one query's answer, at most `limit` rows.
        answered = found.groupBy("query_id").agg(
            F.first("total_hits").alias("total_hits"), F.array_sort(F.collect_list(hit)).alias("hits")
        )
        asked = self.routed.select("query_id", F.col("q").alias("query"), "routing_type")
        rows = asked.join(answered, "query_id", "left").select(
            "query_id",
            "query",
            F.lit(self.index.layout.shard_count).alias("shards"),
            F.coalesce("total_hits", F.lit(0)).alias("total_hits"),
            "routing_type",
            F.coalesce(F.col("hits"), F.array().cast(answered.schema["hits"].dataType)).alias("hits"),
        )
        return self._to_askers(rows, b.n_queries * b.max_limit)

    def hot_stats(self, asked: DataFrame) -> DataFrame:
        """What the search has to write back about hot terms: ``term, hits, shards, ts``, the last of ``asked (query_id, ts)``."""
        routed = self._to_askers(self.routed, self.bounds.n_queries) if self.collapse else self.routed
        return answered_hot_stats(self.responses(), routed, asked)

    def match_counts(self) -> DataFrame:
        """The true number of matching documents per query, whatever the limits."""
        return self.hits().groupBy("query_id").agg(F.count("*").alias("match_count"))
