"""The calls a user of a search service knows, on one index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.embedding import Encoder
from ..operators.ingest import shard_catalogue
from ..operators.routing import hot_listing
from ..sources.index_store import SearchIndex
from ..sources.tables import local_table
from .hybrid import HybridSearch
from .search import KeywordSearch


@dataclass(frozen=True)
class SearchEngine:
    """``search`` and ``hybrid`` answer whole query tables; the ``_one`` forms ask a single query."""

    index: SearchIndex
    kv: DataFrame | None = None
    encoder: Encoder | None = None

    def search(self, queries: DataFrame, **options) -> KeywordSearch:
        return KeywordSearch(self.index, queries, self.kv, **options)

    def search_one(self, q: str, limit: int | None = None, **options) -> DataFrame:
        asked = local_table(self.index.spark, [(1, q, limit)], "query_id long, q string, limit int")
        return self.search(asked, **options).responses().drop("query_id")

    def hybrid(self, queries: DataFrame, **options) -> HybridSearch:
        return HybridSearch(self.index, queries, self.kv, self.encoder, **options)

    def hybrid_one(
        self, q: str, limit: int | None = None, alpha: float | None = None, fusion: str | None = None, **options
    ) -> DataFrame:
        schema = "query_id long, q string, limit int, alpha double, fusion string"
        asked = local_table(self.index.spark, [(1, q, limit, alpha, fusion)], schema)
        return self.hybrid(asked, **options).responses().drop("query_id")

    def shards(self) -> DataFrame:
        return shard_catalogue(self.index.docs())

    def hot_terms(self) -> DataFrame | None:
        return None if self.kv is None else hot_listing(self.kv)
