"""Highlighted fragments for winning documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyzed, fragment
from ..sources.index_store import SearchIndex
from .ranking import fetch_fields


def with_fragments(
    index: SearchIndex, winners: DataFrame, queries: DataFrame, n_winners: int, fields: tuple[str, ...] = ("title", "body")
) -> DataFrame:
    """Adds ``title`` and ``fragments: map<field, array<fragment>>`` with the fields in which a term occurs.

    Runs on the winners only: their texts are the only ones fetched.
    """
    terms = queries.select("query_id", F.array_distinct(analyzed(F.col("q"))["term"]).alias("_terms"))
    stored = sorted({*fields, "title"})
    found = fetch_fields(index, winners, n_winners, *stored).join(terms, "query_id")
    entries = F.array(
        *[F.struct(F.lit(f).alias("k"), fragment(F.col(f), F.col("_terms")).alias("v")) for f in fields]
    )
    present = F.filter(entries, lambda e: e["v"].isNotNull())
    as_map = F.map_from_entries(F.transform(present, lambda e: F.struct(e["k"], F.array(e["v"]))))
    return found.select(*winners.columns, F.coalesce("title", F.lit("")).alias("title"), as_map.alias("fragments"))
