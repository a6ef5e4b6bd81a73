"""Query tables: defaults, rejects, repeated queries, and the bounds plans are chosen by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyzed, string_or_empty

KEYWORD_LIMIT = 20
HYBRID_LIMIT = 10
DEFAULT_ALPHA = 0.7
DEFAULT_FUSION = "rrf"

BROADCAST_ROWS = 1_000_000
"""Sides with a proven bound up to this many narrow rows (about 100 MB) are broadcast; others are shuffled."""


def positive_int(value: Column, default: int) -> Column:
    """A positive integer, or the default for anything else."""
    number = F.when(value.cast("string").rlike(r"^[+-]?[0-9]+$"), value.cast("string").try_cast("int"))
    return F.when(number > 0, number).otherwise(F.lit(default))


def number_or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def _optional(queries: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in queries.columns else F.lit(None).cast(kind)


def rejected(queries: DataFrame) -> DataFrame:
    """Queries without text."""
    return queries.where(string_or_empty(F.col("q")) == "").withColumn("error", F.lit("missing 'q' parameter"))


def keyword_defaults(queries: DataFrame, default_limit: int = KEYWORD_LIMIT) -> DataFrame:
    """``query_id, q, limit`` with the limit made positive; queries without text are left out."""
    limit = positive_int(_optional(queries, "limit", "int"), default_limit)
    return queries.where(string_or_empty(F.col("q")) != "").select("query_id", "q", limit.alias("limit"))


def hybrid_defaults(queries: DataFrame) -> DataFrame:
    """``query_id, q, limit, alpha, fusion, query_vector``; an alpha of 0 or none is the default alpha."""
    alpha = number_or_zero(_optional(queries, "alpha", "double"))
    fusion = string_or_empty(_optional(queries, "fusion", "string"))
    vector = _optional(queries, "query_vector", "array<double>").cast("array<double>")
    return queries.where(string_or_empty(F.col("q")) != "").select(
        "query_id",
        "q",
        positive_int(_optional(queries, "limit", "int"), HYBRID_LIMIT).alias("limit"),
        F.when(alpha == 0, F.lit(DEFAULT_ALPHA)).otherwise(alpha).alias("alpha"),
        F.when(fusion == "", F.lit(DEFAULT_FUSION)).otherwise(fusion).alias("fusion"),
        F.when(F.size(vector) > 0, vector).alias("query_vector"),
    )


def collapse_repeats(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(q, limit)`` with one ``query_id`` each, and who asked for which of them. A null limit is a value."""
    distinct = queries.groupBy("q", "limit").agg(F.min("query_id").alias("query_id"))
    keys = distinct.select(F.col("q").alias("_q"), F.col("limit").alias("_limit"), F.col("query_id").alias("answer_id"))
    same = F.col("q").eqNullSafe(F.col("_q")) & F.col("limit").eqNullSafe(F.col("_limit"))
    return distinct, queries.join(keys, same).select("query_id", "answer_id")


def query_terms(queries: DataFrame, text: str = "q", *carry: str) -> DataFrame:
    """``query_id, term, weight``: analysed terms, a repeated one weighing more."""
    terms = F.transform(analyzed(F.col(text)), lambda t: t["term"])
    weighted = F.transform(
        F.array_distinct("_terms"),
        lambda t: F.struct(t.alias("term"), F.size(F.filter("_terms", lambda u: u == t)).cast("double").alias("weight")),
    )
    rows = queries.select("query_id", *carry, terms.alias("_terms"))
    return rows.select("query_id", *carry, F.explode(weighted).alias("t")).select(
        "query_id", *carry, "t.term", "t.weight"
    )


@dataclass(frozen=True)
class Bounds:
    """What one pass over a query table proves about the size of everything derived from it."""

    n_queries: int
    n_words: int
    max_limit: int

    @classmethod
    def of(cls, queries: DataFrame, text: str = "q") -> "Bounds":
        # A term is at least one character, and two terms are at least one character apart.
        row = queries.agg(
            F.count("*"),
            F.coalesce(F.sum((F.length(text) + 1).cast("long")), F.lit(0)),
            F.coalesce(F.max("limit"), F.lit(1)),
        ).collect()[0]
        return cls(row[0], row[1] // 2 + row[0], row[2])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a side for broadcast if its proven row bound allows it; otherwise Spark picks the join at run time."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
