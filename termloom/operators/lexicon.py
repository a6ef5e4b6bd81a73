"""Finding terms of the vocabulary by pattern or by likeness, on keys that are equal.

Patterns use k-grams: a term that matches holds every gram of the pattern's fixed parts. Fuzzy words use deletions: two words
within n edits have a string in common among those that up to n deletions leave of their first characters. Both kinds of keys
are tables beside a base segment if its layout says so (``lexicon``); of deltas, and of other bases, they are made on the way.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bucket_of
from ..sources.index_store import SearchIndex, union, write_segment
from .queries import small

GRAM = 3
START, END = "\u0002", "\u0003"  # stand before and after a term, so that its ends make grams as well
GAP = "\u0001"
#: Characters of a word that deletions are made of, and most deletions that are stored.
PREFIX = 7
STORED_EDITS = 2


def grams_of(text: Column) -> Column:
    """All distinct grams of a string, none if it is too short."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def framed(term: Column) -> Column:
    return F.concat(F.lit(START), term, F.lit(END))


def deletions(text: Column, n: int) -> Column:
    """All strings that up to ``n`` deletions leave of the first characters of a word."""
    found = F.array(F.substring(text, 1, PREFIX))
    last = found
    for _ in range(n):
        cut = lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(PREFIX))),
        )
        last = F.array_distinct(F.flatten(F.transform(last, cut)))
        found = F.array_union(found, last)
    return found


def fixed_parts(kind: Column, value: Column) -> Column:
    """What every matching term has to hold, parts of it between gaps, with the marks of its ends.

    Of a regular expression only plain characters outside classes count, and none whose quantifier allows for their
    absence; one with groups, alternatives, escapes, anchors or nested classes has no fixed part.
    """
    lower = F.lower(value)
    wild = F.regexp_replace(lower, r"[*?]", GAP)
    prefix = F.concat(F.regexp_replace(lower, r"\*$", ""), F.lit(GAP))
    plain = F.regexp_replace(value, r"\[[^\]]*\]", GAP)
    plain = F.regexp_replace(plain, r".(?:[*?]|\{[^}]*\})[+?]?", GAP)
    plain = F.regexp_replace(plain, r"\+[+?]?|\.", GAP)
    unclear = value.rlike(r"[|()\\^$&]|\[[^\]]*\[|\[\]")
    regexp = F.when(unclear, F.lit(GAP)).otherwise(plain)
    return framed(F.when(kind == "prefix", prefix).when(kind == "wildcard", wild).otherwise(regexp))


def pattern_grams(kind: Column, value: Column) -> Column:
    parts = F.split(fixed_parts(kind, value), GAP)
    return F.array_distinct(F.flatten(F.transform(parts, grams_of)))


# --- tables ------------------------------------------------------------------------------------------------------------

KEYS = {"grams": lambda term: grams_of(framed(term)), "deletions": lambda term: deletions(term, STORED_EDITS)}


def key_rows(terms: DataFrame, table: str, buckets: int) -> DataFrame:
    """``key, term, bucket``: one row per key of each term."""
    rows = terms.select(F.explode(KEYS[table](F.col("term"))).alias("key"), "term")
    return rows.withColumn("bucket", bucket_of(F.col("key"), buckets))


def write_lexicon(index: SearchIndex) -> None:
    """Keys of the base's vocabulary, each term once."""
    terms = index.segment("term_stats", index.base).select("term").distinct()
    for table in KEYS:
        rows = key_rows(terms, table, index.layout.term_buckets)
        write_segment(rows, index.table_path(table, index.base), table, ("key",), base=True)


def keyed_terms(index: SearchIndex, table: str) -> list[DataFrame]:
    """``key, term, bucket`` of base and deltas; a term may come more than once."""
    stats = index.parts("term_stats")
    made = [key_rows(df.select("term"), table, index.layout.term_buckets) for df in stats]
    return [index.segment(table, index.base), *made[1:]] if index.layout.lexicon else made


def terms_by_pattern(index: SearchIndex, clauses: DataFrame, n_grams: int) -> DataFrame:
    """Rows of ``clauses (kind, value, ...)`` with every ``term`` that holds all their grams. The pattern itself remains to
    be checked; clauses without a gram have no row here."""
    asked = clauses.withColumn("_grams", pattern_grams(F.col("kind"), F.col("value")))
    asked = asked.withColumn("_key", F.explode("_grams")).withColumn("_n", F.size("_grams")).drop("_grams")
    buckets = index.layout.term_buckets
    side = small(asked.withColumn("bucket", bucket_of(F.col("_key"), buckets)).where(F.length("_key") > 0), n_grams)
    names = [c for c in asked.columns if c not in ("_key", "_n")]
    met = [
        df.select("bucket", F.col("key").alias("_key"), "term").join(side, ["bucket", "_key"])
        for df in keyed_terms(index, "grams")
    ]
    found = union(met).groupBy(*names, "_n", "term").agg(F.count_distinct("_key").alias("_met"))
    return found.where(F.col("_met") == F.col("_n")).select(*names, "term")


def terms_within(index: SearchIndex, clauses: DataFrame, n_clauses: int, max_distance: int) -> DataFrame:
    """Rows of ``clauses (_word, _n, ...)`` with every ``term`` within ``_n`` edits of the word."""
    buckets = index.layout.term_buckets
    near = F.levenshtein("term", "_word", max_distance)
    if max_distance > STORED_EDITS:
        terms = union([df.select("term") for df in index.parts("term_stats")]).distinct()
        keys = F.explode(deletions(F.col("term"), max_distance)).alias("key")
        tables = [terms.select(keys, "term").withColumn("bucket", bucket_of(F.col("key"), buckets))]
    else:
        tables = keyed_terms(index, "deletions")
    asked = clauses.withColumn("_key", F.explode(deletions(F.col("_word"), max_distance)))
    n_keys = n_clauses * sum(comb(PREFIX, k) for k in range(max_distance + 1))
    side = small(asked.withColumn("bucket", bucket_of(F.col("_key"), buckets)), n_keys)
    met = [df.select("bucket", F.col("key").alias("_key"), "term").join(side, ["bucket", "_key"]) for df in tables]
    pairs = union([m.where((near >= 0) & (near <= F.col("_n"))) for m in met])
    return pairs.drop("bucket", "_key").distinct()

