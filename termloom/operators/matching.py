"""Boolean queries over a clause table.

``clauses(query_id, clause_no, occur, kind, field, value, boost)``: ``occur`` is must, should or must_not; ``kind`` is
match, phrase, prefix, wildcard, regexp, fuzzy or range; ``field`` is a text field, ``_all``, or for a range
``indexed_at`` or one of the layout's ``numbers``. A fuzzy value may end in ``~n``; a range value starts with one of ``>= > <= <``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import slot_of
from ..functions.text import analyzed
from ..session import counted
from ..sources.index_store import FIELD_GAP, SearchIndex, union
from .lexicon import pattern_grams, terms_by_pattern, terms_within
from .queries import small
from .scoring import ALL, matching_postings, round_score, summed_per_document, term_weights

KEY_LENGTH = 32
PATTERN_KINDS = ("prefix", "wildcard", "regexp")
CLAUSE = ("query_id", "clause_no", "occur")


def vocabulary(index: SearchIndex, field: str) -> DataFrame:
    """The terms of a field, once per shard and segment that holds them, some perhaps without live documents.

    Making them distinct, or adding segments up, would shuffle all of them; callers do so after matching.
    """
    df_name = "df_all" if field == ALL else f"df_{field}"
    return union([df.where(F.col(df_name) > 0).select("term") for df in index.parts("term_stats")])


def _literal_prefix(kind: Column, value: Column) -> Column:
    plain_start = F.when(kind == "prefix", F.regexp_replace(value, r"\*$", "")).when(
        kind == "wildcard", F.regexp_extract(value, r"^[^*?]*", 0)
    ).otherwise(F.lit(""))
    return F.substring(F.lower(plain_start), 1, KEY_LENGTH)


def _pattern(kind: Column, value: Column) -> Column:
    """The clause as an anchored regular expression."""
    escaped = F.regexp_replace(F.lower(value), r"([\\.\[\]{}()+^$|])", r"\\$1")
    wild = F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\?", ".")
    start = F.concat(F.lit(r"\Q"), F.regexp_replace(F.lower(value), r"\*$", ""), F.lit(r"\E.*"))
    body = F.when(kind == "prefix", start).when(kind == "wildcard", wild).otherwise(value)
    return F.concat(F.lit("^(?:"), body, F.lit(")$"))


def expand_patterns(index: SearchIndex, clauses: DataFrame, n_clauses: int, n_grams: int) -> DataFrame:
    """Clause rows with every ``term`` of the vocabulary they match; ``n_grams`` bounds the characters of all clauses.

    Terms are found by the grams of a pattern's fixed parts, and checked against the pattern. A pattern without a gram
    meets terms on its literal prefix, and on nothing if it has none: only such a clause looks at every term.
    """
    has_gram = F.size(pattern_grams(F.col("kind"), F.col("value"))) > 0
    keyed = clauses.withColumn("_key", _literal_prefix(F.col("kind"), F.col("value"))).withColumn(
        "_pattern", _pattern(F.col("kind"), F.col("value"))
    )
    short = keyed.where(~has_gram)
    pairs = terms_by_pattern(index, keyed.where(has_gram).drop("_key"), n_grams)
    # At most KEY_LENGTH + 1 different lengths; none if all patterns have grams.
    lengths = sorted(r[0] for r in short.select(F.length("_key")).distinct().collect())
    if lengths:
        starts = F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths])
        terms = vocabulary(index, ALL).select("term", F.explode(F.array_compact(starts)).alias("_key"))
        pairs = pairs.unionByName(terms.join(small(short, n_clauses), "_key").select(*pairs.columns))
    return pairs.where(F.rlike("term", F.col("_pattern"))).drop("_pattern").distinct()


def fuzzy_distance(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(value, r"~([0-9]+)$", 1).try_cast("int"), F.lit(1))


def expand_fuzzy(index: SearchIndex, clauses: DataFrame, n_clauses: int, field: str, max_distance: int) -> DataFrame:
    """Clause rows with every term within the clause's edit distance: ``~n``, 1 by default, none above ``max_distance``.
    Of a single ``field``, terms that are used elsewhere only drop out when they are weighted.

    Words meet terms on strings that deletions leave of both; the distance is checked on those pairs.
    """
    wanted = clauses.withColumn("_word", F.lower(F.regexp_replace("value", r"~[0-9]*$", "")))
    wanted = wanted.withColumn("_n", fuzzy_distance(F.col("value")))
    return terms_within(index, wanted, n_clauses, max_distance).drop("_n", "_word")


def clause_terms(
    index: SearchIndex, clauses: DataFrame, field: str, n_clauses: int, kinds: set[str], max_distance: int, n_chars: int
) -> DataFrame:
    """Every clause on ``field`` as weighted terms: ``query_id, clause_no, occur, term, weight``. Terms found by pattern or
    likeness may not be used in the field; they have no weight there."""
    here = clauses.where(F.col("field") == field)
    parts = []
    if "match" in kinds:
        # The same word twice in a clause counts twice.
        split = here.where(F.col("kind") == "match")
        parts.append(split.select(*CLAUSE, "boost", F.explode(analyzed(F.col("value"))["term"]).alias("term")))
    if kinds & set(PATTERN_KINDS):
        found = expand_patterns(index, here.where(F.col("kind").isin(*PATTERN_KINDS)), n_clauses, n_chars)
        parts.append(found.select(*CLAUSE, "boost", "term"))
    if "fuzzy" in kinds:
        found = expand_fuzzy(index, here.where(F.col("kind") == "fuzzy"), n_clauses, field, max_distance)
        parts.append(found.select(*CLAUSE, "boost", "term"))
    rows = union(parts)
    return rows.groupBy(*CLAUSE, "term").agg(F.sum("boost").alias("weight"))


def phrase_hits(index: SearchIndex, clauses: DataFrame, n_words: int, field: str, scope: str) -> DataFrame:
    """Documents holding all words of a phrase at the right distances: ``query_id, clause_no, occur, shard, id, seg, score``.

    A word at place p that is the k-th of its phrase votes for the phrase starting at p - k; a start with a vote from
    every word is a match. Grouping is by query, document and start, never by word. The score is the sum over the
    phrase's words, each counted once per document.
    """
    spots = analyzed(F.col("value"))
    wanted = clauses.where((F.col("field") == field) & (F.col("kind") == "phrase")).withColumn("_spots", spots)
    terms = wanted.select(
        *CLAUSE, F.size("_spots").alias("n_parts"), "boost", F.explode("_spots").alias("s")
    ).select(*CLAUSE, "n_parts", F.col("s.pos").alias("at"), "s.term", F.col("boost").alias("weight"))
    weights = term_weights(index, terms, n_words, field, "bm25", scope)
    parts = matching_postings(index, weights, n_words, field, places=True)
    starts = F.transform("places", lambda p: p - F.col("at"))
    if field != ALL:
        low = index.layout.fields.index(field) * FIELD_GAP
        in_field = F.filter("places", lambda p: (p >= F.lit(low)) & (p < F.lit(low + FIELD_GAP)))
        starts = F.transform(in_field, lambda p: p - F.col("at"))
    found = []
    for rows in parts:
        voted = rows.select(*CLAUSE, "n_parts", "shard", "slice", "id", "seg", "score", F.explode(starts).alias("start"))
        full = (
            voted.groupBy(*CLAUSE, "n_parts", "shard", "slice", "id", "seg", "start")
            .agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
            .where(F.col("votes") == F.col("n_parts"))
        )
        found.append(full.groupBy(*CLAUSE, "shard", "slice", "id", "seg").agg(F.max("score").alias("score")))
    return union(found).drop("slice")


def range_test(value: Column, wanted: Column, kind: str = "timestamp") -> Column:
    """A timestamp, or a number (``kind="double"``), against ``>=x``, ``>x``, ``<=x`` or ``<x``; NULL for a bound of another
    type."""
    op = F.regexp_extract(wanted, r"^\s*(>=|>|<=|<)", 1)
    bound = F.trim(F.regexp_replace(wanted, r"^\s*(>=|>|<=|<)", "")).try_cast(kind)
    return (
        F.when(op == ">=", value >= bound)
        .when(op == ">", value > bound)
        .when(op == "<=", value <= bound)
        .when(op == "<", value < bound)
    )


def query_ranges(clauses: DataFrame) -> DataFrame:
    """``query_id, _ranges, _needs_one, _open``: a query's ranges; whether one of its should ranges has to be met, as nothing
    else has to match (no must, no should on text); whether no clause on text has to match at all."""
    range_, positive = F.col("kind") == "range", F.col("occur") != "must_not"
    needs_one = (F.count_if(positive & ~range_) == 0) & (F.count_if(F.col("occur") == "must") == 0)
    return clauses.groupBy("query_id").agg(
        F.collect_list(F.when(range_, F.struct("occur", "field", "value"))).alias("_ranges"),  # a query has few clauses
        needs_one.alias("_needs_one"),
        (F.count_if(positive & ~range_) == 0).alias("_open"),
    )


def fits_ranges(ranges: Column, needs_one: Column) -> Column:
    """Whether a row with ``indexed_at`` and ``numbers`` meets every range it must, none it must not, and one if needed."""

    def meets(r: Column) -> Column:
        number = range_test(F.element_at("numbers", r["field"]), r["value"], "double")
        date = range_test(F.col("indexed_at"), r["value"])
        return F.coalesce(F.when(r["field"] == "indexed_at", date).otherwise(number), F.lit(False))

    every = F.forall(
        ranges, lambda r: F.when(r["occur"] == "must_not", ~meets(r)).otherwise(meets(r) | (r["occur"] == "should"))
    )
    should = F.filter(ranges, lambda r: r["occur"] == "should")
    return every & (~needs_one | (F.size(should) == 0) | F.exists(should, meets))


def in_ranges(index: SearchIndex, hits: DataFrame, clauses: DataFrame, n_clauses: int) -> DataFrame:
    """Hits whose document fits the ranges of its query. Ranges meet hits on the query, an equality, and only the hits'
    documents are looked up, by place and segment."""
    layout = index.layout
    placed = hits.withColumn("slot", slot_of(F.col("id"), layout.doc_slots)).where(F.length("id") > 0)
    stored = union(index.parts("docs")).select("shard", "slot", "id", "seg", "indexed_at", "numbers")
    ranges = query_ranges(clauses).where(F.size("_ranges") > 0)
    with_ranges = placed.join(small(ranges, n_clauses), "query_id", "left")
    free = with_ranges.where(F.col("_ranges").isNull()).select(*hits.columns)
    bound = with_ranges.where(F.col("_ranges").isNotNull()).join(stored, ["shard", "slot", "id", "seg"])
    fits = fits_ranges(F.col("_ranges"), F.col("_needs_one"))
    return free.unionByName(bound.where(fits).select(*hits.columns))


OCCURS = ("must", "should", "must_not")
KINDS = ("match", "phrase", "fuzzy", "range", *PATTERN_KINDS)


def invalid_clauses(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    """Clauses that can't be answered, with an ``error``; ``match_clauses`` leaves them out."""
    field = F.coalesce("field", F.lit(ALL))
    in_text, in_values = field.isin(ALL, *index.layout.fields), field.isin("indexed_at", *index.layout.numbers)
    known = F.when(F.col("kind") == "range", in_values).otherwise(in_text)
    error = (
        F.when(~F.coalesce(F.col("occur").isin(*OCCURS), F.lit(False)), F.lit("unknown occur"))
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.lit("unknown kind"))
        .when(~F.coalesce(known, F.lit(False)), F.lit("unknown field"))
        .when(F.col("value").isNull(), F.lit("no value"))
    )
    return clauses.withColumn("error", error).where(F.col("error").isNotNull())


def open_hits(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """Live documents, with score 0, for the queries that no clause on text has to match: a stated set of queries against all
    rows. A document looks through the queries and stands only for those whose ranges it fits; must_not clauses on text
    then take away."""
    # One row, of no more queries than the batch has.
    queries = asked.agg(F.collect_list(F.struct("query_id", "_ranges", "_needs_one")).alias("_queries"))
    live = union([d.select("shard", "id", "seg", "indexed_at", "numbers") for d in index.parts("docs")])
    live = index.drop_replaced(live).join(F.broadcast(queries))
    fitting = F.filter("_queries", lambda q: fits_ranges(q["_ranges"], q["_needs_one"]))
    every = live.select(F.explode(fitting).alias("q"), "shard", "id", "seg").select("q.query_id", "shard", "id", "seg")
    return every.withColumn("score", F.lit(0.0))


def range_docs(index: SearchIndex, low=None, high=None, column: str = "indexed_at") -> DataFrame:
    """All live documents in ``[low, high)``: a plain filter that reaches the scan."""
    docs = index.docs()
    if low is not None:
        docs = docs.where(F.col(column) >= F.lit(low))
    if high is not None:
        docs = docs.where(F.col(column) < F.lit(high))
    return docs


def match_clauses(index: SearchIndex, clauses: DataFrame, scope: str = "shard") -> DataFrame:
    """``query_id, shard, id, seg, score`` of the documents that satisfy each query's clauses.

    A document must match every must clause, no must_not clause, and at least one should clause if there is no must.
    Its score is the sum over the must and should clauses on text it matches; a query without any starts from all live
    documents. ``invalid_clauses`` are left out.
    """
    bad = invalid_clauses(index, clauses).select("query_id", "clause_no")
    clauses = clauses.join(F.broadcast(bad), ["query_id", "clause_no"], "left_anti") if not bad.isEmpty() else clauses
    clauses = clauses.select(
        *CLAUSE, "kind", F.coalesce("field", F.lit(ALL)).alias("field"), "value", F.coalesce("boost", F.lit(1.0)).alias("boost")
    )
    # Which kinds and fields occur decides the branches of the plan: at most kinds x fields rows, and a count each.
    shape = clauses.groupBy("kind", "field").agg(
        F.count("*"), F.sum(F.length("value") + 1), F.max(F.when(F.col("kind") == "fuzzy", fuzzy_distance(F.col("value"))))
    ).collect()
    n_clauses, n_words = sum(r[2] for r in shape), sum(r[3] or 0 for r in shape)
    max_distance = max((r[4] or 0 for r in shape), default=0)
    parts = []
    for field in sorted({r["field"] for r in shape if r["kind"] != "range"}):
        kinds = {r["kind"] for r in shape if r["field"] == field}
        if kinds - {"phrase", "range"}:
            terms, n_terms = clause_terms(index, clauses, field, n_clauses, kinds, max_distance, n_words), n_words
            if not kinds <= {"match", "phrase", "range"}:
                # Patterns may expand to any number of terms: they are found once, and counted.
                terms, n_terms = counted(terms, "terms")
            found = matching_postings(index, term_weights(index, terms, n_terms, field, "bm25", scope), n_terms, field)
            parts.append(summed_per_document(found, *CLAUSE))
        if "phrase" in kinds:
            parts.append(phrase_hits(index, clauses, n_words, field, scope))
    place = ["query_id", "shard", "id", "seg"]
    if parts:
        matched = union([p.select(*CLAUSE, "shard", "id", "seg", "score") for p in parts])
    else:
        nowhere = [F.lit(v).cast(t).alias(n) for n, v, t in (("shard", 0, "int"), ("id", "", "string"), ("seg", 0, "long"))]
        matched = clauses.where(F.lit(False)).select(*CLAUSE, *nowhere, F.lit(0.0).alias("score"))
    positive = F.col("occur") != "must_not"
    per_doc = matched.groupBy("query_id", "shard", "id", "seg").agg(
        F.count_if(F.col("occur") == "must").alias("_must"),
        F.count_if(positive).alias("_positive"),
        F.count_if(~positive).alias("_not"),
        round_score(F.sum(F.when(positive, F.col("score")))).alias("score"),
    )
    needed = clauses.where(F.col("kind") != "range").groupBy("query_id").agg(
        F.count_if(F.col("occur") == "must").alias("_needed")
    )
    hits = per_doc.join(small(needed, n_clauses), "query_id").where(
        (F.col("_must") == F.col("_needed")) & (F.col("_positive") > 0) & (F.col("_not") == 0)
    )
    hits = index.drop_replaced(hits.select(*place, "score"))
    if any(r["kind"] == "range" for r in shape):
        hits = in_ranges(index, hits, clauses, n_clauses)
    asked = query_ranges(clauses).where("_open")
    if not asked.isEmpty():
        excluded = matched.where(~positive).select(*place).distinct()
        hits = hits.unionByName(open_hits(index, asked).join(excluded, place, "left_anti"))
    return hits


__all__ = ["expand_fuzzy", "expand_patterns", "in_ranges", "match_clauses", "phrase_hits", "range_docs", "vocabulary"]
