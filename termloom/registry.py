"""The registered queries: each one runs an operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.keys import shard_of
from .functions.text import MAX_BODY, clean_markup, embedding_text, string_or_empty
from .functions.vectors import cosine, vector_from_json
from .operators.embedding import Encoder, embed, embed_queries, hashed_bag_encoder
from .operators.highlight import with_fragments
from .operators.indexing import build_index, postings_long, upsert_index
from .operators.ingest import (
    cap_pages,
    clean_pages,
    dense_ids,
    ingest_counters,
    shard_catalogue,
    shard_distribution,
    stamp,
    take_first,
)
from .operators.matching import match_clauses, range_docs
from .operators.queries import collapse_repeats, hybrid_defaults, keyword_defaults, rejected
from .operators.querylog import bucket_rows, latency_histogram, query_counts
from .operators.ranking import fetch_fields
from .operators.routing import hot_listing, hot_term_count, last_hot_stats, put_entries, route, stats_entries
from .plans.hybrid import HybridSearch
from .plans.search import KeywordSearch
from .session import configure, work_path
from .sources.corpus import corpus
from .sources.index_store import Layout, SearchIndex, open_index
from .sources.jsonl import bad, good, read_documents, write_documents, write_sharded
from .sources.pages import read_pages, write_pages
from .sources.tables import local_table, query_log, spread, table
from .streaming.ingest import stream_upserts
from .streaming.log import stream_collapse, stream_hot_stats, stream_latency, stream_query_counts, write_snapshots

Query = Callable[[SparkSession, str], DataFrame]

LAYOUT = Layout(n_shards=8, numbers=("n_chars",))
PAGE_CAP = 600
INDEX_CAP = 500
STAMP = "2024-01-01 00:00:00"
QUERY_VECTOR_ID = 7

# The query set. Limits of None take the default.
KEYWORD_QUERIES = [
    (1, "ertion thing", 10),
    (2, "oning", 5),
    (3, "Attion THBLE", None),
    (4, "the ertion", 10),
    (5, "zzzznone", 10),
    (15, "ertion thing", 0),
]
ROUTED_QUERIES = [
    (1, "ertion thing", 10),
    (2, "oning", 5),
    (3, "thing", 10),
    (4, "erly", 10),
    (5, "thble", 10),
    (6, "Oning", 10),
    (7, "oning thing", 10),
]
HYBRID_QUERIES = [  # query_id, q, limit, alpha, fusion, with a vector
    (11, "ertion thing", 10, None, "rrf", True),
    (12, "ertion thing", 10, 0.3, "weighted", True),
    (121, "ertion thing", 10, 0.0, "weighted", True),
    (122, "ertion thing", 10, None, "weighted", True),
    (13, "ertion thing", 10, None, "rrf", False),
    (14, "ertion thing", 5, 0.5, "other", True),
    (141, "oning", None, None, None, True),
    (142, "zzzznone", 10, None, "rrf", True),
]
CLAUSES = {
    "bool_match": [
        (6, 1, "must", "match", "_all", "thing", 1.0),
        (6, 2, "should", "match", "_all", "erly", 1.0),
        (6, 3, "must_not", "match", "_all", "thble", 1.0),
        (61, 1, "should", "match", "_all", "ertion", 1.0),
        (61, 2, "should", "match", "_all", "oning", 1.0),
        (62, 1, "must_not", "match", "_all", "thing", 1.0),
        (62, 2, "must_not", "match", "body", "erly", 1.0),
    ],
    "field_match": [
        (10, 1, "should", "match", "title", "ertion", 1.0),
        (101, 1, "must", "match", "title", "thing", 1.0),
        (101, 2, "must", "match", "body", "erly", 1.0),
    ],
    "phrase_match": [(7, 1, "must", "phrase", "body", "anea eriner", 1.0), (71, 1, "must", "phrase", "_all", "thing", 1.0)],
    "wildcard_match": [
        (8, 1, "should", "prefix", "_all", "tion*", 1.0),
        (81, 1, "should", "wildcard", "_all", "er*n?r", 1.0),
        (82, 1, "should", "regexp", "_all", "[ao]ning", 1.0),
    ],
    "fuzzy_match": [(9, 1, "should", "fuzzy", "_all", "letion~1", 1.0), (91, 1, "should", "fuzzy", "_all", "onign~2", 1.0)],
    "boosted_match": [
        (17, 1, "should", "match", "_all", "ertion", 2.5),
        (17, 2, "should", "match", "_all", "thing", 1.0),
        (17, 3, "should", "match", "title", "thing", 3.0),
    ],
    "range_match": [
        (18, 1, "must", "match", "_all", "thing", 1.0),
        (18, 2, "must", "range", "indexed_at", ">=2024-01-02 00:00:00", 1.0),
        (18, 3, "must_not", "range", "indexed_at", ">2024-01-06 12:00:00", 1.0),
        (19, 1, "must", "match", "_all", "ertion", 1.0),
        (181, 1, "must", "match", "_all", "thing", 1.0),
        (181, 2, "must", "range", "n_chars", ">=500", 1.0),
        (181, 3, "must", "range", "n_chars", "<1500.5", 1.0),
        (182, 1, "should", "range", "n_chars", "<200", 1.0),
        (182, 2, "should", "range", "indexed_at", ">=2024-01-08 00:00:00", 1.0),
        (183, 1, "must_not", "match", "_all", "thing", 1.0),
        (183, 2, "must", "range", "n_chars", ">3000", 1.0),
    ],
}
CLAUSE_SCHEMA = "query_id int, clause_no int, occur string, kind string, field string, value string, boost double"
ROUTING_ENTRIES = [
    ("/hot_terms/oning/shards", "0,1"),
    ("/hot_terms/thing/shards", "3, x, 5"),
    ("/hot_terms/erly/shards", "42"),
    ("/hot_terms/thble/shards", "x"),
    ("/hot_terms/a/b/shards", "1"),
    ("/hot_terms/oning/stats", "hits:12 shards:2 ts:1704067200"),
    ("/shards/active/0", "host:8080"),
]


# --- inputs derived from the tables ----------------------------------------------------------------------------------


@dataclass
class _Built:
    """Indexes already written by this application; building is by far the longest step of a query."""

    indexes: dict[tuple, SearchIndex] = field(default_factory=dict)


_built = _Built()


def stamped_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with a time per document that follows from its id: hours after the first day of 2024."""
    hours = F.make_interval(hours=(F.col("doc_id") % 200).cast("int"))
    return stamp(corpus(spark, sf_dir), F.lit(STAMP).cast("timestamp") + hours)


def corpus_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built.indexes:
        docs = stamped_corpus(spark, sf_dir)
        _built.indexes[key] = build_index(docs, work_path(spark, "index"), LAYOUT, unique_ids=True)
    return _built.indexes[key]


def keyword_table(spark: SparkSession, rows=None) -> DataFrame:
    return local_table(spark, KEYWORD_QUERIES if rows is None else rows, "query_id int, q string, limit int")


def hybrid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VECTOR_ID).select("embedding").collect()
    vector = [float(x) for x in vec[0][0]]
    rows = [(*r[:5], vector if r[5] else None) for r in HYBRID_QUERIES]
    schema = "query_id int, q string, limit int, alpha double, fusion string, query_vector array<double>"
    return local_table(spark, rows, schema)


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with markup round every text, of which the given ones have none."""
    text = F.concat(F.lit("'''a''' [[b]]\n\t{{c}} [d] ''"), F.col("text"), F.lit("''\n[[e]]\t"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as JSON lines, with a broken line for every tenth document."""
    docs = corpus(spark, sf_dir)
    line = F.to_json(F.struct("id", "title", "body", "title_vector"))
    broken = F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", "title": '))
    return docs.select(F.when(F.col("doc_id") % 10 == 3, broken).otherwise(line).alias("value"))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "lines")
    document_lines(spark, sf_dir).write.text(path)
    return read_documents(spark, path)


def raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as unchecked request parameters, all of them strings."""
    pick = F.col("event_id") % 6
    limits = [("0"), ("-1"), ("abc"), ("7"), (None), ("25")]
    limit, alpha = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, text in enumerate(limits):
        limit = F.when(pick == i, F.lit(text)).otherwise(limit)
    for i, text in enumerate(["0", "0.25", "x", None, "1.5", "0.7"]):
        alpha = F.when(pick == i, F.lit(text)).otherwise(alpha)
    q = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat(F.lit("q"), F.col("user_id").cast("string")))
    fusion = F.when(pick < 2, F.lit("rrf")).when(pick < 4, F.lit("weighted"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), q.alias("q"), limit.alias("limit"), alpha.alias("alpha"), fusion.alias("fusion")
    )


def hot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing entries for every user's query in the log, and the fixed ones of the query set."""
    log = query_log(spark, sf_dir)
    per_q = log.groupBy("q").agg(F.count("*").alias("n"), F.min("query_id").alias("first"))
    lists = F.concat_ws(",", (F.col("first") % 8).cast("string"), F.lit(" 9"), F.lit("x"), (F.col("n") % 8).cast("string"))
    rows = per_q.where(F.col("n") % 2 == 0).select(
        F.concat(F.lit("/hot_terms/"), F.col("q"), F.lit("/shards")).alias("key"), lists.alias("value")
    )
    return rows.unionByName(local_table(spark, ROUTING_ENTRIES, "key string, value string"))


def routed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(query_log(spark, sf_dir), hot_entries(spark, sf_dir), LAYOUT.n_shards)
    hits = (F.col("query_id") % 50).cast("long")
    return routed.withColumn("hits", hits).withColumn("shards", F.size("route").cast("long"))


# --- queries ---------------------------------------------------------------------------------------------------------


def q_clean_pages(spark, sf):
    return clean_pages(marked_up(spark, sf), MAX_BODY)


def q_page_scan_xml(spark, sf):
    path = work_path(spark, "xml")
    docs = spread(table(spark, sf, "documents"))
    write_pages(docs.select(F.col("doc_id").cast("string").alias("title"), "text"), path)
    return read_pages(spark, path).select("title", F.md5("text").alias("text_md5"))


def q_page_cap(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", "text")
    return cap_pages(pages, PAGE_CAP, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def q_jsonl_roundtrip(spark, sf):
    docs = corpus(spark, sf).select("id", "title", "body", "title_vector", "shard")
    flat, sharded = work_path(spark, "flat"), work_path(spark, "sharded")
    write_documents(docs.drop("shard"), flat)
    write_sharded(docs, sharded)
    columns = ["id", F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"), F.size("title_vector").alias("dims")]
    one = good(read_documents(spark, flat)).select(F.lit("flat").alias("kind"), F.lit(-1).cast("long").alias("shard"), *columns)
    schema = "id string, title string, body string, title_vector array<double>, shard int"
    many = spark.read.schema(schema).json(sharded)
    many = many.select(F.lit("sharded").alias("kind"), F.col("shard").cast("long").alias("shard"), *columns)
    return one.unionByName(many).withColumn("dims", F.coalesce(F.col("dims").cast("long"), F.lit(0)))


def q_jsonl_bad_rows(spark, sf):
    records = read_lines(spark, sf)
    lines = bad(records).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
    kept = good(records).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))
    return lines.withColumn("kind", F.lit("bad")).unionByName(kept.withColumn("kind", F.lit("good")))


def q_index_doc_cap(spark, sf):
    return take_first(good(read_lines(spark, sf)).select("id", "body"), "id", INDEX_CAP).select(
        "id", F.md5("body").alias("body_md5")
    )


def q_ingest_counters(spark, sf):
    return ingest_counters(read_lines(spark, sf))


def refusing(encoder: Encoder, part: str) -> Encoder:
    """``encoder``, but it refuses texts that contain ``part``."""

    def load():
        encode = encoder()

        def some(texts: list[str]) -> list[list[float]]:
            if any(part in t for t in texts):
                raise ValueError("refused")
            return encode(texts)

        return some

    return load


def q_build_counters(spark, sf):
    seen = Observation("build")
    docs = corpus(spark, sf, vectors=False)
    build_index(docs, work_path(spark, "counted"), LAYOUT, refusing(hashed_bag_encoder(8), "ß"), unique_ids=True, seen=seen)
    names = ["indexed", "embeds_ok", "embeds_failed", "embeds_not_tried"]
    return local_table(spark, [tuple(seen.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


def q_dense_ids(spark, sf):
    numbered = dense_ids(clean_pages(marked_up(spark, sf)), "doc_id")
    return numbered.select("doc_id", "id", F.md5("body").alias("body_md5"))


def q_stamped_docs(spark, sf):
    return stamped_corpus(spark, sf).select("id", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))


def q_doc_shards(spark, sf):
    identity = F.concat(F.lit("wiki_"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        identity.alias("id"),
        shard_of(identity, 8).cast("long").alias("shard"),
        shard_of(identity, 0).cast("long").alias("unsharded"),
        shard_of(identity, 200).cast("long").alias("shard_200"),
    )


def q_shard_distribution(spark, sf):
    docs = table(spark, sf, "nation").select(
        shard_of(F.concat(F.lit("wiki_"), F.col("n_nationkey").cast("string")), 64).alias("shard")
    )
    few = shard_distribution(docs, 64).select(F.lit("nation").alias("kind"), F.col("shard").cast("long"), "n_docs")
    many = shard_distribution(corpus(spark, sf, vectors=False), 8)
    return few.unionByName(many.select(F.lit("documents").alias("kind"), F.col("shard").cast("long"), "n_docs"))


def q_shard_catalogue(spark, sf):
    listed = shard_catalogue(corpus_index(spark, sf).docs())
    return listed.select(F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"), "count")


def q_token_stats(spark, sf):
    stats = corpus_index(spark, sf).term_stats()
    parts = [
        F.struct(F.lit(f).alias("field"), F.col(f"df_{f}").alias("df"), F.col(f"ctf_{f}").alias("tf")) for f in LAYOUT.fields
    ]
    total = sum((F.col(f"ctf_{f}") for f in LAYOUT.fields[1:]), F.col(f"ctf_{LAYOUT.fields[0]}"))
    parts.append(F.struct(F.lit("_all").alias("field"), F.col("df_all").alias("df"), total.alias("tf")))
    rows = stats.select("term", F.inline(F.array(*parts))).where(F.col("df") > 0)
    return rows.groupBy("term", "field").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def q_index_postings(spark, sf):
    longs = [F.col(c).cast("long").alias(c) for c in ("shard", "tf", "dl")]
    return postings_long(corpus_index(spark, sf)).select("term", "field", "id", *longs)


def q_index_keyword_only(spark, sf):
    index = build_index(corpus(spark, sf, vectors=False), work_path(spark, "plain"), LAYOUT, unique_ids=True)
    terms = index.segment("postings", index.base).groupBy("id").agg(F.count("*").alias("n_terms"))
    docs = index.docs().select("id", F.coalesce(F.size("title_vector"), F.lit(-1)).cast("long").alias("dims"))
    return docs.join(terms, "id", "left").select("id", "dims", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def upserted_index(spark, sf) -> SearchIndex:
    """The corpus, then one upsert that rewrites all German documents and adds every page as a new one."""
    base = corpus_index(spark, sf)
    rewritten = corpus(spark, sf).where(F.col("lang") == "de").select(
        "id", "title", F.concat(F.col("body"), F.lit(" nachtrag ertion")).alias("body"), "title_vector"
    )
    pages = spread(table(spark, sf, "pages")).select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"),
        F.col("url").alias("title"),
        clean_markup(F.col("html"), None).alias("body"),
        F.lit(None).cast("array<double>").alias("title_vector"),
    )
    return upsert_index(base, rewritten.unionByName(pages), unique_ids=True)


def q_index_upsert(spark, sf):
    index = upserted_index(spark, sf)
    from_stats = index.term_stats().groupBy("term").agg(F.sum("df_all").alias("df"), F.sum("ctf_body").alias("body_tf"))
    live = postings_long(index)
    from_rows = live.groupBy("term").agg(
        F.count_if(F.col("field") == "_all").alias("live_df"),
        F.coalesce(F.sum(F.when(F.col("field") == "body", F.col("tf"))), F.lit(0)).alias("live_body_tf"),
    )
    return from_stats.join(from_rows, "term", "full").select("term", "df", "body_tf", "live_df", "live_body_tf")


def _ranked(results: DataFrame) -> DataFrame:
    return results.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score", F.col("shard").cast("long").alias("shard"))


def q_match_bm25(spark, sf):
    return _ranked(KeywordSearch(corpus_index(spark, sf), keyword_table(spark)).results())


def q_match_bm25_global(spark, sf):
    return _ranked(KeywordSearch(corpus_index(spark, sf), keyword_table(spark), scope="global").results())


def q_match_tfidf(spark, sf):
    return _ranked(KeywordSearch(corpus_index(spark, sf), keyword_table(spark), model="tfidf").results())


def _clauses(key: str) -> Query:
    def run(spark, sf):
        clauses = local_table(spark, CLAUSES[key], CLAUSE_SCHEMA)
        return match_clauses(corpus_index(spark, sf), clauses).select("query_id", "id", "score")

    return run


def q_range_match(spark, sf):
    index = corpus_index(spark, sf)
    both = _clauses("range_match")(spark, sf)
    alone = range_docs(index, F.lit("2024-01-03 00:00:00").cast("timestamp"), F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return both.unionByName(alone.select(F.lit(20).alias("query_id"), "id", F.lit(0.0).alias("score")))


def _routed_search(spark, sf, queries: DataFrame | None = None, **options) -> KeywordSearch:
    kv = local_table(spark, ROUTING_ENTRIES, "key string, value string")
    asked = keyword_table(spark, ROUTED_QUERIES) if queries is None else queries
    return KeywordSearch(corpus_index(spark, sf), asked, kv, **options)


def q_shard_topn(spark, sf):
    longs = [F.col(c).cast("long").alias(c) for c in ("shard", "shard_rank")]
    search = KeywordSearch(corpus_index(spark, sf), keyword_table(spark), prune=True)
    return search.candidates().select("query_id", "id", "score", *longs)


def q_fanout_union(spark, sf):
    search = _routed_search(spark, sf)
    found = search.hits().groupBy("query_id", "shard").agg(F.count("*").alias("n_hits"))
    sent = search.candidates().groupBy("query_id", "shard").agg(F.count("*").alias("n_candidates"))
    both = found.join(sent, ["query_id", "shard"])
    return both.select("query_id", F.col("shard").cast("long").alias("shard"), "n_hits", "n_candidates")


def q_global_topk(spark, sf):
    return _ranked(_routed_search(spark, sf, prune=True).results())


def q_search_summary(spark, sf):
    search = _routed_search(spark, sf)
    ids = F.array_join(F.transform("hits", lambda h: h["id"]), ",")
    return search.responses().join(search.match_counts(), "query_id", "left").select(
        "query_id",
        "query",
        F.col("shards").cast("long").alias("shards"),
        "total_hits",
        "routing_type",
        F.size("hits").cast("long").alias("n_hits"),
        ids.alias("ids"),
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
    )


def repeated_queries(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """Every event asks one of ``rows``: ``query_id, ts, q, limit``."""
    numbered = local_table(spark, [(n, r[1], r[2]) for n, r in enumerate(rows)], "n long, q string, limit int")
    log = query_log(spark, sf_dir).select("query_id", "ts", (F.col("query_id") % len(rows)).alias("n"))
    return log.join(F.broadcast(numbered), "n").drop("n")  # a fixed handful of rows


def q_search_collapsed(spark, sf):
    search = KeywordSearch(corpus_index(spark, sf), repeated_queries(spark, sf, KEYWORD_QUERIES), collapse=True)
    ids = F.array_join(F.transform("hits", lambda h: h["id"]), ",")
    return search.responses().select("query_id", "query", "total_hits", ids.alias("ids"))


def q_search_hot_stats(spark, sf):
    asked = repeated_queries(spark, sf, ROUTED_QUERIES)
    return _routed_search(spark, sf, queries=asked, collapse=True).hot_stats(asked)


def q_search_fields(spark, sf):
    index = corpus_index(spark, sf)
    search = KeywordSearch(index, keyword_table(spark))
    winners = search.top().select("query_id", "rank", "id")
    found = fetch_fields(index, winners, search.bounds.n_queries * search.bounds.max_limit, "title", "body", "title_vector")
    return found.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "id",
        string_or_empty(F.col("title")).alias("title"),
        F.md5("body").alias("body_md5"),
        F.coalesce(F.size("title_vector"), F.lit(0)).cast("long").alias("dims"),
    )


def q_highlights(spark, sf):
    index = corpus_index(spark, sf)
    search = KeywordSearch(index, keyword_table(spark))
    n = search.bounds.n_queries * search.bounds.max_limit
    marked = with_fragments(index, search.top().select("query_id", "rank", "id"), search.clean_queries, n)
    text = F.coalesce(F.try_element_at("fragments", F.lit("body"))[0], F.lit(""))
    return marked.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "id",
        F.map_contains_key("fragments", "title").alias("in_title"),
        F.map_contains_key("fragments", "body").alias("in_body"),
        text.contains("<mark>").alias("marked"),
    )


def q_query_defaults(spark, sf):
    raw = raw_queries(spark, sf)
    keyword = keyword_defaults(raw).select("query_id", "q", F.col("limit").cast("long").alias("limit"))
    mixed = hybrid_defaults(raw).select(
        "query_id", F.col("limit").cast("long").alias("hybrid_limit"), "alpha", "fusion"
    )
    none = rejected(raw).select("query_id", "q", "error")
    return keyword.join(mixed, "query_id").withColumn("error", F.lit("")).unionByName(none, allowMissingColumns=True)


def q_hot_lookup(spark, sf):
    log = query_log(spark, sf)
    routed = route(log, hot_entries(spark, sf), LAYOUT.n_shards)
    shown = F.array_join(F.transform(F.array_sort("route"), lambda s: s.cast("string")), ",")
    return routed.select("query_id", "q", "routing_type", shown.alias("route"))


def q_hot_routing(spark, sf):
    search = _routed_search(spark, sf)
    return search.hits().join(search.routed.select("query_id", "routing_type"), "query_id").select(
        "query_id", "routing_type", F.col("shard").cast("long").alias("shard"), "id", "score"
    )


def q_hot_stats(spark, sf):
    return last_hot_stats(routed_log(spark, sf))


def q_hot_listing(spark, sf):
    stats = last_hot_stats(routed_log(spark, sf))
    kv = put_entries(hot_entries(spark, sf), stats_entries(stats))
    return hot_listing(kv).join(F.broadcast(hot_term_count(kv))).select(  # the count is one row
        "term",
        "n_terms",
        F.col("entries")["shards"].alias("shards"),
        F.col("entries")["stats"].alias("stats"),
        F.size("entries").cast("long").alias("n_fields"),
    )


def q_cosine_to_query(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = vectors.where(F.col("vec_id") == QUERY_VECTOR_ID).select("v").collect()[0][0]
    q = F.lit(first)
    return vectors.select(
        "vec_id",
        F.round(cosine(F.col("v"), q), 6).alias("to_query"),
        cosine(F.slice("v", 1, 3), q).alias("unequal"),
        cosine(F.transform("v", lambda x: x * 0.0), q).alias("to_zero"),
        F.round(cosine(F.transform("v", lambda x: -x), F.col("v")), 6).alias("opposite"),
    )


def q_vector_coercion(spark, sf):
    label = F.col("label") % 4
    whole = F.to_json(F.transform(F.slice("embedding", 1, 4), lambda x: (x * 1000).cast("long")))
    text = (
        F.when(label == 0, whole)
        .when(label == 1, F.concat(F.lit('["2.5", '), F.substring(whole, 2, 1 << 20)))
        .when(label == 2, F.concat(F.lit("[null, true, "), F.substring(whole, 2, 1 << 20)))
        .otherwise(F.col("vec_id").cast("string"))
    )
    parsed = vector_from_json(text)
    return table(spark, sf, "embeddings").select("vec_id", parsed.alias("v")).select(
        "vec_id",
        F.coalesce(F.size("v"), F.lit(-1)).cast("long").alias("dims"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.get("v", F.lit(0)).alias("head"),
    )


def q_embed_text(spark, sf):
    title = F.when(F.col("lang") == "en", F.col("title")).otherwise(F.lit(""))
    text = embedding_text(title, F.col("body"))
    return corpus(spark, sf, vectors=False).select("id", text.alias("embedding_text"))


def vector_digest(v: Column) -> list[Column]:
    """Numbers that tell one vector from another: width, length, and its sums with two ramps."""
    places = F.sequence(F.lit(0), F.size(v) - 1)

    def total(weigh: Callable[[Column, Column], Column]) -> Column:
        terms = F.zip_with(v, places, weigh)
        return F.when(F.size(v) > 0, F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 5))

    return [
        F.coalesce(F.size(v), F.lit(0)).cast("long").alias("dims"),
        total(lambda x, i: x * x).alias("square"),
        total(lambda x, i: x * (i + 1)).alias("ramp"),
        total(lambda x, i: x * (i + 1) * (i + 1)).alias("steep"),
    ]


def q_embed_docs(spark, sf):
    docs = corpus(spark, sf, vectors=False)
    vectors = docs.select("id", embed(embedding_text(F.col("title"), F.col("body")), hashed_bag_encoder()).alias("v"))
    return vectors.select("id", *vector_digest(F.col("v")))


def q_embed_batch(spark, sf):
    turns = table(spark, sf, "conversations")
    # One text without a word would fail the whole batch, which a test shows; no given turn lacks one.
    v = embed(F.col("text"), hashed_bag_encoder(16), on_error="fail")
    return turns.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", *vector_digest(F.col("v")))


def q_embed_queries(spark, sf):
    q = F.when(F.col("turn") % 3 == 0, F.lit("?!")).otherwise(F.col("text"))
    asked = table(spark, sf, "conversations").select("conv_id", "turn", q.alias("q"))
    v = embed_queries(asked, hashed_bag_encoder(32))
    return v.select("conv_id", "turn", *vector_digest(F.col("query_vector")))


def _hybrid(keep: Callable[[tuple], bool]) -> Query:
    ids = [r[0] for r in HYBRID_QUERIES if keep(r)]

    def run(spark, sf):
        asked = hybrid_table(spark, sf).where(F.col("query_id").isin(ids))
        found = HybridSearch(corpus_index(spark, sf), asked).results()
        longs = [F.col(c).cast("long").alias(c) for c in ("rank", "shard")]
        scores = ["keyword_score", "semantic_score", "hybrid_score"]
        return found.select("query_id", "id", *scores, "fusion_method", *longs)

    return run


def q_hybrid_summary(spark, sf):
    kv = local_table(spark, ROUTING_ENTRIES, "key string, value string")
    found = HybridSearch(corpus_index(spark, sf), hybrid_table(spark, sf), kv).responses()
    return found.select(
        "query_id",
        "query",
        F.coalesce(F.size("query_vector"), F.lit(0)).cast("long").alias("dims"),
        "keyword_hits",
        F.col("semantic_topk").cast("long").alias("semantic_topk"),
        "fusion_alpha",
        "fusion_method",
        F.col("fusion_k").cast("long").alias("fusion_k"),
        "routing_type",
        F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("ids"),
    )


def q_query_counts(spark, sf):
    return query_counts(query_log(spark, sf))


def q_latency_histogram(spark, sf):
    return latency_histogram(query_log(spark, sf))


def q_query_collapse(spark, sf):
    limit = F.when(F.col("query_id") % 3 != 0, F.col("limit")).alias("limit")  # the others have none
    distinct, asked = collapse_repeats(query_log(spark, sf).select("query_id", "q", limit))
    answers = distinct.select(F.col("query_id").alias("answer_id"), F.concat_ws(":", "q", F.col("limit").cast("string")).alias("answer"))
    return asked.join(answers, "answer_id")


def q_stream_upsert(spark, sf):
    """Two rounds of files through one stream: all documents, then a rewrite of the English ones."""
    configure(spark)
    source, index_path, checkpoint = (work_path(spark, n) for n in ("incoming", "live", "stream"))
    docs = spread(table(spark, sf, "documents"))
    shape = [F.concat(F.lit("wiki_"), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("title")]
    rounds = [
        docs.select(*shape, F.col("text").alias("body"), F.lit(STAMP).cast("timestamp").alias("indexed_at")),
        docs.where(F.col("lang") == "en").select(
            *shape,
            F.concat(F.lit("[[revised]] "), F.col("text")).alias("body"),
            F.lit("2024-02-01 00:00:00").cast("timestamp").alias("indexed_at"),
        ),
    ]
    for records in rounds:
        records.write.mode("append").json(source, compression="gzip")
        stream_upserts(spark, source, index_path, checkpoint, LAYOUT).awaitTermination()
    index = open_index(spark, index_path)
    live = index.docs().select("id", F.col("shard").cast("long").alias("shard"), F.md5("body").alias("body_md5"))
    terms = postings_long(index).where((F.col("field") == "body")).groupBy("id").agg(F.sum("tf").alias("n_words"))
    return live.join(terms, "id", "left").select("id", "shard", "body_md5", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def q_stream_collapse(spark, sf):
    """Every query of the log once, as its key repeats within minutes: the stream's clock is the query's own age."""
    path, out, checkpoint = (work_path(spark, n) for n in ("log", "passed", "stream"))
    log = query_log(spark, sf)
    at = F.lit(STAMP).cast("timestamp") + F.make_interval(secs=(F.col("query_id") % 60).cast("decimal(10,0)"))
    spread(log.select("query_id", at.alias("ts"), "q", "limit")).write.parquet(path)
    schema = "query_id long, ts timestamp, q string, limit int"
    passed = stream_collapse(spark.readStream.schema(schema).parquet(path)).select("q", "limit")
    passed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("q string, limit int").parquet(out).select("q", F.col("limit").cast("long").alias("limit"))


def streamed(spark: SparkSession, log: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The last result of a running aggregation over ``log``, read as a stream of files."""
    path, out, checkpoint = (work_path(spark, n) for n in ("log", "snapshots", "stream"))
    spread(log).write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    write_snapshots(make(stream), out, checkpoint).awaitTermination()
    snapshots = spark.read.parquet(out)
    newest = snapshots.agg(F.max("batch")).collect()[0][0]
    return snapshots.where(F.col("batch") == newest).drop("batch")


def q_stream_metrics(spark, sf):
    return streamed(spark, query_log(spark, sf), stream_query_counts)


def q_stream_latency(spark, sf):
    return bucket_rows(streamed(spark, query_log(spark, sf), stream_latency))


def q_stream_hot_stats(spark, sf):
    return streamed(spark, routed_log(spark, sf), stream_hot_stats)


QUERIES: dict[str, Query] = {
    "clean_pages": q_clean_pages,
    "page_scan_xml": q_page_scan_xml,
    "page_cap": q_page_cap,
    "jsonl_roundtrip": q_jsonl_roundtrip,
    "jsonl_bad_rows": q_jsonl_bad_rows,
    "index_doc_cap": q_index_doc_cap,
    "ingest_counters": q_ingest_counters,
    "build_counters": q_build_counters,
    "dense_ids": q_dense_ids,
    "stamped_docs": q_stamped_docs,
    "doc_shards": q_doc_shards,
    "shard_distribution": q_shard_distribution,
    "shard_catalogue": q_shard_catalogue,
    "token_stats": q_token_stats,
    "index_postings": q_index_postings,
    "index_keyword_only": q_index_keyword_only,
    "index_upsert": q_index_upsert,
    "match_bm25": q_match_bm25,
    "match_bm25_global": q_match_bm25_global,
    "match_tfidf": q_match_tfidf,
    "bool_match": _clauses("bool_match"),
    "field_match": _clauses("field_match"),
    "phrase_match": _clauses("phrase_match"),
    "wildcard_match": _clauses("wildcard_match"),
    "fuzzy_match": _clauses("fuzzy_match"),
    "range_match": q_range_match,
    "boosted_match": _clauses("boosted_match"),
    "shard_topn": q_shard_topn,
    "fanout_union": q_fanout_union,
    "global_topk": q_global_topk,
    "search_summary": q_search_summary,
    "search_collapsed": q_search_collapsed,
    "search_hot_stats": q_search_hot_stats,
    "search_fields": q_search_fields,
    "highlights": q_highlights,
    "query_defaults": q_query_defaults,
    "hot_lookup": q_hot_lookup,
    "hot_routing": q_hot_routing,
    "hot_stats": q_hot_stats,
    "hot_listing": q_hot_listing,
    "cosine_to_query": q_cosine_to_query,
    "vector_coercion": q_vector_coercion,
    "embed_text": q_embed_text,
    "embed_docs": q_embed_docs,
    "embed_batch": q_embed_batch,
    "embed_queries": q_embed_queries,
    "hybrid_rrf": _hybrid(lambda r: r[4] in ("rrf", None) and r[5]),
    "hybrid_weighted": _hybrid(lambda r: r[4] in ("weighted", "other")),
    "hybrid_fallback": _hybrid(lambda r: not r[5]),
    "hybrid_summary": q_hybrid_summary,
    "query_counts": q_query_counts,
    "latency_histogram": q_latency_histogram,
    "query_collapse": q_query_collapse,
    "stream_upsert": q_stream_upsert,
    "stream_collapse": q_stream_collapse,
    "stream_metrics": q_stream_metrics,
    "stream_latency": q_stream_latency,
    "stream_hot_stats": q_stream_hot_stats,
}


def with_configuration(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    return configured


def queries() -> dict[str, Query]:
    return {name: with_configuration(run) for name, run in QUERIES.items()}
