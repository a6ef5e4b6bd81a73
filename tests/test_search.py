"""Properties of indexes and searches."""

import pytest
from pyspark.sql import functions as F

from termloom import registry
from termloom.operators.embedding import embed, embed_queries, hashed_bag_encoder
from termloom.operators.indexing import build_index, compact_index, merge_deltas, newest_per_id, postings_long, upsert_index
from termloom.operators.ingest import cap_pages, dense_ids, ingest_pages, number_rows, observe_counters, take_first
from termloom.operators.matching import expand_fuzzy, invalid_clauses, match_clauses
from termloom.operators.queries import BROADCAST_ROWS, collapse_repeats
from termloom.operators.routing import route
from termloom.plans.engine import SearchEngine
from termloom.plans.hybrid import HybridSearch, fuse
from termloom.plans.search import KeywordSearch
from termloom.session import work_path
from termloom.sources.corpus import corpus
from termloom.sources.index_store import CommitConflict, Layout, commit, manifest, open_index
from termloom.sources.jsonl import read_documents
from termloom.sources.pages import read_pages
from termloom.sources.tables import local_table

from .conftest import SF

ASKED = "query_id int, q string, limit int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def small_docs(spark, bodies, stamp="2024-01-01 00:00:00"):
    return local_table(spark, [(i, i.upper(), b) for i, b in bodies], "id string, title string, body string").withColumn(
        "indexed_at", F.lit(stamp).cast("timestamp")
    )


def asked(spark, *queries):
    return local_table(spark, [(i + 1, q, 10) for i, q in enumerate(queries)], ASKED)


def test_batch_equals_one_by_one(spark, index):
    batch = KeywordSearch(index, registry.keyword_table(spark)).results().select("query_id", "rank", "id", "score")
    single = []
    for row in registry.KEYWORD_QUERIES:
        one = local_table(spark, [row], ASKED)
        single += rows(KeywordSearch(index, one).results().select("query_id", "rank", "id", "score"))
    assert rows(batch) == sorted(single)


def test_partition_count_does_not_matter(spark, index):
    want = rows(KeywordSearch(index, registry.keyword_table(spark)).results())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(KeywordSearch(index, registry.keyword_table(spark)).results()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffled_joins_give_the_same(spark, index, monkeypatch):
    """Beyond the broadcast bound the plan changes, the result does not."""
    want = rows(KeywordSearch(index, registry.keyword_table(spark)).responses())
    monkeypatch.setattr("termloom.operators.queries.BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows(KeywordSearch(index, registry.keyword_table(spark)).responses()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_depth_of_three_limits_cannot_change_the_top(spark, index):
    search = KeywordSearch(index, registry.keyword_table(spark))
    from_hits = rows(search.top().select("query_id", "rank", "id"))
    from_responses = [
        (r.query_id, h.rank, h.id) for r in search.responses().collect() for h in r.hits
    ]
    assert sorted(from_responses) == from_hits


def test_global_scores_do_not_depend_on_shards(spark, index):
    docs = registry.stamped_corpus(spark, SF)
    other = build_index(docs, work_path(spark, "few"), Layout(n_shards=3, term_buckets=5, doc_slots=2), unique_ids=True)
    query = registry.keyword_table(spark)
    get = lambda i: rows(KeywordSearch(i, query, scope="global").results().select("query_id", "rank", "id", "score"))
    assert get(other) == get(index)


def test_upsert_equals_rebuild_and_compaction(spark):
    docs = corpus(spark, SF).select("id", "title", "body", "title_vector", "lang")
    base = build_index(docs, work_path(spark, "base"), unique_ids=True)
    changed = docs.where("lang = 'fr'").withColumn("body", F.concat(F.lit("thing ertion "), "body"))
    new = small_docs(spark, [("new_1", "ertion thing " * 30), ("new_2", "thing " * 20)])
    batch = changed.drop("lang").unionByName(new.drop("indexed_at"), allowMissingColumns=True)
    merged = docs.where("lang <> 'fr'").drop("lang").unionByName(batch)
    rebuilt = build_index(merged, work_path(spark, "rebuilt"), unique_ids=True)
    once = upsert_index(base, batch)
    twice = upsert_index(once, batch)
    merged_deltas = merge_deltas(twice)
    assert len(twice.deltas) == 2 and len(merged_deltas.deltas) == 1
    thrice = upsert_index(merged_deltas, batch)
    compacted = compact_index(thrice, Layout(n_shards=8, term_buckets=4, doc_slots=2))
    query = registry.keyword_table(spark)
    want = rows(KeywordSearch(rebuilt, query).responses())
    want_postings = rows(postings_long(rebuilt))
    for index in (once, twice, merged_deltas, thrice, compacted, open_index(spark, base.path)):
        assert rows(KeywordSearch(index, query).responses()) == want
        assert rows(postings_long(index)) == want_postings
        assert index.totals == rebuilt.totals
    assert rows(KeywordSearch(open_index(spark, base.path, 1), query).responses()) == rows(
        KeywordSearch(base, query).responses()
    )
    assert manifest(spark, base.path).count() == 6


def test_hot_term_is_split_over_files(spark):
    """A word in every document and a third of all records under one id."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("d"), F.col("id"))).alias("id"),
        F.lit("t").alias("title"),
        F.concat(F.lit("everywhere "), F.col("id").cast("string")).alias("body"),
        F.timestamp_seconds(F.col("id")).alias("indexed_at"),
    )
    index = build_index(docs, work_path(spark, "hot"))
    assert index.totals["n_docs"] == 2001
    assert index.docs().where("id = 'same'").select("body").collect()[0][0] == "everywhere 2997"
    counts = KeywordSearch(index, asked(spark, "everywhere")).match_counts().collect()
    assert counts[0].match_count == 2001


def test_empty_ids_are_dropped_and_missing_text_is_kept(spark):
    docs = local_table(spark, [("", "t", "b"), ("a", None, None), (None, "t", "b"), ("b", "t", "b")], "id string, title string, body string")
    index = build_index(docs, work_path(spark, "odd"))
    assert rows(index.docs().select("id")) == [("a",), ("b",)]
    assert KeywordSearch(index, asked(spark, "a")).results().select("id", "title").collect() == []  # a stop word
    assert [r.title for r in KeywordSearch(index, asked(spark, "b")).results().collect()] == ["t"]


def test_index_cap(spark):
    docs = small_docs(spark, [(f"d{i}", "text here") for i in range(9)] + [("", "x")])
    assert build_index(docs, work_path(spark, "cap"), max_docs=4).totals["n_docs"] == 4


def test_newest_record_wins(spark):
    docs = small_docs(spark, [("a", "old")]).union(small_docs(spark, [("a", "new")], "2024-06-01 00:00:00"))
    assert [r.body for r in newest_per_id(docs).collect()] == ["new"]


def test_routing(spark):
    kv = local_table(spark, registry.ROUTING_ENTRIES, "key string, value string")
    queries = local_table(spark, [(q,) for q in ("oning", "thing", "erly", "thble", "a/b", "Oning", "oning thing")], "q string")
    got = {r.q: (r.routing_type, sorted(r.route)) for r in route(queries, kv, 8).collect()}
    everywhere = ("cold", list(range(8)))
    assert got == {
        "oning": ("hot", [0, 1]),
        "thing": ("hot", [3, 5]),
        "erly": ("hot", []),
        "thble": everywhere,
        "a/b": ("hot", [1]),
        "Oning": everywhere,
        "oning thing": everywhere,
    }


def ranked(spark, rows_):
    schema = "id string, keyword_score double, semantic_score double, has_vec boolean, alpha double, keyword_rank int, semantic_rank int"
    return local_table(spark, rows_, schema)


def test_fusion(spark):
    two = ranked(spark, [("a", 2.0, 0.5, True, 0.7, 1, 2), ("b", 2.0, 0.0, False, 0.7, 2, 1)])
    by_rank = {r.id: r.hybrid_score for r in fuse(two, F.lit(True)).collect()}
    assert by_rank == {"a": round(1 / 61 + 1 / 62, 6), "b": round(1 / 61 + 1 / 62, 6)}
    by_weight = {r.id: (r.hybrid_score, r.fusion_method) for r in fuse(two, F.lit(False)).collect()}
    assert by_weight == {"a": (1.55, "weighted"), "b": (2.0, "weighted")}


def test_missing_vector_ranks_above_negative_cosine(spark):
    docs = local_table(
        spark,
        [("a", "t", "word one", [0.2, 0.98]), ("b", "t", "word two", None), ("c", "t", "word three", [-0.4, 0.9])],
        "id string, title string, body string, title_vector array<double>",
    )
    index = build_index(docs, work_path(spark, "vec"), Layout(n_shards=0))
    query = local_table(spark, [(1, "word", [1.0, 0.0])], "query_id int, q string, query_vector array<double>")
    got = {r.id: r.semantic_rank for r in HybridSearch(index, query).fused().collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_engine_with_encoder(spark, index):
    kv = local_table(spark, registry.ROUTING_ENTRIES, "key string, value string")
    engine = SearchEngine(index, kv, hashed_bag_encoder(64))
    keyword = engine.search_one("oning", 3).collect()[0]
    assert keyword.routing_type == "hot" and keyword.shards == 8 and len(keyword.hits) <= 3
    hybrid = engine.hybrid_one("ertion thing", 5).collect()[0]
    assert hybrid.fusion_method == "rrf" and hybrid.fusion_k == 60 and len(hybrid.hits) == 5
    fallback = engine.hybrid_one("?! ertion").collect()[0]
    assert fallback.query_vector is not None
    assert engine.shards().collect()[0]["count"] == 8
    assert {r.term for r in engine.hot_terms().collect()} == {"oning", "thing", "erly", "thble"}


def test_encoder_failures(spark):
    texts = local_table(spark, [("good text",), ("?!",), (None,)], "q string")
    got = [r.query_vector for r in embed_queries(texts, hashed_bag_encoder(8)).collect()]
    assert got[0] is not None and got[1] is None and got[2] is None
    encode = hashed_bag_encoder(1)()
    assert [abs(x) for v in encode([" ".join(f"w{i}" for i in range(n)) for n in range(1, 40)]) for x in v] == [1.0] * 39
    with pytest.raises(Exception, match="nothing to embed"):
        texts.select(embed(F.col("q"), hashed_bag_encoder(8), on_error="fail")).collect()
    with pytest.raises(Exception, match="empty embedding"):
        texts.select(embed(F.col("q"), lambda: lambda ts: [[] for _ in ts], on_error="fail")).collect()


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_against_brute_force(spark, index):
    terms = {r.term for r in index.term_stats().where("df_all > 0").select("term").distinct().collect()}
    words = ["letion~1", "onign~2", "a~2", "élan~2"]
    clauses = local_table(spark, [(i, 1, "should", "fuzzy", "_all", w, 1.0) for i, w in enumerate(words)], registry.CLAUSE_SCHEMA)
    got = {(r.query_id, r.term) for r in expand_fuzzy(index, clauses, len(words), "_all", 2).collect()}
    want = {
        (i, t) for i, w in enumerate(words) for t in terms if brute_distance(t, w.split("~")[0]) <= int(w.split("~")[1])
    }
    assert got == want


def test_phrases_respect_gaps_and_fields(spark):
    docs = local_table(
        spark,
        [
            ("d1", "red fox", "king of the hill"),
            ("d2", "king", "hill"),
            ("d3", "x", "king hill"),
            ("d4", "y", "a b a king of a hill a"),
            ("d5", "ba na", "na ba na ba na"),
        ],
        "id string, title string, body string",
    )
    index = build_index(docs, work_path(spark, "phrase"))
    clauses = local_table(
        spark,
        [
            (1, 1, "must", "phrase", "body", "king of the hill", 1.0),
            (2, 1, "must", "phrase", "_all", "king hill", 1.0),
            (3, 1, "must", "phrase", "body", "na ba na ba", 1.0),
            (4, 1, "must", "phrase", "title", "na ba", 1.0),
        ],
        registry.CLAUSE_SCHEMA,
    )
    got = rows(match_clauses(index, clauses).select("query_id", "id"))
    assert got == [(1, "d1"), (1, "d4"), (2, "d3"), (3, "d5")]  # d4 has other stop words in the same gap


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert rows(number_rows(df, "k").select("k", "seq")) == [(i, i + 1) for i in range(1000)]
    assert sorted(r.seq for r in number_rows(df).collect()) == list(range(1, 1001))
    same = spark.range(100).select(F.lit(1).alias("k"))
    assert sorted(r.seq for r in number_rows(same, "k").collect()) == list(range(1, 101))
    assert number_rows(df.where("k < 0"), "k").count() == 0
    assert rows(dense_ids(df.where("k < 3"), "k").select("k", "id")) == [(0, "wiki_1"), (1, "wiki_2"), (2, "wiki_3")]


def test_caps(spark):
    df = spark.range(20).withColumnRenamed("id", "page_no")
    assert cap_pages(df, 0).count() == 20
    assert rows(cap_pages(df, 5)) == [(i,) for i in range(5)]
    assert rows(cap_pages(df, 5, compat=True)) == [(i,) for i in range(4)]
    assert cap_pages(df, 1, compat=True).count() == 0
    assert take_first(df, "page_no", 100).count() == 20


def test_pages_to_documents(spark):
    path = work_path(spark, "dump")
    body = "[[word]] " * 20
    xml = (
        '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">'
        f"<page><title>A</title><revision><text>old</text></revision><revision><text xml:space=\"preserve\">{body}</text></revision></page>"
        "<page><title>B</title><revision><text>short</text></revision></page>"
        f"<page><revision><text>{body} two</text></revision></page></mediawiki>"
    )
    local_table(spark, [(xml,)], "value string").write.text(path)
    docs = ingest_pages(read_pages(spark, path), n_shards=4, at=F.lit("2024-01-01").cast("timestamp"))
    got = rows(docs.select("id", "title", "body"))
    assert got == [("wiki_1", "A", ("word " * 20).strip()), ("wiki_2", "", "word " * 20 + "two")]


def test_observed_counters(spark):
    path = work_path(spark, "lines")
    lines = ['{"id": "a", "title": "t", "body": "b", "title_vector": [1, 2]}', '{"id": ', '{"id": "b"}', '{"id": "", "title_vector": "x"}', ""]
    local_table(spark, [(x,) for x in lines], "value string").write.text(path)
    records, seen = observe_counters(read_documents(spark, path))
    assert records.count() == 4
    assert seen.get == {"indexed": 2, "skipped": 2, "embeds_ok": 1, "embeds_failed": 1}


def test_broadcast_bound_is_modest():
    assert BROADCAST_ROWS <= 1_000_000


# Commits


def few_docs(spark, ids, word="alpha"):
    return spark.createDataFrame([(i, f"title {i}", f"{word} body of {i}") for i in ids], "id string, title string, body string")


def test_two_upserts_from_one_handle_both_stay(spark):
    path = work_path(spark, "commit")
    base = build_index(few_docs(spark, ["a"]), path)
    upsert_index(base, few_docs(spark, ["b"]))
    newest = upsert_index(base, few_docs(spark, ["c"]))
    assert sorted(r.id for r in open_index(spark, path).docs().collect()) == ["a", "b", "c"]
    assert newest.version == 3 and manifest(spark, path).count() == 3
    assert sorted(r.id for r in newest.docs().collect()) == ["a", "b", "c"]


def test_concurrent_upserts_all_stay(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = work_path(spark, "commit")
    base = build_index(few_docs(spark, ["a", "x"]), path)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda n: upsert_index(base, few_docs(spark, [f"n{n}", "x"], f"word{n}")), range(3)))
    index = open_index(spark, path)
    assert sorted(r.id for r in index.docs().collect()) == ["a", "n0", "n1", "n2", "x"]
    assert index.totals["n_docs"] == 5
    live = {r.term: r.df_body for r in index.term_stats().groupBy("term").agg(F.sum("df_body").alias("df_body")).collect()}
    assert live["alpha"] == 1 and sum(live[f"word{n}"] for n in range(3)) == 4


def test_a_version_is_committed_once(spark):
    path = work_path(spark, "commit")
    index = build_index(few_docs(spark, ["a"]), path)
    with pytest.raises(CommitConflict):
        commit(index)


def test_a_rebuild_is_a_new_version(spark):
    path = work_path(spark, "commit")
    build_index(few_docs(spark, ["a"]), path)
    assert build_index(few_docs(spark, ["b"]), path).version == 2
    assert [r.id for r in open_index(spark, path).docs().collect()] == ["b"]
    assert [r.id for r in open_index(spark, path, 1).docs().collect()] == ["a"]


# Clauses without text that has to match


def test_queries_of_exclusions_and_ranges(spark):
    rows = [("a", "thing one", "2024-01-01"), ("b", "other one", "2024-02-01"), ("c", "thing two", "2024-03-01")]
    docs = spark.createDataFrame([(i, "t", b, t) for i, b, t in rows], "id string, title string, body string, at string")
    docs = docs.withColumn("indexed_at", F.col("at").cast("timestamp")).drop("at")
    index = upsert_index(build_index(docs.where("id <> 'c'"), work_path(spark, "clauses")), docs.where("id = 'c'"))
    clauses = [
        (1, 0, "must", "match", "body", "thing"),
        (2, 0, "must", "range", "indexed_at", ">=2024-02-01"),
        (3, 0, "must_not", "match", "body", "thing"),
        (4, 0, "must_not", "range", "indexed_at", "<2024-03-01"),
        (5, 0, "should", "range", "indexed_at", "<2024-01-15"),
        (5, 1, "should", "range", "indexed_at", ">=2024-03-01"),
        (6, 0, "must_not", "match", "body", "one"),
        (6, 1, "must", "range", "indexed_at", ">=2024-01-01"),
        (7, 0, "must", "nonsense", "body", "thing"),
        (8, 0, "must", "match", "nowhere", "thing"),
    ]
    table = local_table(spark, [(*c, 1.0) for c in clauses], "query_id int, clause_no int, occur string, kind string, field string, value string, boost double")
    got = {}
    for r in match_clauses(index, table).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {1: {"a", "c"}, 2: {"b", "c"}, 3: {"b"}, 4: {"c"}, 5: {"a", "c"}, 6: {"c"}}
    assert {(r.query_id, r.error) for r in invalid_clauses(index, table).collect()} == {(7, "unknown kind"), (8, "unknown field")}
    only = table.where("query_id = 2")
    assert {r.id for r in match_clauses(index, only).collect()} == {"b", "c"}


def test_repeats_without_limit_are_kept(spark):
    asked = local_table(spark, [(1, "a", None), (2, "a", None), (3, "a", 5)], "query_id int, q string, limit int")
    distinct, who = collapse_repeats(asked)
    assert sorted((r.query_id, r.answer_id) for r in who.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert distinct.count() == 2


def test_pages_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    pages = "".join(f'<page id="{i}">\n<title>t{i}</title><revision><text>old</text></revision><revision><text>x &lt;b&gt; {"y" * 500} {i}</text></revision></page>\n' for i in range(3000))
    (tmp_path / "dump.xml").write_text(f"<mediawiki>\n<pages>\n{pages}<page><title>cut off</ti")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = read_pages(spark, str(tmp_path / "dump.xml"))
        assert df.rdd.getNumPartitions() > 4
        rows = df.orderBy("page_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.title for r in rows] == [f"t{i}" for i in range(3000)]
    assert all(r.text == f"x <b> {'y' * 500} {i}" for i, r in enumerate(rows))


def test_unreachable_encoder_means_keywords_only(spark):
    def unreachable():
        raise ConnectionError("no encoder")

    index = build_index(few_docs(spark, ["a", "b"]), work_path(spark, "plain"), encoder=unreachable)
    assert [r.title_vector for r in index.docs().collect()] == [None, None]
    assert KeywordSearch(index, asked(spark, "alpha")).results().count() == 2
    queries = embed_queries(asked(spark, "alpha"), unreachable)
    assert queries.collect()[0].query_vector is None
    with pytest.raises(Exception, match="no encoder"):
        asked(spark, "alpha").select(embed(F.col("q"), unreachable, on_error="fail")).collect()


def test_ranges_over_numbers(spark):
    docs = local_table(
        spark, [(f"d{i}", "t", "word" if i % 2 else "other", None if i == 7 else i * 10) for i in range(10)],
        "id string, title string, body string, size long",
    )
    index = build_index(docs, work_path(spark, "numbers"), Layout(2, numbers=("size",)))
    index = upsert_index(index, docs.where("id = 'd3'").withColumn("size", F.lit(1000)))
    clauses = [
        (1, 1, "must", "match", "body", "word", 1.0),
        (1, 2, "must", "range", "size", ">=50", 1.0),
        (2, 1, "must_not", "range", "size", "<80.5", 1.0),
        (3, 1, "should", "range", "size", "<15", 1.0),
        (3, 2, "must_not", "match", "body", "word", 1.0),
        (4, 1, "must", "range", "size", ">=2024-01-01", 1.0),
        (5, 1, "must", "range", "height", ">1", 1.0),
    ]
    table = local_table(spark, clauses, registry.CLAUSE_SCHEMA)
    want = [(1, "d3"), (1, "d5"), (1, "d9"), (2, "d3"), (2, "d7"), (2, "d9"), (3, "d0")]
    for i in (index, compact_index(index), open_index(spark, index.path)):
        assert rows(match_clauses(i, table).select("query_id", "id")) == want
    assert [r.query_id for r in invalid_clauses(index, table).collect()] == [5]
