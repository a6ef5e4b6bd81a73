"""Postings by slice: sums without a shuffle, best hits without scoring all, shards that are not read."""

import re

import pytest
from pyspark.sql import functions as F

from termloom import registry
from termloom.operators.indexing import build_index, upsert_index
from termloom.operators.ranking import global_topk, shard_topn
from termloom.operators.scoring import matching_postings
from termloom.plans.hybrid import HybridSearch
from termloom.plans.search import KeywordSearch
from termloom.session import work_path
from termloom.sources.corpus import corpus
from termloom.sources.index_store import Layout, open_index, slice_keys
from termloom.sources.tables import local_table

from .conftest import SF
from .test_plans import plan, scans

ASKED = "query_id int, q string, limit int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def busy(spark, index):
    """Queries of a frequent word with each of some others, and some odd ones."""
    by_df = index.term_stats().groupBy("term").agg(F.sum("df_all").alias("df")).orderBy(F.desc("df"), "term").limit(60)
    terms = [r.term for r in by_df.collect()]
    asked = [(i, f"{terms[i % 3]} {t}", 1 + i % 7) for i, t in enumerate(terms[3:])]
    asked += [(100, f"{terms[0]} {terms[1]} {terms[2]} {terms[0]}", 3), (101, "zzzznone", 5), (102, "the", 5), (103, terms[40], 500)]
    return local_table(spark, asked, ASKED)


@pytest.fixture(scope="module")
def changed(spark):
    docs = corpus(spark, SF).select("id", "title", "body")
    base = build_index(docs, work_path(spark, "slices"), Layout(n_shards=4, slices_per_shard=2, term_buckets=3), unique_ids=True)
    # The best documents of many queries are replaced by ones that match nothing.
    gone = docs.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 0).withColumn("body", F.lit("nothing left"))
    return upsert_index(upsert_index(base, gone), docs.limit(5).withColumn("id", F.concat(F.lit("x"), "id")))


@pytest.mark.parametrize("options", [{}, {"model": "tfidf"}, {"scope": "global"}, {"field": "title"}])
def test_pruned_hits_hold_the_best(index, busy, options):
    search = KeywordSearch(index, busy, **options)
    for b, cut in ((search.best(1, "query_id"), global_topk), (search.best(3, "query_id", "shard"), shard_topn)):
        asked = search.clean_queries if cut is global_topk else b.depth
        assert rows(cut(b.hits(), asked, b.cap, b.n_queries)) == rows(cut(search.hits(), asked, b.cap, b.n_queries))


def test_pruning_counts_no_replaced_document(changed, busy, monkeypatch):
    get = lambda prune: rows(KeywordSearch(changed, busy, prune=prune).responses())
    want = get(False)
    assert get(True) == want
    monkeypatch.setattr("termloom.operators.scoring.KNOWN_WORDS", 0)
    assert get(True) == want


def test_pruned_hybrid_answers_the_same(spark, index):
    asked = registry.hybrid_table(spark, SF)
    assert rows(HybridSearch(index, asked, prune=True).results()) == rows(HybridSearch(index, asked).results())


def test_pruning_reads_few_postings(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    index = registry.corpus_index(spark, sf)
    by_df = index.term_stats().groupBy("term").agg(F.sum("df_body").alias("df")).orderBy(F.desc("df"), "term").limit(300)
    terms = [r.term for r in by_df.collect()]
    asked = local_table(spark, [(i, f"{terms[i % 7]} {t}", 10) for i, t in enumerate(terms[100:])], ASKED)
    best = KeywordSearch(index, asked).best(1, "query_id")
    count = lambda parts: sum(p.count() for p in parts)
    every = count(matching_postings(index, best.weights.drop("lead", "most"), best.n_terms, known=best.known))
    read = count(best.lead_postings()) + count(best.essential_postings())
    assert read < 0.5 * every
    assert count(best.looked_up()) <= count(best.contenders()) * 2 < 0.5 * every


@pytest.mark.parametrize("known", [0, 256])
def test_scores_are_summed_without_a_shuffle(index, busy, monkeypatch, known):
    """Between the scan of the base's postings and the sum per document there is no exchange."""
    monkeypatch.setattr("termloom.operators.scoring.KNOWN_WORDS", known)
    text = index.spark._jvm.PythonSQLUtils.explainString(KeywordSearch(index, busy).hits()._jdf.queryExecution(), "simple")
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "termloom_postings" in line)
    above = [line for line in lines[:at] if not re.search(r"Subquery|BroadcastExchange", line)]
    assert any("HashAggregate(keys=[query_id" in line for line in above) and not any("Exchange" in line for line in above)
    assert "Bucketed: true" in lines[at]


def test_every_bucket_holds_one_slice(spark, changed):
    n = changed.layout.slice_count
    files = spark.read.parquet(changed.table_path("postings", changed.base)).select("slice", "id", F.input_file_name().alias("f"))
    bucket = F.regexp_extract("f", r"_(\d{5})\.", 1).cast("int")
    found = files.select(bucket.alias("b"), "slice").distinct().collect()
    assert {(r.b, r.slice) for r in found} == set(enumerate(slice_keys(spark, n)))
    assert files.groupBy("id").agg(F.count_distinct("slice").alias("n")).where("n > 1").isEmpty()


def test_a_session_that_did_not_write_the_index_reads_its_slices(spark, changed, busy):
    want = rows(KeywordSearch(changed, busy).results())
    spark.sql(f"DROP TABLE {changed.sliced_name()}")
    opened = open_index(spark, changed.path)
    assert rows(KeywordSearch(opened, busy).results()) == want
    assert rows(KeywordSearch(opened, busy, prune=True).results()) == want


@pytest.mark.parametrize("known", [0, 256])
def test_hot_queries_read_the_shards_of_their_route(spark, index, monkeypatch, known):
    monkeypatch.setattr("termloom.operators.scoring.KNOWN_WORDS", known)
    kv = local_table(spark, [("/hot_terms/oning/shards", "0,1"), ("/hot_terms/thing/shards", "1")], "key string, value string")
    asked = local_table(spark, [(1, "oning", 50), (2, "thing", 50)], ASKED)
    search = KeywordSearch(index, asked, kv)
    found = scans(plan(search.hits()), "postings")
    assert found and all(re.search(r"PartitionFilters:.*dynamicpruningexpression\(shard", x) for x in found)
    assert {r.shard for r in search.hits().select("shard").distinct().collect()} <= {0, 1}
    assert rows(search.top()) == rows(KeywordSearch(index, asked, kv, prune=True).top())
