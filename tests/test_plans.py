"""Plan properties that matter at scale."""

import pytest

from termloom import registry
from termloom.operators.indexing import build_index, upsert_index
from termloom.operators.ranking import fetch_fields
from termloom.plans.hybrid import HybridSearch
from termloom.plans.search import KeywordSearch
from termloom.session import work_path
from termloom.sources.tables import local_table

from .conftest import SF


def plan(df) -> str:
    """The formatted plan: the tree, then a block per operator."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def as_large(monkeypatch):
    """Plans as a batch too large for literals gets them."""
    monkeypatch.setattr("termloom.operators.scoring.KNOWN_WORDS", 0)


@pytest.fixture
def search_plan(spark, index, as_large):
    return plan(KeywordSearch(index, registry.keyword_table(spark)).responses())


@pytest.fixture
def hybrid_plan(spark, index, as_large):
    return plan(HybridSearch(index, registry.hybrid_table(spark, SF)).results())


def scans(text: str, table: str) -> list[str]:
    """The operator blocks that read a table of the index."""
    return [b for b in text.split("\n\n") if "Scan parquet" in b and f"/{table}/" in b]


def test_term_buckets_are_pruned_by_the_join(search_plan):
    found = scans(search_plan, "postings") + scans(search_plan, "term_stats")
    assert len(found) >= 2 and all("dynamicpruning" in x for x in found)


def test_small_batches_are_pruned_by_literals(spark, index):
    search = KeywordSearch(index, registry.keyword_table(spark, [(1, "ertion thing", 3)]))
    found = scans(plan(search.top()), "postings")
    assert found and all("bucket" in x and "IN (" in x and "In(term" in x for x in found)


def test_winners_are_fetched_in_one_plan_that_prunes(spark, index):
    search = KeywordSearch(index, registry.keyword_table(spark, [(1, "ertion thing", 3)]))
    fetched = scans(plan(search.results()), "docs")
    assert fetched and all("dynamicpruning" in x for x in fetched)


def test_replaced_documents_are_not_looked_for_again(spark):
    docs = local_table(spark, [(str(i), "t", f"alpha word{i}") for i in range(20)], "id string, title string, body string")
    index = upsert_index(build_index(docs, work_path(spark, "seg")), docs.where("id < '15'"))
    search = KeywordSearch(index, local_table(spark, [(1, "alpha", 50)], "query_id int, q string, limit int"))
    winners = local_table(spark, [("3", index.deltas[0])], "id string, seg long")
    assert not scans(plan(fetch_fields(index, winners, 1, "title")), "tombstones")
    assert search.results().count() == 20


def test_large_and_small_batches_agree(spark, index, monkeypatch):
    query = registry.keyword_table(spark)
    rows = lambda: sorted(tuple(r) for r in KeywordSearch(index, query).results().collect())
    small = rows()
    monkeypatch.setattr("termloom.operators.scoring.KNOWN_WORDS", 0)
    assert rows() == small


def test_positions_are_not_read_for_keywords(search_plan):
    assert all("places" not in x for x in scans(search_plan, "postings"))


def test_bodies_are_not_read_for_results(search_plan, hybrid_plan):
    for p in (search_plan, hybrid_plan):
        assert scans(p, "docs") and all("body:string" not in x for x in scans(p, "docs"))


def test_top_n_is_cut_before_the_shuffle(search_plan, hybrid_plan):
    for p in (search_plan, hybrid_plan):
        assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_no_products_and_no_single_partition(search_plan, hybrid_plan):
    for p in (search_plan, hybrid_plan):
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "SinglePartition" not in p


def test_fuzzy_and_patterns_use_equal_keys(spark, index):
    for name in ("fuzzy_match", "wildcard_match"):
        p = plan(registry.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_cleaning_happens_once(spark):
    p = plan(registry.QUERIES["clean_pages"](spark, SF))
    assert "regexp_replace" in p and all("regexp_replace" not in b for b in p.split("\n\n") if ") Filter" in b)
