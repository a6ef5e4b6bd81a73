"""Repeated queries, statistics written back, and outcomes of an encoder."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from termloom import registry
from termloom.operators import embedding
from termloom.operators.embedding import embed, embed_outcome, hashed_bag_encoder
from termloom.operators.indexing import build_index
from termloom.plans.search import KeywordSearch
from termloom.session import work_path
from termloom.sources.index_store import Layout
from termloom.sources.tables import local_table

from .conftest import SF

ASKED = "query_id int, q string, limit int"
REPEATED = [(1, "ertion thing", 5), (2, "oning", None), (3, "ertion thing", 5), (4, "ertion thing", 3), (5, "oning", 0), (6, "", 5), (7, "zzzznone", 5)]


def test_repeats_are_searched_once_and_answered_to_all(spark):
    index = registry.corpus_index(spark, SF)
    asked = local_table(spark, REPEATED, ASKED)
    once, each = (KeywordSearch(index, asked, collapse=c) for c in (True, False))
    assert once.bounds.n_queries == 4 and each.bounds.n_queries == 6
    assert once.hits().select("query_id").distinct().count() == 3  # one query finds nothing
    for step in ("results", "responses"):
        got, want = (sorted(map(tuple, getattr(s, step)().collect())) for s in (once, each))
        assert got == want
    assert {r.query_id for r in once.responses().collect()} == {1, 2, 3, 4, 5, 7}


def test_statistics_come_from_answers(spark):
    kv = local_table(spark, [("/hot_terms/oning/shards", "0,1")], "key string, value string")
    asked = local_table(spark, [(1, "oning", 5), (2, "thing", 5), (3, "oning", 5), (4, "oning", 5)], ASKED)
    times = asked.select("query_id", F.timestamp_seconds(F.col("query_id") * 10).alias("ts"))
    search = KeywordSearch(registry.corpus_index(spark, SF), asked, kv, collapse=True)
    found = search.hot_stats(times).collect()
    total = search.responses().where("query_id = 4").first().total_hits
    assert total > 0 and [tuple(r) for r in found] == [("oning", total, 2, 40)]


def test_outcomes(spark):
    def half_gone():
        def encode(texts):
            if len(texts) > 1 or texts[0] == "gone":
                raise ConnectionError("no answer")
            if texts[0] == "bad":
                raise ValueError("refused")
            return [[1.0]]

        return encode

    df = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "gone"), (3, None)], "i int, q string").coalesce(1)
    got = [r.o for r in df.select("i", embed_outcome(F.col("q"), half_gone).alias("o")).orderBy("i").collect()]
    assert [o.outcome for o in got] == [embedding.OK, embedding.REFUSED, embedding.LOST, embedding.OK]
    assert [o.vector for o in got] == [[1.0], None, None, [1.0]]

    def unloadable():
        raise OSError("no model")

    assert {r.o.outcome for r in df.select(embed_outcome(F.col("q"), unloadable).alias("o")).collect()} == {embedding.NOT_TRIED}


def test_one_text_without_a_word_fails_its_batch(spark):
    df = spark.createDataFrame([("a word",), ("?!",)], "q string").coalesce(1)
    with pytest.raises(Exception, match="nothing to embed"):
        df.select(embed(F.col("q"), hashed_bag_encoder(4), on_error="fail")).collect()


def test_counters_of_a_build(spark):
    docs = spark.createDataFrame(
        [("a", "good", "x"), ("b", "?!", "x"), ("c", "", "some body"), ("", "no id", "x"), ("d", "ß", "x"), ("d", "ß", "x")],
        "id string, title string, body string",
    )
    seen = Observation("counted")
    encoder = registry.refusing(hashed_bag_encoder(4), "ß")
    build_index(docs, work_path(spark, "counted"), Layout(n_shards=2), encoder, seen=seen)
    assert seen.get == {"indexed": 4, "embeds_ok": 2, "embeds_failed": 2, "embeds_not_tried": 0}
