"""Headline measurements: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line.

Every step is run once on a small input first, so that the numbers are those of a warm session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import registry
from termloom.operators.embedding import hashed_bag_encoder
from termloom.operators.indexing import build_index, upsert_index
from termloom.plans.hybrid import HybridSearch
from termloom.plans.search import KeywordSearch
from termloom.session import local_session, work_path
from termloom.sources.corpus import corpus
from termloom.sources.index_store import Layout, SearchIndex
from termloom.sources.tables import local_table, table

N_QUERIES = 1000
LAYOUT = Layout(n_shards=8, term_buckets=8)


def distinct_queries(index: SearchIndex, n: int = N_QUERIES) -> list[tuple[int, str, int]]:
    """Two-word queries: a frequent term with each of the next ``n``."""
    by_df = index.term_stats().groupBy("term").agg(F.sum("df_body").alias("df"))
    terms = [r["term"] for r in by_df.orderBy(F.desc("df"), "term").limit(n + 1).collect()]
    return [(i, f"{terms[i % 7]} {t}", 10) for i, t in enumerate(terms[1:])]


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(times: dict[str, float], name: str, run):
    start = time.time()
    out = run()
    times[name] = round(time.time() - start, 3)
    print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    return out


def run(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], dict[str, float]]:
    times: dict[str, float] = {}
    docs = corpus(spark, sf_dir, vectors=False).select("id", "title", "body")
    n_docs = docs.count()
    index = timed(times, "index_build_keyword", lambda: build_index(docs, work_path(spark, "b"), LAYOUT, unique_ids=True))
    timed(
        times,
        "index_build_vectors",
        lambda: build_index(docs, work_path(spark, "b"), LAYOUT, hashed_bag_encoder(384), unique_ids=True),
    )
    with_vectors = registry.corpus_index(spark, sf_dir)
    rows = distinct_queries(index)
    asked = local_table(spark, rows, "query_id int, q string, limit int")
    timed(times, "keyword_batch_1000", lambda: consume(KeywordSearch(index, asked).results()))
    one = local_table(spark, rows[:1], "query_id int, q string, limit int")
    timed(times, "keyword_single", lambda: KeywordSearch(index, one).results().collect())
    vectors = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(N_QUERIES).collect()
    hybrid_rows = [(*r, [float(x) for x in v["embedding"]]) for r, v in zip(rows, vectors * (1 + len(rows) // len(vectors)))]
    hybrid_asked = local_table(spark, hybrid_rows, "query_id int, q string, limit int, query_vector array<double>")
    timed(times, "hybrid_batch_1000", lambda: consume(HybridSearch(with_vectors, hybrid_asked).results()))
    changed = docs.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).withColumn("body", F.concat("body", F.lit(" revised")))
    upserted = timed(times, "index_upsert_1pct", lambda: upsert_index(index, changed, unique_ids=True))
    timed(times, "keyword_batch_after_upsert", lambda: consume(KeywordSearch(upserted, asked).results()))
    for name in ("bool_match", "phrase_match", "wildcard_match", "fuzzy_match", "search_summary", "hybrid_summary",
                 "token_stats", "latency_histogram", "hot_lookup", "clean_pages", "dense_ids", "cosine_to_query"):
        timed(times, name, lambda: consume(registry.QUERIES[name](spark, sf_dir)))
    rates = {
        "docs_per_sec_keyword": round(n_docs / times["index_build_keyword"], 1),
        "docs_per_sec_vectors": round(n_docs / times["index_build_vectors"], 1),
        "keyword_queries_per_sec": round(len(rows) / times["keyword_batch_1000"], 1),
        "hybrid_queries_per_sec": round(len(rows) / times["hybrid_batch_1000"], 1),
        "n_docs": n_docs,
    }
    return times, rates


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if os.path.isdir(warm):
        run(spark, warm)
    times, rates = run(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
                "rates": rates,
                "cores": cpus,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
