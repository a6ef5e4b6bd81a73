"""A slice whose postings don't fit one task is dealt out to several, with the same index."""

from pathlib import Path

from termloom.operators.indexing import build_index, postings_long, upsert_index
from termloom.session import work_path
from termloom.sources.index_store import Layout
from termloom.sources.tables import local_table

SCHEMA = "id string, title string, body string"


def rows_of(index):
    stats = [tuple(sorted(r.asDict(recursive=True).items(), key=lambda x: x[0])) for r in index.term_stats().collect()]
    plain = sorted(str([(k, sorted(map(str, v)) if isinstance(v, list) else v) for k, v in r]) for r in stats)
    return sorted(map(tuple, postings_long(index).collect())), plain


def test_a_large_slice_is_work_for_many_tasks(spark, monkeypatch):
    rows = [(f"d{i}", "the title" if i % 3 else None, " ".join(f"w{(i * j) % 17} frequent" for j in range(i % 23))) for i in range(200)]
    docs = local_table(spark, rows, SCHEMA)
    more = local_table(spark, [(f"d{i}", "new title", f"frequent w{i % 5} again") for i in range(150, 260)], SCHEMA)
    layout = Layout(n_shards=2, term_buckets=2)

    def made():
        index = build_index(docs, work_path(spark, "tasks"), layout, unique_ids=True)
        base = rows_of(index)
        files = [len(list(Path(index.table_path("postings", index.base)).glob("shard=0/bucket=0/*.parquet")))]
        index = upsert_index(index, more, unique_ids=True)
        files.append(len(list(Path(index.table_path("postings", index.deltas[0])).glob("*.parquet"))))
        return (base, rows_of(index)), files

    once, few = made()
    assert few == [1, 1]
    for module in ("sources.index_store", "operators.indexing"):
        monkeypatch.setattr(f"termloom.{module}.SORTED_BYTES", 1000)
    # Neighbouring rows of a term come in different batches as well.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        again, many = made()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert min(many) > 1
    assert again == once
