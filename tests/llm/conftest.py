import pytest
from pyspark.sql import types as T

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``, with columns whose names operators use inside."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F

            for name in ("_fp", "fp", "_tx", "_all", "_keep", "drop_", "id_", "tx_", "unit", "bucket", "guest", "score",
                         "_vector", "label", "ids", "words", "h1", "h2", "pos", "site", "spans", "shards", "component"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(DOC))


#: Rows that every operator must stand: null and empty texts, a null id, repeated rows, a tie of ids, a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (None, "no id at all"),
    (4, "same row twice"),
    (4, "same row twice"),
    (5, "one id, first text"),
    (5, "one id, second text"),
    (6, "é" * 50_000),
    (7, "word " * 20_000),
    (8, "Zürich 日本 \U0001f600 mixed\r\nlines"),
]


@pytest.fixture
def odd():
    return list(ODD)
