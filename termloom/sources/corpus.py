"""The given tables as a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import shard_of
from ..operators.ingest import clean_pages
from .tables import ID_PREFIX, spread, table


def corpus(spark: SparkSession, sf_dir: str, n_shards: int = 8, vectors: bool = True) -> DataFrame:
    """``documents`` as a corpus: whole clean bodies, the first line as title, ``embeddings`` as title vectors."""
    raw = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "lang", "n_chars", F.substring_index("text", "\n", 1).alias("title"), "text"
    )
    docs = clean_pages(raw, max_len=None)
    if vectors:
        vec = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("title_vector"))
        docs = docs.join(vec, F.col("doc_id") == F.col("vec_id"), "left").drop("vec_id")
    identity = F.concat(F.lit(ID_PREFIX), F.col("doc_id").cast("string"))
    return docs.withColumn("id", identity).withColumn("shard", shard_of(F.col("id"), n_shards))
