"""A corpus pipeline: five stages over ``documents``, each written and read again before the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``. All but the last return the columns of
``documents``. The packed sequences come from a tokenizer, which SQL doesn't have: ``ORACLE_SQL`` is None and tests
compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import documents, stored
from termloom.llm.lines import remove_spread_lines
from termloom.llm.packing import pack
from termloom.llm.pii import redact_documents
from termloom.llm.queries import byte_bpe, training_labels
from termloom.llm.simhash import keep_one_per_component
from termloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents like the toxic examples go."""
    return drop_toxic(docs, training_labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites stay in one place only."""
    return remove_spread_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: shingles of three words, fingerprints within two bits."""
    return keep_one_per_component(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of one length; one row per piece, with its ids."""
    return pack(docs, keep_ids=True, **byte_bpe())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
