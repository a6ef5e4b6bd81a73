"""Routing entries: key-value rows read by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_TERMS = "/hot_terms/"
SHARDS = "/shards/active/"


def scan_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    return kv.where(F.col("key").startswith(prefix))
