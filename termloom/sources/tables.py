"""The given Parquet tables, and the views the engine works on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


ID_PREFIX = "wiki_"


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation: its size is known to the planner and no Python worker reads it."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    struct = T.StructType([T.StructField(f.name, f.dataType) for f in struct])
    columns = list(zip(*rows)) if rows else [() for _ in struct]
    arrays = [pa.array(list(c), type=to_arrow_type(f.dataType)) for c, f in zip(columns, struct)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=struct.names), struct)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few partitions, such as one small file; anything larger stays as it was split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a query log: ``query_id, ts, q, limit, status, shard, latency_s``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("q"),
        F.when(F.col("event_id") % 2 == 0, F.lit(5)).otherwise(F.lit(10)).alias("limit"),
        F.col("event_type").alias("status"),
        F.concat(F.lit("shard-"), (F.col("user_id") % 8).cast("string")).alias("shard"),
        (F.col("value") / 1000).alias("latency_s"),
    )
