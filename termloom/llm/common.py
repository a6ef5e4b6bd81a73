"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, shared_root, work_path

#: Rows in one Arrow batch. Texts can be very long, so the batch, not the partition, bounds a Python worker's memory.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session options the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: its lineage ends here and a lost executor repeats one step."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, so that extra columns of the caller survive."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Narrow rows that are broadcast, after they have been counted; copies of a row when there are more.
BROADCAST_ROWS = 200_000
SALTS = 16


def spread_join(rows: DataFrame, narrow: DataFrame, key: str, deal: Column) -> DataFrame:
    """``rows`` with the columns of ``narrow``, which has each ``key`` once (null is a key like any other).

    Few narrow rows are broadcast. Beyond that, every narrow row is copied ``SALTS`` times and a row of ``rows`` meets the
    copy that the hash ``deal`` picks, so that a key of a third of all rows is work for many tasks.
    """
    if narrow.count() <= BROADCAST_ROWS:
        other = narrow.withColumnRenamed(key, "_key")
        return rows.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    copies = narrow.withColumnRenamed(key, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(deal, F.lit(SALTS)).cast("int"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_copy"))
    return dealt.join(copies, same, "left").drop("_key", "_copy", "_salt")
