"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Tables laid out by slice meet on slice, term and block without a shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Rows, not bytes, bound a batch: its bytes would be added up anew for each row.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2147483647",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the plans rely on; all of them can be changed in a live session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "termloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and for one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_fallback_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback_root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder when running on a cluster")
        _fallback_root[app] = tempfile.mkdtemp(prefix="termloom-")
    return _fallback_root[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever written to the same one twice."""
    return f"{shared_root(spark)}/termloom/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, local: bool, name: str) -> DataFrame:
    """``df`` computed once, for plans that use it more than once: kept in the plan if it is known to be tiny, or written."""
    spark = df.sparkSession
    if local:
        return spark.createDataFrame(df.toArrow(), df.schema)
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written below the shared folder, for plans that need to know its size."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows, rows.count()
