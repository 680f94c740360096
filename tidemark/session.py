"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC timestamps and Arrow exchange.

    Shuffle partitions stay at what the cluster sets; adaptive execution
    coalesces small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` names it. Only a local master, where driver and
    executors are one machine, may fall back to a new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a written table below the shared folder."""
    return f"{_shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    allow_checkpoints(df.sparkSession)
    return df.checkpoint(eager=eager)


def allow_checkpoints(spark: SparkSession) -> None:
    """Let Spark cut the lineage of iterative work in the shared folder."""
    folder = _shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back.

    For frames that several branches of a plan need: the branches then read
    only their columns, and lost executors cost a re-read, not a recomputation.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows spread over all tasks if their table comes in fewer files than there are tasks."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by key for costly Python work per group.

    Adaptive execution merges small shuffle partitions by their bytes, which
    would put many cheap-to-move but slow-to-process groups in one task. A given
    number of partitions is left alone: the session's.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
