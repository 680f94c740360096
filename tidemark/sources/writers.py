"""Reports and append-only run history as Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result as CSV with header, JSON lines or Parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def to_json_report(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


def _created(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not be there yet; False if it is. Atomic among all writers."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(at)
    fs.mkdirs(full.getParent())
    try:
        if full.toUri().getScheme() == "file":
            # Hadoop's local file system looks first and creates then; the system's own call does both at once.
            open(full.toUri().getPath(), "x").close()
        else:
            fs.create(full, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def next_run_id(spark: SparkSession, table: str) -> int:
    """Largest recorded run number plus one; 1 for a new table."""
    try:
        rows = spark.read.parquet(table)
    except AnalysisException:
        return 1
    return int(rows.agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]) + 1


def reserve_run_id(spark: SparkSession, table: str) -> int:
    """A run number that no other writer of this history has or will get.

    The number is taken by creating a marker file for it below the history, which
    only one writer can; readers do not see the markers. A run that fails leaves
    its number unused.
    """
    number = next_run_id(spark, table)
    while not _created(spark, f"{table}/_run_ids/{number:012d}"):
        number += 1
    return number


def append_run(df: DataFrame, table: str, run_id: int | str | None = None) -> int | str:
    """Add rows to a history under a run id and the UTC time of the run.

    The id is the next number, reserved so that writers at the same time get
    different ones, a given id, or a random one for ``"uuid"``. Each run is a
    partition of its own: reading one run reads only its files.
    """
    if run_id is None:
        run_id = reserve_run_id(df.sparkSession, table)
    elif run_id == "uuid":
        run_id = uuid.uuid4().hex
    stamped = df.withColumn("run_at", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    # Writers of one folder share its staging area; each run's own folder keeps them apart.
    stamped.write.mode("append").parquet(f"{table}/run_id={quote(str(run_id), safe=' ')}")
    return run_id


def upsert_by_key(df: DataFrame, table: str, keys: Sequence[str]) -> None:
    """Replace the rows of the keys that occur in ``df``, leave all others.

    The keys are the partition columns, so only their folders are rewritten.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(table)


def replace_table(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").parquet(table)
