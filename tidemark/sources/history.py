"""Questions asked of the run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attach import attach_row


def run_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    """All runs, newest first."""
    out = history.orderBy(F.col("run_id").desc())
    return out if limit is None else out.limit(limit)


def latest_run(history: DataFrame) -> DataFrame:
    """Rows of the newest run."""
    newest = history.agg(F.max("run_id").alias("_newest"))
    return attach_row(history, newest).filter(F.col("run_id") == F.col("_newest")).drop("_newest")


def run_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the facts of their run."""
    return runs.join(results, "run_id")


def best_by_run(results: DataFrame, metric: str, name: str = "strategy", by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Best value of a metric per run and who reached it; ties go to the first name."""
    return results.groupBy(*by).agg(
        F.max(metric).alias(f"best_{metric}"), F.min_by(name, F.struct(-F.col(metric), F.col(name))).alias(f"best_{name}")
    )


def metrics_by_horizon(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("horizon")


def comparison_table(results: DataFrame, metric: str) -> DataFrame:
    """Newest run's results, best first."""
    return latest_run(results).orderBy(F.col(metric).desc())
