"""Anomaly scores on a stream with periodic refits on trailing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.anomaly import CONTAMINATION, SUBSAMPLE, TREES, refit_scores
from tidemark.operators.splits import refit_roles


def stream_scores(
    stream: DataFrame, cols: Sequence[str], keys: Sequence[str], sink: str, checkpoint: str, ts: str = "snapshot_id",
    budget: float = CONTAMINATION, initial: int = 1000, refit: int = 250, rolling: int = 1500,
    trees: int = TREES, sample: int = SUBSAMPLE, seed: int = 42,
) -> StreamingQuery:
    """Score each micro-batch by forests of the rows before it; equals the batch walk-forward.

    Every series (``keys``) has its own refits, which follow from the index of
    its rows: model m is fit on the ``rolling`` rows before row ``initial + m *
    refit``. A batch leaves its scores in one folder of the sink and each series'
    trailing rows with their index in another, both overwritten when a batch is
    repeated. A restart finds all it needs there; only the newest state is read.
    Rows must arrive in the order of ``ts`` within their series.
    """
    spark = stream.sparkSession
    keys = list(keys)
    columns = [*keys, ts, *cols]

    def handle(batch: DataFrame, epoch: int) -> None:
        own = Window.partitionBy(*keys).orderBy(ts)
        fresh = batch.select(columns).withColumn("row_idx", F.row_number().over(own).cast("long") - 1)
        if epoch > 0:
            past = spark.read.parquet(f"{sink}-state/batch={epoch - 1}")
            ends = past.groupBy(*keys).agg((F.max("row_idx") + 1).alias("_from"))
            fresh = fresh.join(ends, keys, "left").withColumn("row_idx", F.col("row_idx") + F.coalesce("_from", F.lit(0))).drop("_from")
            rows = past.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
        else:
            rows = fresh.withColumn("_new", F.lit(True))
        lengths = rows.groupBy(*keys).agg((F.max("row_idx") + 1).alias("_len"))
        rows = rows.join(lengths, keys)
        state = rows.filter(F.col("row_idx") >= F.col("_len") - rolling - refit).select(*columns, "row_idx")
        state.write.mode("overwrite").parquet(f"{sink}-state/batch={epoch}")
        placed = refit_roles(rows, initial, refit, rolling)
        wanted = placed.filter("role = 'score' AND _new").select(*keys, "model_id").distinct()
        placed = placed.filter("role = 'train' OR _new").join(wanted, [*keys, "model_id"])
        scored = refit_scores(placed, cols, trees, sample, seed, keys, ts, budget)
        out = batch.join(scored, [*keys, ts], "left").withColumn("model_id", F.coalesce("model_id", F.lit(-1)))
        out.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
