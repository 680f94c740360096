"""Windowed bars, joins and duplicate removal on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tidemark.functions.series import SERIES, ratio
from tidemark.functions.shapes import imbalance
from tidemark.operators.bars import trade_measures


def with_event_time(stream: DataFrame, watermark: str, ts: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP (a watermark needs that type) with a lateness bound."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_trade_bars(stream: DataFrame, every: str = "1 minute", watermark: str = "10 minutes", by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Tumbling trade bars, each emitted once the watermark has passed its end."""
    timed = with_event_time(stream, watermark, ts)
    bars = timed.groupBy(*by, F.window(ts, every)).agg(*trade_measures())
    return bars.withColumn("trade_flow_imbalance", ratio("signed_volume", "trade_volume"))


def stream_depth_bars(
    stream: DataFrame, near: int = 1, far: int = 5, every: str = "1 minute", watermark: str = "10 minutes",
    by: Sequence[str] = SERIES, ts: str = "ts",
) -> DataFrame:
    """The last snapshot of every window; a distance it does not hold is null."""
    timed = with_event_time(stream, watermark, ts)

    def newest(pct: int) -> Column:
        return F.max(F.when(F.col("percentage") == pct, F.struct(F.col(ts).alias("at"), "depth")))

    names = {"bn": -near, "an": near, "bf": -far, "af": far}
    wide = timed.groupBy(*by, F.window(ts, every)).agg(F.max(ts).alias("last"), *[newest(pct).alias(n) for n, pct in names.items()])
    wide = wide.withColumns({n: F.when(F.col(f"{n}.at") == F.col("last"), F.col(f"{n}.depth")) for n in names})
    return wide.select(
        *by, "window",
        imbalance(F.col("bn"), F.col("an")).alias("near_depth_imbalance"),
        imbalance(F.col("bf"), F.col("af")).alias("far_depth_imbalance"),
        (F.col("bf") + F.col("af")).alias("total_depth"),
    )


def stream_join(bars: DataFrame, book: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Inner join of two windowed streams on series and window."""
    return bars.join(book, [*by, "window"], "inner")


def stream_dedup(stream: DataFrame, keys: Sequence[str], watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Drop copies that arrive within the watermark; state is kept only that long."""
    return with_event_time(stream, watermark, ts).dropDuplicatesWithinWatermark(list(keys))


def flat_window(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bin", F.col("window.start")).drop("window")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all input that is there now into a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Groups of rows dropped because they came after the watermark; Spark counts them after its partial sums."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def count_late_rows(
    stream: DataFrame, path: str, checkpoint: str, every: str = "1 minute", watermark: str = "10 minutes", by: Sequence[str] = SERIES, ts: str = "ts",
) -> StreamingQuery:
    """Keep a table of how many rows of each batch came too late for their window: (by, batch_id, n_rows, n_late, newest).

    The watermark of a batch is the newest time of all batches before it less the
    bound on lateness, which the table itself gives; a row is late if its window
    ends by then. That is what a windowed aggregate with the same bound and
    batches drops. Each batch is a partition of the table, written anew if the
    batch is run again.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.parquet(path).filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        except AnalysisException:
            before = None
        end = F.window(ts, every)["end"]
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        late = F.coalesce(end <= mark, F.lit(False))
        counts = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(late, 1)).alias("n_late"), F.max(ts).alias("newest"))
        counts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).select(*by, ts)
    query = timed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
