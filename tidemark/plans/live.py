"""Streaming queries: given tables read as streams until all input is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.attach import attach_row
from tidemark.plans import views as V
from tidemark.plans.pairs import KALMAN_SQL, region_pairs
from tidemark.plans.registry import big, day, num, nums, query, shown
from tidemark.plans.series import BAND_SQL
from tidemark.plans.surveillance import FOREST_COLS, TS, scored
from tidemark.session import materialised, work_path
from tidemark.streaming import bars as Sb
from tidemark.streaming.anomaly import stream_scores
from tidemark.streaming.pairs import stream_kalman, stream_positions


def event_stream(spark, sf):
    """The events table as a stream of ticks."""
    schema = V.table(spark, sf, "events").schema
    return as_ticks(spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet"))


def as_ticks(raw):
    return raw.select(
        F.col("event_type").alias("series_id"), "ts", F.col("value").alias("price"), "event_id",
        F.get_json_object("props", "$.k").cast("double").alias("quantity"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


def depth_stream(spark, sf):
    """Every event as a depth snapshot with four price distances."""
    ticks = event_stream(spark, sf)
    p, q = F.col("price"), F.col("quantity") + 1
    levels = F.array(*[F.struct(F.lit(k).alias("percentage"), v.alias("depth")) for k, v in ((-5, p + q), (-1, p), (1, q), (5, q * 2))])
    return ticks.select("series_id", "ts", F.explode(levels).alias("l")).select("series_id", "ts", "l.percentage", "l.depth")


def stored(spark, stream, name):
    path, checkpoint = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    Sb.run_available(stream, path, checkpoint)
    return spark.read.parquet(path)


TICK_SQL = """tick AS (SELECT event_id, event_type AS series_id, ts, value AS price, (props->>'k')::DOUBLE AS quantity, user_id % 2 = 0 AS is_buyer_maker FROM events),
done AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)"""
BARS_SQL = """sbars AS (SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS bin, sum(price * quantity) / nullif(sum(quantity), 0) AS vwap, sum(quantity) AS trade_volume,
  sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) AS signed_volume FROM tick GROUP BY ALL)"""
BOOK_SQL = """sbook AS (SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS bin, arg_max(price, ts) AS p, arg_max(quantity + 1, ts) AS q FROM tick GROUP BY ALL)"""
CLOSED = "bin + INTERVAL 1 HOUR <= (SELECT mark FROM done)"


@query("streamed_trade_bars", f"""WITH {TICK_SQL}, {BARS_SQL}
SELECT series_id, {day('bin', 'bin')}, {nums('vwap trade_volume signed_volume')}, {num('signed_volume / nullif(trade_volume, 0)', 'trade_flow_imbalance')} FROM sbars WHERE {CLOSED}""")
def streamed_trade_bars(spark, sf):
    """Hourly bars, emitted when the watermark passes their end."""
    bars = Sb.flat_window(Sb.stream_trade_bars(event_stream(spark, sf), "1 hour"))
    return shown(stored(spark, bars, "stream-bars"))


@query("streamed_late_trades", f"""WITH {TICK_SQL}, {BARS_SQL},
late AS (SELECT series_id, count(*) AS n FROM tick WHERE ts < (SELECT min(ts) FROM tick) + INTERVAL 1 DAY
  AND date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT mark FROM done) GROUP BY series_id)
SELECT series_id, {day('bin', 'bin')}, {nums('vwap trade_volume signed_volume')}, {num('signed_volume / nullif(trade_volume, 0)', 'trade_flow_imbalance')}, coalesce(n, 0)::BIGINT AS n_late
FROM sbars LEFT JOIN late USING (series_id) WHERE {CLOSED}""")
def streamed_late_trades(spark, sf):
    """All ticks, then those of the first day once more: too late to change any bar, and counted per series."""
    ticks = as_ticks(V.table(spark, sf, "events"))
    folder, out, checkpoint, counts, counted = (work_path(spark, n) for n in ("late-ticks", "late-bars", "late-checkpoint", "late-counts", "late-counted"))
    ticks.write.parquet(folder)
    stream = spark.readStream.schema(ticks.schema).parquet(folder)
    bars = Sb.flat_window(Sb.stream_trade_bars(stream, "1 hour"))
    first = ticks.agg(F.min("ts").alias("start"))
    for again in (False, True):
        if again:
            attach_row(ticks, first).filter("ts < start + INTERVAL 1 DAY").drop("start").write.mode("append").parquet(folder)
        Sb.run_available(bars, out, checkpoint)
        Sb.count_late_rows(stream, counts, counted, "1 hour")
    late = spark.read.parquet(counts).groupBy("series_id").agg(F.sum("n_late").alias("n_late"))
    return shown(spark.read.parquet(out).join(late, "series_id"))


@query("streamed_depth_bars", f"""WITH {TICK_SQL}, {BOOK_SQL}
SELECT series_id, {day('bin', 'bin')}, {num('(p - q) / nullif(p + q, 0)', 'near_depth_imbalance')}, {num('(p + q - q * 2) / (p + q + q * 2)', 'far_depth_imbalance')}, {num('p + q + q * 2', 'total_depth')} FROM sbook WHERE {CLOSED}""")
def streamed_depth_bars(spark, sf):
    bars = Sb.flat_window(Sb.stream_depth_bars(depth_stream(spark, sf), every="1 hour"))
    return shown(stored(spark, bars, "stream-depth"))


@query("streamed_bars_with_book", f"""WITH {TICK_SQL}, {BARS_SQL}, {BOOK_SQL}
SELECT series_id, {day('bin', 'bin')}, {nums('vwap trade_volume')}, {num('(p - q) / nullif(p + q, 0)', 'near_depth_imbalance')} FROM sbars JOIN sbook USING (series_id, bin) WHERE {CLOSED}""")
def streamed_bars_with_book(spark, sf):
    """Two windowed streams joined on series and window."""
    joined = Sb.stream_join(Sb.stream_trade_bars(event_stream(spark, sf), "1 hour"), Sb.stream_depth_bars(depth_stream(spark, sf), every="1 hour"))
    rows = stored(spark, Sb.flat_window(joined), "stream-joined")
    return shown(rows.select("series_id", "bin", "vwap", "trade_volume", "near_depth_imbalance"))


@query("streamed_unique_ticks", f"""WITH {TICK_SQL} SELECT series_id, {big('count(*)', 'n_rows')}, {big('sum(quantity)', 'quantity')} FROM tick GROUP BY series_id""")
def streamed_unique_ticks(spark, sf):
    """Every tick arrives twice and is kept once."""
    ticks = event_stream(spark, sf)
    twice = ticks.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    kept = stored(spark, Sb.stream_dedup(twice, ["event_id"]), "stream-unique")
    return shown(kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").cast("long").alias("quantity")))


def in_time_order(spark, rows, ts, by, name, ranges=8, tasks=4):
    """Rows as a stream of files in time order, each range of time written by several tasks.

    Files are read in the order of their modification time, so ranges are written
    one after the other. Within a range a key's rows are in one file, in order,
    so that triggers may end anywhere between files.
    """
    path = work_path(spark, name)
    ranged = materialised(rows.repartitionByRange(ranges, ts).withColumn("_part", F.spark_partition_id()), name)
    for part in range(ranges):
        ranged.filter(F.col("_part") == part).drop("_part").repartition(tasks, by).sortWithinPartitions(ts).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).parquet(path)


def pair_stream(spark, sf):
    """Region pairs as a stream, a few files for each trigger."""
    rows = region_pairs(spark, sf).select("pair", "date", "y", "x")
    return in_time_order(spark, rows, "date", "pair", "pair-files")


@query("streamed_kalman", f"""WITH RECURSIVE {KALMAN_SQL}
SELECT pair, {day('date', 'date')}, {nums('alpha beta spread innovation_variance')}, {num('z', 'zscore')} FROM filtered""")
def streamed_kalman(spark, sf):
    """The online filter gives the batch filter's rows."""
    rows = stored(spark, stream_kalman(pair_stream(spark, sf)), "stream-kalman")
    return shown(rows.drop("y", "x"))


@query("streamed_positions", f"""WITH RECURSIVE {KALMAN_SQL}, {BAND_SQL.format(name='band', key='pair', ts='date', src='filtered')}
SELECT pair, {day('date', 'date')}, {big('pos', 'position')} FROM band""")
def streamed_positions(spark, sf):
    """Band positions from a stream of filtered scores."""
    first = work_path(spark, "stream-filtered")
    Sb.run_available(stream_kalman(pair_stream(spark, sf)), first, work_path(spark, "stream-filtered-checkpoint"))
    schema = spark.read.parquet(first).schema
    rows = stored(spark, stream_positions(spark.readStream.schema(schema).parquet(first)), "stream-positions")
    return shown(rows.select("pair", "date", "position"))


@query("streamed_alerts")
def streamed_alerts(spark, sf):
    """Snapshots scored as they arrive by forests refit on stored rows."""
    sink = work_path(spark, "alerts")
    rows = scored(spark, sf).select("series_id", TS, *FOREST_COLS)
    stream = in_time_order(spark, rows, TS, "series_id", "snapshots")
    stream_scores(stream, FOREST_COLS, ["series_id"], sink, work_path(spark, "alerts-checkpoint"))
    return shown(spark.read.parquet(sink).select("series_id", TS, "anomaly_score", "alert", "model_id"))
