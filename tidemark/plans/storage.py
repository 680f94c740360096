"""Queries that write derived market files and tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.bars import align_panel
from tidemark.plans import views as V
from tidemark.plans.registry import big, day, num, nums, query, shown
from tidemark.sources import history as H
from tidemark.sources import readers as R
from tidemark.sources import writers as Wr
from tidemark.session import work_path

KLINE_SQL = f"""{V.OHLCV_SQL}, kl AS (SELECT series_id, ts, date_trunc('day', ts)::TIMESTAMP AS d, open, high, low, close, volume FROM ohlcv)"""


def write_klines(spark, sf):
    """Candles as header-less archive files, one folder entry per series; signups use microseconds."""
    path = work_path(spark, "klines")
    rows = V.ohlcv(spark, sf)
    micros = F.unix_micros("ts")
    stamp = F.when(F.col("series_id") == "signup", micros).otherwise((micros / 1000).cast("long"))
    zero = F.lit(0)
    rows.select(
        "series_id", stamp.alias("open_time"), "open", "high", "low", "close", "volume", stamp.alias("close_time"),
        F.lit(0.0).alias("quote_volume"), zero.alias("n_trades"), F.lit(0.0).alias("taker_base"), F.lit(0.0).alias("taker_quote"), F.lit("0").alias("unused"),
    ).write.partitionBy("series_id").option("header", False).csv(path)
    return path


def klines(spark, sf):
    owner = F.regexp_extract(F.col("_metadata.file_path"), "series_id=([^/]+)/", 1)
    return R.read_klines_archive(spark, f"{write_klines(spark, sf)}/*", series=owner)


@query("archived_candles", f"""WITH {KLINE_SQL} SELECT series_id, {day('ts', 'ts')}, {day('d', 'date')}, {nums('open high low close volume')} FROM kl""")
def archived_candles(spark, sf):
    """Positional candle archives with two epoch units."""
    return shown(klines(spark, sf).withColumn("date", F.col("date").cast("timestamp")).drop("open_time", "src"))


@query("stitched_candles", f"""WITH {KLINE_SQL}
SELECT series_id, {day('d', 'date')}, {day('max(ts)', 'ts')}, {num('arg_max(close, ts)', 'close')} FROM kl GROUP BY series_id, d""")
def stitched_candles(spark, sf):
    """One candle per series and day: the last one wins."""
    rows = klines(spark, sf).withColumn("src", F.lit("archive"))
    out = R.stitch_and_dedup(rows.unionByName(rows.withColumn("src", F.lit("a-copy"))))
    return shown(out.select("series_id", F.col("date").cast("timestamp").alias("date"), "ts", "close"))


@query("candle_files", f"""WITH {V.OHLCV_SQL} SELECT series_id, {day('ts', 'ts')}, {nums('open high low close volume')} FROM ohlcv""")
def candle_files(spark, sf):
    """Candles written as CSV with a header and read with a fixed schema."""
    path = work_path(spark, "candles")
    rows = V.ohlcv(spark, sf).select(F.col("ts").alias("timestamp"), F.col("series_id").alias("symbol"), "open", "high", "low", "close", "volume")
    Wr.write_report(rows, path, "csv")
    return shown(R.read_ohlcv(spark, path))


TICK_SQL = """tick AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms, value AS price, (props->>'k')::DOUBLE AS quantity, user_id % 2 = 0 AS is_buyer_maker FROM events)"""


@query("tick_files", f"""WITH {TICK_SQL} SELECT event_id AS agg_trade_id, {day('make_timestamp(ms * 1000)', 'ts')}, {nums('price quantity')}, is_buyer_maker FROM tick""")
def tick_files(spark, sf):
    """Aggregated trades in several CSV files, read in one scan."""
    path = work_path(spark, "ticks")
    events = V.table(spark, sf, "events")
    size = F.get_json_object("props", "$.k").cast("double")
    rows = events.select(
        F.col("event_id").alias("agg_trade_id"), F.col("value").alias("price"), size.alias("quantity"), F.col("event_id").alias("first_trade_id"),
        F.col("event_id").alias("last_trade_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("transact_time"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )
    Wr.write_report(rows.repartition(4, "agg_trade_id"), path, "csv")
    out = R.read_agg_trades(spark, path)
    return shown(out.select("agg_trade_id", "ts", "price", "quantity", "is_buyer_maker"))


@query("depth_files", f"""WITH {V.DEPTH_SQL} SELECT {big('percentage')}, {big('count(*)', 'n_rows')}, {num('sum(depth)', 'depth', 3)} FROM depth GROUP BY percentage""")
def depth_files(spark, sf):
    """Book depth in several CSV files, read in one scan."""
    path = work_path(spark, "depth")
    rows = V.depth(spark, sf).select(F.col("ts").alias("timestamp"), "percentage", "depth", F.lit(0.0).alias("notional"))
    Wr.write_report(rows, path, "csv")
    out = R.read_depth(spark, path)
    return shown(out.groupBy("percentage").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("depth").alias("depth")), 3)


@query("headline_files", f"""SELECT source AS ticker, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS true_label, {big('count(*)', 'n_rows')}, {big('sum(length(text))', 'n_chars')}
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def headline_files(spark, sf):
    """Texts with quotes and line breaks through CSV and back."""
    path = work_path(spark, "headlines")
    rows = V.texts(spark, sf).select(
        F.lit("2024-01-01").cast("date").alias("date"), "ticker", F.col("headline"),
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("true_label"), "volume",
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = R.read_headlines(spark, path)
    return shown(out.groupBy("ticker", "true_label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("headline")).alias("n_chars")))


def recorded_runs(spark, sf):
    """Three runs of per-strategy results in an append-only history."""
    table = work_path(spark, "runs")
    lines = V.table(spark, sf, "lineitem")
    for bonus in (0, 1, 2):
        rows = lines.groupBy(F.col("l_returnflag").alias("strategy")).agg(F.round(F.avg(F.col("l_discount")) * (1 + bonus) + F.avg("l_tax"), 6).alias("sharpe"))
        Wr.append_run(rows, table)
    return spark.read.parquet(table)


RUN_SQL = """run AS (SELECT k + 1 AS run_id, l_returnflag AS strategy, round(avg(l_discount) * (1 + k) + avg(l_tax), 6) AS sharpe FROM lineitem, range(3) AS r(k) GROUP BY k, l_returnflag)"""


@query("run_history", f"WITH {RUN_SQL} SELECT {big('run_id')}, strategy, {num('sharpe', digits=5)} FROM run")
def run_history(spark, sf):
    return shown(H.run_history(recorded_runs(spark, sf)).select("run_id", "strategy", "sharpe"), 5)


@query("latest_run", f"WITH {RUN_SQL} SELECT {big('run_id')}, strategy, {num('sharpe', digits=5)} FROM run WHERE run_id = (SELECT max(run_id) FROM run)")
def latest_run(spark, sf):
    return shown(H.comparison_table(recorded_runs(spark, sf), "sharpe").select("run_id", "strategy", "sharpe"), 5)


@query("best_by_run", f"""WITH {RUN_SQL} SELECT {big('run_id')}, {num('max(sharpe)', 'best_sharpe', 5)}, arg_max(strategy, sharpe) AS best_strategy, {big('3', 'n_strategies')} FROM run GROUP BY run_id""")
def best_by_run(spark, sf):
    """Best strategy per run, joined with the facts of the run."""
    rows = recorded_runs(spark, sf)
    facts = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_strategies"))
    return shown(H.run_results(facts, H.best_by_run(rows, "sharpe")).select("run_id", "best_sharpe", "best_strategy", "n_strategies"), 5)


@query("horizon_upsert", f"""SELECT {big('h', 'horizon')}, {num("CASE WHEN h = 5 THEN avg(l_tax) ELSE avg(l_discount) END", 'rmse', 5)} FROM lineitem, (VALUES (1), (5), (15)) AS v(h) GROUP BY h""")
def horizon_upsert(spark, sf):
    """Horizon metrics of which one key is replaced, the others kept."""
    table = work_path(spark, "horizons")
    means = V.table(spark, sf, "lineitem").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    first = means.select(F.explode(F.array(F.lit(1), F.lit(5), F.lit(15))).alias("horizon"), F.col("a").alias("rmse"))
    Wr.upsert_by_key(first, table, ["horizon"])
    Wr.upsert_by_key(means.select(F.lit(5).alias("horizon"), F.col("b").alias("rmse")), table, ["horizon"])
    return shown(H.metrics_by_horizon(spark.read.parquet(table)), 5)


@query("replaced_table", f"SELECT {big('l_linenumber')}, {big('count(*)', 'n_rows')} FROM lineitem GROUP BY l_linenumber")
def replaced_table(spark, sf):
    """A table written twice keeps only the second content."""
    table = work_path(spark, "summary")
    lines = V.table(spark, sf, "lineitem")
    Wr.replace_table(lines.select("l_linenumber", F.lit(0).cast("long").alias("n_rows")), table)
    Wr.replace_table(lines.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_rows")), table)
    return shown(spark.read.parquet(table))


@query("json_reports", f"""SELECT l_returnflag, {big('count(*)', 'n_rows')}, {num('avg(l_quantity)', 'mean_quantity', 4)} FROM lineitem GROUP BY l_returnflag""")
def json_reports(spark, sf):
    """Metric documents as JSON text, parsed back with a schema."""
    rows = V.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("l_quantity").alias("mean_quantity"))
    path = work_path(spark, "reports")
    Wr.write_report(Wr.to_json_report(rows), path, "parquet")
    back = spark.read.parquet(path).select(F.from_json("report", "l_returnflag string, n_rows bigint, mean_quantity double").alias("r"))
    return shown(back.select("r.*"), 4)


@query("aligned_dates", f"""WITH {V.REGION_PANEL_SQL}, d AS (SELECT date, count(*) AS n FROM panel GROUP BY date)
SELECT 'inner' AS how, {big('count(*)', 'n_rows')} FROM panel JOIN d USING (date) WHERE n = 5 UNION ALL SELECT 'outer', {big('count(*)', 'n_rows')} FROM panel""")
def aligned_dates(spark, sf):
    panel = V.region_panel(spark, sf)
    parts = [align_panel(panel, how).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("how", F.lit(how)) for how in ("inner", "outer")]
    return shown(parts[0].unionByName(parts[1]))
