"""The given tables shaped as trades, depth, candles, panels, books and texts.

``*_SQL`` strings are the same shapes for the SQL checks. Bar values used as
inputs of ordered computations are rounded in both, so that both start from
equal numbers whatever order the sums were taken in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.plans.registry import snapped, snapped_sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ticks(lines: DataFrame, series: str) -> DataFrame:
    return lines.select(
        F.col(series).alias("series_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("is_buyer_maker"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """One trade per order line; the part's brand is the series."""
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return _ticks(lines.join(part, lines.l_partkey == part.p_partkey), "p_brand")


TRADES_SQL = """trades AS (
  SELECT p_brand AS series_id, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_quantity AS quantity, l_returnflag = 'R' AS is_buyer_maker
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def region_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The same trades with the supplier's region as the series."""
    lines, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    homes = (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("s_suppkey", "r_name")
    )
    return _ticks(lines.join(homes, lines.l_suppkey == homes.s_suppkey), "r_name")


REGION_TRADES_SQL = """region_trades AS (
  SELECT r_name AS series_id, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_quantity AS quantity, l_returnflag = 'R' AS is_buyer_maker
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def _bars(ticks: DataFrame) -> DataFrame:
    out = B.trade_bars(ticks, "1 day")
    return out.withColumn("vwap", snapped(F.col("vwap"))).withColumn(
        "trade_flow_imbalance", snapped(F.col("trade_flow_imbalance"))
    )


def _bars_sql(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS bin,
         {snapped_sql('sum(price * quantity) / sum(quantity)')} AS vwap, sum(quantity) AS trade_volume,
         sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) AS signed_volume,
         {snapped_sql('sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) / sum(quantity)')} AS trade_flow_imbalance
  FROM {source} GROUP BY ALL)"""


def day_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(trades(spark, sf))


DAY_BARS_SQL = TRADES_SQL + ", " + _bars_sql("bars", "trades")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily price per brand: ``date, series_id, price``."""
    return day_bars(spark, sf).select("series_id", F.col("bin").alias("date"), F.col("vwap").alias("price"))


PANEL_SQL = DAY_BARS_SQL + ", panel AS (SELECT series_id, bin AS date, vwap AS price FROM bars)"


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with a base amount added, which keeps daily returns near one percent."""
    return panel(spark, sf).withColumn("price", snapped(1000 + F.col("price") / 100))


QUOTES_SQL = PANEL_SQL + f", quotes AS (SELECT series_id, date, {snapped_sql('1000 + price / 100')} AS price FROM panel)"


def region_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(region_trades(spark, sf)).select(
        "series_id", F.col("bin").alias("date"), F.col("vwap").alias("price")
    )


REGION_PANEL_SQL = (
    REGION_TRADES_SQL + ", " + _bars_sql("region_bars", "region_trades")
    + ", panel AS (SELECT series_id, bin AS date, vwap AS price FROM region_bars)"
)


def depth(spark: SparkSession, sf: str) -> DataFrame:
    """Book depth, long: every order line adds to four price distances in percent.

    The order key spreads a day's lines over its hours, so that a day has
    several snapshots; sizes of the same snapshot and distance are summed.
    """
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    joined = lines.join(part, lines.l_partkey == part.p_partkey)
    hours = F.make_dt_interval(hours=(F.col("l_orderkey") % 4).cast("int"))
    bid, ask = F.col("l_quantity"), 51 - F.col("l_quantity")
    sizes = joined.select(
        F.col("p_brand").alias("series_id"),
        (F.col("l_shipdate").cast("timestamp") + hours).alias("ts"),
        bid.alias("-5"),
        (bid * (1 - F.col("l_discount"))).alias("-1"),
        (ask * (1 - F.col("l_tax"))).alias("1"),
        ask.alias("5"),
    )
    summed = sizes.groupBy("series_id", "ts").agg(*[F.sum(f"`{p}`").alias(p) for p in ("-5", "-1", "1", "5")])
    long = summed.unpivot(["series_id", "ts"], ["-5", "-1", "1", "5"], "percentage", "depth")
    return long.withColumn("percentage", F.col("percentage").cast("int"))


DEPTH_SQL = """depth AS (
  SELECT p_brand AS series_id, l_shipdate + to_hours((l_orderkey % 4)::INT) AS ts, percentage,
         sum(CASE percentage WHEN -5 THEN l_quantity WHEN -1 THEN l_quantity * (1 - l_discount)
             WHEN 1 THEN (51 - l_quantity) * (1 - l_tax) ELSE 51 - l_quantity END) AS depth
  FROM lineitem JOIN part ON l_partkey = p_partkey, (VALUES (-5), (-1), (1), (5)) AS p(percentage) GROUP BY ALL)"""


def ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly candles per event type; the event's value is both price and size."""
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id"
    )
    out = B.candles(events, "1 hour", "value", "value", ["event_id"])
    return out.withColumn("volume", snapped(F.col("volume")))


OHLCV_SQL = f"""ohlcv AS (
  SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, {snapped_sql('sum(value)')} AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""

# The five price levels of each side of the book.
LEVELS = (0, 1, 2, 3, 4)
SIDES = ("bid", "ask")


def book_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level rows per region and day: order lines as orders at a side and level.

    The line status is the side; line numbers from 5 on share the deepest level.
    """
    lines, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    homes = (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("s_suppkey", "r_name")
    )
    cell = lines.join(homes, lines.l_suppkey == homes.s_suppkey).groupBy(
        F.col("r_name").alias("series_id"),
        F.col("l_shipdate").cast("timestamp").alias("snapshot_id"),
        F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"),
        F.least(F.col("l_linenumber") - 1, F.lit(4)).alias("level"),
    )
    counts = cell.agg(
        F.sum("l_quantity").alias("size"),
        F.count(F.lit(1)).alias("placed"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("canceled"),
        F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("executed"),
        snapped(F.avg("l_tax")).alias("price_impact"),
    )
    return complete_levels(counts)


def complete_levels(cells: DataFrame) -> DataFrame:
    """Every snapshot gets all sides and levels; the ones without orders are 0.

    A snapshot has at most ten cells. They are gathered in a map and spread
    over the full grid again, which needs no join.
    """
    cell = F.concat_ws("-", "side", "level")
    facts = F.struct("size", "placed", "canceled", "executed", "price_impact")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    empty = F.struct(none.alias("size"), zero.alias("placed"), zero.alias("canceled"), zero.alias("executed"), none.alias("price_impact"))
    snaps = cells.groupBy("series_id", "snapshot_id").agg(F.map_from_entries(F.collect_list(F.struct(cell, facts))).alias("_m"))
    grid = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(v).alias("level")) for s in SIDES for v in LEVELS])
    rows = snaps.withColumn("_c", F.explode(grid)).select("series_id", "snapshot_id", "_c.side", "_c.level", "_m")
    found = F.coalesce(F.try_element_at("_m", cell), empty)
    return rows.withColumn("_f", found).select("series_id", "snapshot_id", "side", "level", "_f.*")


BOOK_SQL = f"""cells AS (
  SELECT r_name AS series_id, l_shipdate::TIMESTAMP AS snapshot_id,
         CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
         least(l_linenumber - 1, 4)::INT AS level, sum(l_quantity) AS size, count(*) AS placed,
         count(*) FILTER (l_returnflag = 'R') AS canceled, count(*) FILTER (l_returnflag = 'A') AS executed,
         {snapped_sql('avg(l_tax)')} AS price_impact
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
grid AS (SELECT DISTINCT series_id, snapshot_id, side, level FROM (SELECT DISTINCT series_id, snapshot_id FROM cells),
  (VALUES ('bid'), ('ask')) AS s(side), (VALUES (0), (1), (2), (3), (4)) AS l(level)),
book AS (SELECT series_id, snapshot_id, side, level, coalesce(size, 0) AS size, coalesce(placed, 0) AS placed,
    coalesce(canceled, 0) AS canceled, coalesce(executed, 0) AS executed, coalesce(price_impact, 0) AS price_impact
  FROM grid LEFT JOIN cells USING (series_id, snapshot_id, side, level))"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as headlines: source is the ticker, length the volume."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("ticker"), F.col("text").alias("headline"),
        F.col("n_chars").cast("double").alias("volume"), "quality", "toxic",
    )


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``texts`` without what labels say.

    The join changes no row unless a document has several labels, and would move
    every text, so it is left out where there are none such.
    """
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").filter("doc_id IS NOT NULL").select("doc_id")
    several = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = docs if several.isEmpty() else docs.join(labels, "doc_id", "left")
    return rows.select("doc_id", F.col("source").alias("ticker"), F.col("text").alias("headline"), F.col("n_chars").cast("double").alias("volume"))


TEXTS_SQL = """texts AS (
  SELECT doc_id, source AS ticker, text AS headline, n_chars::DOUBLE AS volume, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""
