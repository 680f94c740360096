"""Trade bars, depth bars and candles: one map-side combined aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import SERIES, ratio
from tidemark.functions.shapes import imbalance

_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def time_bin(ts: Column, every: str) -> Column:
    """Start of the time bin: calendar truncation for one unit, else a fixed window."""
    count, unit = every.split()
    unit = unit.rstrip("s")
    if count == "1" and unit in _UNITS:
        return F.date_trunc(unit, ts.cast("timestamp"))
    return F.window(ts.cast("timestamp"), every)["start"]


def signed_quantity() -> Column:
    """A buyer who is the maker means that the seller was the aggressor."""
    return F.when(F.col("is_buyer_maker"), -F.col("quantity")).otherwise(F.col("quantity"))


def trade_measures() -> list[Column]:
    return [
        ratio(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")).alias("vwap"),
        F.sum("quantity").alias("trade_volume"),
        F.sum(signed_quantity()).alias("signed_volume"),
    ]


def trade_bars(trades: DataFrame, every: str = "1 minute", by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """VWAP, volume, signed volume and flow imbalance per series and bin.

    A series that holds most trades costs nothing extra: tasks combine their
    rows before the shuffle, which then moves one row per task, series and bin.
    """
    bars = trades.groupBy(*by, time_bin(F.col(ts), every).alias("bin")).agg(*trade_measures())
    return bars.withColumn("trade_flow_imbalance", ratio("signed_volume", "trade_volume"))


def depth_at(level: int) -> Column:
    return F.max(F.when(F.col("percentage") == level, F.col("depth")))


def depth_snapshots(depth: DataFrame, near: int = 1, far: int = 5, by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """One row per snapshot with near and far imbalance and total far depth."""
    wide = depth.groupBy(*by, ts).agg(
        depth_at(-near).alias("_bn"),
        depth_at(near).alias("_an"),
        depth_at(-far).alias("_bf"),
        depth_at(far).alias("_af"),
    )
    return wide.select(
        *by,
        ts,
        imbalance(F.col("_bn"), F.col("_an")).alias("near_depth_imbalance"),
        imbalance(F.col("_bf"), F.col("_af")).alias("far_depth_imbalance"),
        (F.col("_bf") + F.col("_af")).alias("total_depth"),
    )


DEPTH_COLUMNS = ("near_depth_imbalance", "far_depth_imbalance", "total_depth")


def depth_bars(
    depth: DataFrame, near: int = 1, far: int = 5, every: str = "1 minute",
    by: Sequence[str] = SERIES, ts: str = "ts",
) -> DataFrame:
    """The last snapshot of every bin."""
    snaps = depth_snapshots(depth, near, far, by, ts)
    return snaps.groupBy(*by, time_bin(F.col(ts), every).alias("bin")).agg(
        *[F.max_by(c, ts).alias(c) for c in DEPTH_COLUMNS]
    )


def join_bars(bars: DataFrame, book: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    return bars.join(book, [*by, "bin"], "inner")


def candles(ticks: DataFrame, every: str, value: str, size: str, order: Sequence[str], by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Open, high, low, close and volume per series and bin."""
    key = F.struct(ts, *order)
    return ticks.groupBy(*by, time_bin(F.col(ts), every).alias("ts")).agg(
        F.min_by(value, key).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, key).alias("close"),
        F.sum(size).alias("volume"),
    )


def align_panel(prices: DataFrame, how: str = "inner", series: str = "series_id", ts: str = "date") -> DataFrame:
    """``inner`` keeps only dates on which every series has a price, ``outer`` keeps all.

    The number of series and the complete dates are small aggregates; the rows
    are filtered by a semi join on the date.
    """
    if how == "outer":
        return prices
    n_series = prices.agg(F.count_distinct(series).alias("_n"))
    per_date = prices.filter(F.col("price").isNotNull()).groupBy(ts).agg(F.count_distinct(series).alias("_have"))
    complete = per_date.join(F.broadcast(n_series), F.col("_have") == F.col("_n")).select(ts)
    return prices.join(complete, ts, "left_semi")


def to_wide(prices: DataFrame, names: Sequence[str], series: str = "series_id", ts: str = "date", value: str = "price") -> DataFrame:
    """One column per listed series; the list keeps the pivot to one pass."""
    return prices.groupBy(ts).pivot(series, list(names)).agg(F.first(value))


def pair_panel(prices: DataFrame, value: str = "price", series: str = "series_id", ts: str = "date") -> DataFrame:
    """Every unordered pair of series, aligned on the date.

    This is the pairs feature itself: its size is dates times pairs of series.
    Series are gathered per date in one bounded array (one value per series),
    so a pair needs no join and rows move once.
    """
    gathered = prices.groupBy(ts).agg(
        F.array_sort(F.collect_list(F.struct(F.col(series).alias("s"), F.col(value).alias("v")))).alias("_all")
    )
    left = gathered.select(ts, "_all", F.posexplode("_all").alias("_i", "_a"))
    right = left.withColumn("_b", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))))
    return right.select(
        F.concat_ws("/", "_a.s", "_b.s").alias("pair"),
        F.col("_a.s").alias("y_id"),
        F.col("_b.s").alias("x_id"),
        F.col(ts),
        F.col("_a.v").alias("y"),
        F.col("_b.v").alias("x"),
    )
