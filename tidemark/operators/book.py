"""Order-book features from long level rows ``(series_id, snapshot_id, side, level, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions.series import SERIES
from tidemark.functions.shapes import cancel_ratio, clip, imbalance
from tidemark.operators.ordering import in_blocks
from tidemark.session import materialised

SIDES = ("bid", "ask")
TOP_FEATURES = ("top_level_size_ratio", "max_cancel_ratio_across_levels", "max_size_velocity_across_levels")


def level_columns(n_levels: int = 5) -> list[str]:
    return [f"{s}_{f}_l{v}" for f in ("cancel_ratio", "size_velocity") for s in SIDES for v in range(n_levels)]


def _side(name: str, value: str) -> Column:
    return F.when(F.col("side") == name, F.col(value))


def book_totals(levels: DataFrame, by: Sequence[str] = SERIES, ts: str = "snapshot_id", means: Sequence[str] = ()) -> DataFrame:
    """Depth, imbalance, order counts and cancel-to-trade ratio per snapshot."""
    out = levels.groupBy(*by, ts).agg(
        F.sum(_side("bid", "size")).alias("total_bid_depth"),
        F.sum(_side("ask", "size")).alias("total_ask_depth"),
        F.max(F.when(F.col("level") == 0, _side("bid", "size"))).alias("bid_size"),
        F.max(F.when(F.col("level") == 0, _side("ask", "size"))).alias("ask_size"),
        F.sum("placed").alias("num_orders_placed"),
        F.sum("canceled").alias("num_orders_canceled"),
        F.sum("executed").alias("num_orders_executed"),
        *[F.avg(c).alias(c) for c in means],
    )
    return out.withColumns(
        {
            "order_book_imbalance": imbalance(F.col("total_bid_depth"), F.col("total_ask_depth")),
            "cancel_to_trade_ratio": cancel_ratio(F.col("num_orders_canceled"), F.col("num_orders_executed")),
        }
    )


def _filled(df: DataFrame, col: str, base: str, stat: str, fill: str, by: Sequence[str], ts: str, blocked: bool) -> DataFrame:
    """Warm-up gaps of ``col`` from the whole sample of ``base`` or from its past only."""
    fn = {"mean": F.avg, "std": F.stddev_samp}[stat]
    if fill == "expanding":
        return df.withColumn(col, F.coalesce(col, _usable(fn(base).over(S.up_to_now(by, ts)), stat)))
    if not blocked:
        return df.withColumn(col, F.coalesce(col, _usable(fn(base).over(Window.partitionBy(*by)), stat)))
    whole = df.groupBy(*by).agg(_usable(fn(base), stat).alias("_whole"))
    return df.join(whole, list(by)).withColumn(col, F.coalesce(col, "_whole")).drop("_whole")


def _usable(value: Column, stat: str) -> Column:
    """A deviation that is missing or 0 counts as 1."""
    if stat != "std":
        return value
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, 1.0).otherwise(value)


def _maybe_blocks(df: DataFrame, step, lookback: int, by: Sequence[str], ts: str, block_rows: int | None) -> DataFrame:
    if block_rows is None:
        return step(df, list(by))
    # Numbering, blocks and the whole-sample fill all read the rows: store both ends.
    ready = materialised(df, "book")
    return materialised(in_blocks(ready, step, lookback=lookback, by=by, ts=ts, block_rows=block_rows), "book-blocks")


def size_velocity(
    levels: DataFrame, n: int = 10, min_samples: int = 5, fill: str = "global",
    by: Sequence[str] = SERIES, ts: str = "snapshot_id", block_rows: int | None = None,
) -> DataFrame:
    """Size change of a level against the trailing deviation of its own changes."""
    keys = [*by, "side", "level"]

    def step(df: DataFrame, k: list[str]) -> DataFrame:
        change = F.col("size") - F.lag("size").over(S.ordered(k, ts))
        df = df.withColumn("_delta", F.coalesce(change, F.lit(0.0)))
        return df.withColumn("_std", S.rolling("_delta", "std", n, min_samples, by=k, ts=ts))

    out = _maybe_blocks(levels, step, n + 1, keys, ts, block_rows)
    out = _filled(out, "_std", "_delta", "std", fill, keys, ts, block_rows is not None)
    return out.withColumn("size_velocity", F.col("_delta") / clip(F.col("_std"), lower=1e-6)).drop("_delta", "_std")


def book_features(
    levels: DataFrame, window: int = 50, velocity: int = 10, fill: str = "global", n_levels: int = 5,
    by: Sequence[str] = SERIES, ts: str = "snapshot_id", block_rows: int | None = None,
) -> DataFrame:
    """Top-size ratio, cancel ratios and size velocities per snapshot.

    ``fill="global"`` fills warm-up rows from the whole sample, which a live
    system could not do; ``"expanding"`` uses only what came before. Long
    histories are cut in blocks with ``block_rows``.
    """
    rows = size_velocity(levels, velocity, fill=fill, by=by, ts=ts, block_rows=block_rows)
    rows = rows.withColumn("cancel_ratio", cancel_ratio(F.col("canceled"), F.col("executed")))

    def cell(value: str, side: str, level: int) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("level") == level), F.col(value)))

    snaps = rows.groupBy(*by, ts).agg(
        F.max(F.when(F.col("level") == 0, F.col("size"))).alias("top_size"),
        *[cell(f, s, v).alias(f"{s}_{f}_l{v}") for f in ("cancel_ratio", "size_velocity") for s in SIDES for v in range(n_levels)],
        F.max("cancel_ratio").alias("max_cancel_ratio_across_levels"),
        F.max(F.abs("size_velocity")).alias("max_size_velocity_across_levels"),
    )

    def step(df: DataFrame, k: list[str]) -> DataFrame:
        return df.withColumn("rolling_avg_size", S.rolling("top_size", "mean", window, 10, by=k, ts=ts))

    snaps = _maybe_blocks(snaps, step, window, by, ts, block_rows)
    snaps = _filled(snaps, "rolling_avg_size", "top_size", "mean", fill, by, ts, block_rows is not None)
    return snaps.withColumn("top_level_size_ratio", S.ratio("top_size", "rolling_avg_size"))
