"""Feature tables and labels for bars, all on one partitioning per table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions import shapes
from tidemark.functions.series import SERIES
from tidemark.operators.ordering import ewm_mean
from tidemark.operators.quantiles import quantile_table
from tidemark.operators.attach import attach_row

# Names of the feature columns, which must match the published tables.
CANDLE_FEATURES = (
    "ret_1", "ret_3", "ret_6", "vol_10", "vol_20", "rsi_14", "sma_ratio_10", "sma_ratio_20",
    "ema_ratio_12", "volume_zscore", "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "momentum_streak",
)

IMPACT_FEATURES = (
    "trade_flow_imbalance", "ofi_roll5", "ofi_roll15", "near_depth_imbalance", "far_depth_imbalance",
    "total_depth", "trade_volume", "volume_roll5", "realized_vol_roll15", "lag_return_1", "lag_return_5",
)


def ohlcv_features(bars: DataFrame, by: Sequence[str] = SERIES, ts: str = "ts", dropna: bool = True) -> DataFrame:
    """Fourteen trailing candle features and the direction of the next candle.

    Every window shares one partitioning, so the bars move once; run it under
    ``in_blocks(lookback=320, lookahead=1)`` for series too long for one task.
    """
    k = {"by": by, "ts": ts}
    out = bars.withColumn("ret_1", S.log_return("close", 1, **k))
    out = out.withColumns(
        {
            "ret_3": S.log_return("close", 3, **k),
            "ret_6": S.log_return("close", 6, **k),
            "vol_10": S.rolling("ret_1", "std", 10, **k),
            "vol_20": S.rolling("ret_1", "std", 20, **k),
            "rsi_14": S.rsi_sma("ret_1", 14, **k),
            "sma_ratio_10": S.sma_ratio("close", 10, **k),
            "sma_ratio_20": S.sma_ratio("close", 20, **k),
            "volume_zscore": S.volume_zscore("volume", 20, **k),
            "body_ratio": shapes.body_ratio(),
            "upper_wick_ratio": shapes.upper_wick_ratio(),
            "lower_wick_ratio": shapes.lower_wick_ratio(),
            "momentum_streak": S.streak("ret_1", 5, **k),
            "label_next_bullish": (
                F.lead("close").over(S.ordered(**k)) > F.lead("open").over(S.ordered(**k))
            ).cast("int"),
        }
    )
    out = ewm_mean(out, "close", "_ema", span=12, by=by, ts=ts)
    out = out.withColumn("ema_ratio_12", S.ratio("close", "_ema") - 1).drop("_ema")
    return out.na.drop(subset=[*CANDLE_FEATURES, "label_next_bullish"]) if dropna else out


def deadzone_label(features: DataFrame, mult: float = 0.3, by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """0 down, 1 neutral, 2 up by the forward log return against ``mult`` volatilities."""
    out = features.withColumn("fwd_log_ret", S.forward_return("close", 1, by=by, ts=ts))
    limit = mult * F.col("vol_20")
    label = F.when(F.col("fwd_log_ret") > limit, 2).when(F.col("fwd_log_ret") < -limit, 0).otherwise(1)
    return out.withColumn("label_direction", label).na.drop(subset=["fwd_log_ret", "vol_20"])


def impact_features(
    bars: DataFrame, horizons: Sequence[int] = (1, 5, 15), by: Sequence[str] = SERIES, ts: str = "bin",
    dropna: bool = True,
) -> DataFrame:
    """Flow, book and volatility features with forward VWAP returns as targets."""
    k = {"by": by, "ts": ts}
    out = bars.withColumn("log_return", S.log_return("vwap", 1, **k))
    out = out.withColumns(
        {
            "ofi_roll5": S.rolling("trade_flow_imbalance", "mean", 5, **k),
            "ofi_roll15": S.rolling("trade_flow_imbalance", "mean", 15, **k),
            "volume_roll5": S.rolling("trade_volume", "mean", 5, **k),
            "realized_vol_roll15": S.rolling("log_return", "std", 15, **k),
            "lag_return_1": F.lag("log_return", 1).over(S.ordered(**k)),
            "lag_return_5": F.lag("log_return", 5).over(S.ordered(**k)),
            **{f"future_return_{h}": S.forward_return("vwap", h, **k) for h in horizons},
        }
    )
    targets = [f"future_return_{h}" for h in horizons]
    return out.na.drop(subset=[*IMPACT_FEATURES, *targets]) if dropna else out


def lagged_columns(windows: Sequence[int] = (3, 5, 10, 20), lags: Sequence[int] = (1, 2, 3)) -> list[str]:
    return [f"{p}_{w}d" for w in windows for p in ("mom", "vol")] + [f"lag_return_{i}" for i in lags]


def lagged_features(
    prices: DataFrame, windows: Sequence[int] = (3, 5, 10, 20), lags: Sequence[int] = (1, 2, 3),
    by: Sequence[str] = SERIES, ts: str = "date", dropna: bool = True,
) -> DataFrame:
    """Predictors for day t from returns known before day t; the label is day t's direction."""
    k = {"by": by, "ts": ts}
    out = prices.withColumn("return", S.log_return("price", 1, **k))
    out = out.withColumns({f"lag_return_{i}": F.lag("return", i).over(S.ordered(**k)) for i in {*lags, 1}})
    new: dict[str, Column] = {}
    for w in windows:
        new[f"mom_{w}d"] = S.rolling("lag_return_1", "mean", w, **k)
        new[f"vol_{w}d"] = S.rolling("lag_return_1", "std", w, **k)
    new["label_up"] = F.coalesce(F.col("return") > 0, F.lit(False)).cast("int")
    out = out.withColumns(new)
    return out.na.drop(subset=lagged_columns(windows, lags)) if dropna else out


def fill_missing(df: DataFrame, col: str, with_: str | float, by: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with a constant or the full-sample ``mean``, ``std`` or ``median``, of all rows or of the row's group.

    Means and deviations are combined before the shuffle, medians found by
    sketches and counts, so no task holds a group; the statistics are joined back.
    """
    if not isinstance(with_, str):
        return df.fillna({col: with_})
    if with_ == "median":
        stats = quantile_table(df, {col: [0.5]}, by).select(*by, F.col("value").alias("_fill"))
    else:
        stat = {"mean": F.avg(col), "std": F.stddev_samp(col)}[with_].alias("_fill")
        stats = df.groupBy(*by).agg(stat)
    if not by:
        filled = attach_row(df, stats.agg(F.max("_fill").alias("_fill")))
    else:
        stats = stats.select(*[F.col(b).alias(f"_to_{b}") for b in by], "_fill")
        same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_to_{b}")) for b in by])
        filled = df.join(stats, same, "left").drop(*[f"_to_{b}" for b in by])
    return filled.withColumn(col, F.coalesce(col, "_fill")).drop("_fill")
