"""Technical signals: 1 is long, 0 is flat, decided from yesterday's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions.series import SERIES
from tidemark.operators.ordering import ewm_mean


def _flag(condition: Column) -> Column:
    """A comparison with a missing value is no signal."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sma_crossover(df: DataFrame, fast: int = 10, slow: int = 50, out: str = "signal_sma_crossover", by: Sequence[str] = SERIES, ts: str = "date") -> DataFrame:
    k = {"by": by, "ts": ts}
    means = df.withColumns({"_fast": S.rolling("price", "mean", fast, **k), "_slow": S.rolling("price", "mean", slow, **k)})
    w = S.ordered(**k)
    return means.withColumn(out, _flag(F.lag("_fast").over(w) > F.lag("_slow").over(w))).drop("_fast", "_slow")


def rsi_wilder(df: DataFrame, n: int = 14, out: str = "rsi", col: str = "price", by: Sequence[str] = SERIES, ts: str = "date") -> DataFrame:
    """Relative strength on exponentially smoothed price changes; null while losses are 0."""
    delta = F.col(col) - F.lag(col).over(S.ordered(by, ts))
    df = df.withColumn("_delta", delta).withColumns(
        {
            "_up": F.when(F.col("_delta").isNotNull(), F.greatest("_delta", F.lit(0.0))),
            "_down": F.when(F.col("_delta").isNotNull(), -F.least("_delta", F.lit(0.0))),
        }
    )
    for x in ("_up", "_down"):
        df = ewm_mean(df, x, f"{x}_avg", alpha=1.0 / n, adjust=False, min_periods=n, by=by, ts=ts)
    strength = F.col("_up_avg") / F.nullif(F.col("_down_avg"), F.lit(0.0))
    return df.withColumn(out, 100 - 100 / (1 + strength)).drop("_delta", "_up", "_down", "_up_avg", "_down_avg")


def rsi_reversion(df: DataFrame, n: int = 14, oversold: float = 30.0, out: str = "signal_rsi_mean_reversion", by: Sequence[str] = SERIES, ts: str = "date") -> DataFrame:
    scored = rsi_wilder(df, n, "_rsi", by=by, ts=ts)
    return scored.withColumn(out, _flag(F.lag("_rsi").over(S.ordered(by, ts)) < oversold)).drop("_rsi")


def momentum_sign(df: DataFrame, n: int = 10, out: str = "signal_momentum", by: Sequence[str] = SERIES, ts: str = "date") -> DataFrame:
    lagged = df.withColumn("_past", F.lag("return").over(S.ordered(by, ts)))
    return lagged.withColumn(out, _flag(S.rolling("_past", "mean", n, by=by, ts=ts) > 0)).drop("_past")


TECHNICAL = ("signal_sma_crossover", "signal_rsi_mean_reversion", "signal_momentum")


def technical_signals(df: DataFrame, by: Sequence[str] = SERIES, ts: str = "date") -> DataFrame:
    """All three signals next to each other; ``df`` has ``price`` and ``return``."""
    df = sma_crossover(df, by=by, ts=ts)
    df = rsi_reversion(df, by=by, ts=ts)
    return momentum_sign(df, by=by, ts=ts)


def as_long(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """One row per (strategy, input row), the shape ``compare_strategies`` takes."""
    rest = [c for c in df.columns if c not in signals]
    return df.unpivot(rest, list(signals), "strategy", "signal")
