"""Backtests, trading costs and risk metrics for many series and strategies at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions.series import SERIES
from tidemark.operators.features import fill_missing
from tidemark.operators.ordering import cumulative, drawdown, drop_blocks, split_blocks

# Cost defaults in basis points and calendar lengths.
TAKER_BPS = 10.0
MAKER_BPS = 8.0
SLIPPAGE_BASE_BPS = 1.5
SLIPPAGE_VOL_MULT = 40.0
DAYS_PER_YEAR = 365
HOURS_PER_YEAR = 8760


def run_backtest(df: DataFrame, signal: str = "signal", by: Sequence[str] = SERIES, ts: str = "date", block_rows: int | None = None) -> DataFrame:
    """Long or flat: the signal of a row earns that row's return.

    Log returns are compounded as simple ones, as in the published results.
    """
    bt = df.withColumn("strategy_return", F.col(signal) * F.col("return"))
    if block_rows:
        bt = split_blocks(bt, by, ts, block_rows)
    bt = cumulative(
        bt,
        {
            "equity_curve": ("product", 1 + F.col("strategy_return")),
            "buy_hold_curve": ("product", 1 + F.col("return")),
        },
        by, ts,
    )
    return drop_blocks(drawdown(bt, "equity_curve", "drawdown", by, ts))


def dynamic_slippage_bps(df: DataFrame, vol: str = "vol_20d", base: float = SLIPPAGE_BASE_BPS, mult: float = SLIPPAGE_VOL_MULT, out: str = "slippage_bps", by: Sequence[str] = SERIES) -> DataFrame:
    """``base + mult * volatility``; missing volatility takes the series' median."""
    filled = fill_missing(df.withColumn("_vol", F.col(vol)), "_vol", "median", by=by)
    return filled.withColumn(out, base + mult * F.col("_vol")).drop("_vol")


def apply_frictions(
    bt: DataFrame, vol: str = "vol_20d", taker: float = TAKER_BPS, maker: float = MAKER_BPS,
    base: float = SLIPPAGE_BASE_BPS, mult: float = SLIPPAGE_VOL_MULT, signal: str = "signal",
    by: Sequence[str] = SERIES, ts: str = "date", block_rows: int | None = None,
) -> DataFrame:
    """Fees and volatility-scaled slippage on every position change, for both fee levels."""
    out = dynamic_slippage_bps(bt, vol, base, mult, by=by)
    out = out.withColumn("turnover", S.turnover(F.col(signal).cast("double"), by, ts))
    for side, fee in (("taker", taker), ("maker", maker)):
        cost = F.col("turnover") * (fee + F.col("slippage_bps")) / 10_000.0
        out = out.withColumn(f"cost_{side}", cost)
        out = out.withColumn(f"strategy_return_net_{side}", F.col("strategy_return") - F.col(f"cost_{side}"))
    out = out.withColumn("fee_cost", F.col("turnover") * taker / 10_000.0)
    if block_rows:
        out = split_blocks(out, by, ts, block_rows)
    out = cumulative(
        out,
        {f"equity_curve_net_{s}": ("product", 1 + F.col(f"strategy_return_net_{s}")) for s in ("taker", "maker")},
        by, ts,
    )
    return drop_blocks(drawdown(out, "equity_curve_net_taker", "drawdown_net_taker", by, ts))


def friction_measures() -> dict[str, Column]:
    slip = F.sum(F.col("turnover") * F.col("slippage_bps") / 10_000.0)
    fees = F.sum("fee_cost")
    return {
        "n_position_changes": F.sum("turnover").cast("long"),
        "avg_slippage_bps": F.avg(F.when(F.col("turnover") > 0, F.col("slippage_bps"))),
        "total_fee_drag_pct": fees * 100,
        "total_slippage_drag_pct": slip * 100,
        "total_friction_drag_pct": (fees + slip) * 100,
    }


def friction_summary(bt: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    return bt.groupBy(*by).agg(*[c.alias(n) for n, c in friction_measures().items()])


def sharpe(ret: Column, periods: int, ddof: int = 1) -> Column:
    std = F.stddev_samp(ret) if ddof else F.stddev_pop(ret)
    return F.when(std > 0, F.avg(ret) / std * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def sortino(ret: Column, periods: int, mar: float = 0.0) -> Column:
    """Null when no return fell below ``mar``: the ratio is undefined then."""
    short = F.least(ret - mar, F.lit(0.0))
    down = F.sqrt(F.avg(short * short))
    return F.when(down > 0, (F.avg(ret) - mar) / down * F.sqrt(F.lit(float(periods))))


def risk_measures(
    ret: str = "strategy_return", equity: str = "equity_curve", dd: str = "drawdown", ts: str = "date",
    periods: int = DAYS_PER_YEAR, mar: float = 0.0, signal: str = "signal", label: str | None = "label_up",
) -> dict[str, Column]:
    r, active = F.col(ret), F.col(signal) == 1
    out = {
        "sharpe": sharpe(r, periods),
        "sortino": sortino(r, periods, mar),
        "win_rate": F.coalesce(F.avg(F.when(active, (r > 0).cast("double"))), F.lit(0.0)),
        "max_drawdown": F.min(dd),
        "total_return": F.max_by(equity, ts) - 1,
        "trades_taken": F.count(F.when(active, 1)),
    }
    if label:
        out["signal_accuracy"] = F.avg((F.col(label) == F.col(signal)).cast("double"))
    return out


def risk_metrics(bt: DataFrame, by: Sequence[str] = SERIES, **kw) -> DataFrame:
    """Sharpe, Sortino, win rate, drawdown, return, accuracy and trades in one aggregate."""
    return bt.groupBy(*by).agg(*[c.alias(n) for n, c in risk_measures(**kw).items()])


def compare_strategies(signals: DataFrame, series: Sequence[str] = SERIES, ts: str = "date", **costs: float) -> DataFrame:
    """Gross and net results of every strategy on the same rows and costs, ranked by net Sharpe within a series.

    ``signals`` is long: one row per strategy and bar. All strategies and series
    go through one backtest; nothing loops over them.
    """
    keys = ["strategy", *series]
    bt = apply_frictions(run_backtest(signals, by=keys, ts=ts), by=keys, ts=ts, **costs)
    gross = risk_measures(ts=ts)
    net = risk_measures("strategy_return_net_taker", "equity_curve_net_taker", "drawdown_net_taker", ts=ts, label=None)
    table = bt.groupBy(*keys).agg(
        gross["sharpe"].alias("sharpe_gross"),
        net["sharpe"].alias("sharpe_net"),
        gross["max_drawdown"].alias("max_drawdown_gross"),
        net["max_drawdown"].alias("max_drawdown_net"),
        gross["total_return"].alias("total_return_gross"),
        net["total_return"].alias("total_return_net"),
        net["win_rate"].alias("win_rate_net"),
        gross["signal_accuracy"].alias("signal_accuracy"),
        gross["trades_taken"].alias("trades_taken"),
        friction_measures()["total_friction_drag_pct"].alias("friction_drag_pct"),
    )
    # Ranked on the digits that are shown, so that equal results rank by name.
    best = Window.partitionBy(*series).orderBy(F.round("sharpe_net", 6).desc(), "strategy")
    return table.withColumn("rank", F.rank().over(best)).orderBy(*series, "rank")


def class_position(pred: Column) -> Column:
    """Class 0 is short, 1 flat, 2 long."""
    return (pred - 1).cast("double")


def classification_pnl(
    df: DataFrame, pred: str = "prediction", fwd: str = "fwd_log_ret", cost_bps: float = 10.0,
    periods: int = HOURS_PER_YEAR, by: Sequence[str] = SERIES, ts: str = "ts",
) -> DataFrame:
    """Totals of the strategy that trades predicted classes and pays for every position change."""
    k = {"by": by, "ts": ts}
    rows = df.withColumn("_pos", class_position(F.col(pred)))
    rows = rows.withColumn("_move", S.turnover("_pos", **k)).withColumns(
        {"_gross": F.col("_pos") * F.col(fwd), "_cost": F.col("_move") * (cost_bps / 10_000.0)}
    )
    rows = rows.withColumn("_net", F.col("_gross") - F.col("_cost"))
    return rows.groupBy(*by).agg(
        F.count(F.when(F.col("_move") > 0, 1)).alias("n_trades"),
        F.sum("_gross").alias("gross_return_total"),
        F.sum("_cost").alias("cost_total"),
        F.sum("_net").alias("net_return_total"),
        sharpe(F.col("_net"), periods, ddof=0).alias("annualized_sharpe_net"),
    )
