import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as T
from tidemark.operators import features as X
from tidemark.operators import pairs as P
from tidemark.operators import signals as G
from tidemark.operators.audit import audit_lookahead
from tidemark.operators.ordering import drawdown


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    pdf = pd.DataFrame({"series_id": "a", "date": pd.date_range("2024-01-01", periods=n), **cols})
    return spark.createDataFrame(pdf)


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


# The given returns, positions, equity and costs below, with their published results.
def test_equity_is_running_product(spark):
    r, s = [0.01, -0.02, 0.03, -0.01, 0.02], [1, 1, 0, 1, 1]
    for block_rows in (None, 2):
        bt = T.run_backtest(frame(spark, **{"return": r, "signal": s}), block_rows=block_rows)
        np.testing.assert_allclose(column(bt, "equity_curve"), np.cumprod(1 + np.array(r) * s), atol=1e-12)


def test_drawdown_of_given_equity(spark):
    out = drawdown(frame(spark, e=[1.20, 1.00, 0.90, 1.10]), "e", ts="date")
    assert min(column(out, "drawdown")) == pytest.approx(-0.25)


def test_sharpe_of_given_returns(spark):
    r = [0.02, -0.01, 0.015, 0.005, -0.02, 0.01]
    got = frame(spark, r=r).agg(T.sharpe(F.col("r"), 365).alias("s")).first()["s"]
    assert round(got, 3) == round(np.mean(r) / np.std(r, ddof=1) * math.sqrt(365), 3)


def test_sortino_is_null_without_losses(spark):
    got = frame(spark, r=[0.01, 0.02, 0.0]).agg(T.sortino(F.col("r"), 365).alias("s")).first()["s"]
    assert got is None


def test_frictions_of_given_days(spark):
    """Enter, hold, leave; volatility is missing on the first day and takes the median."""
    df = frame(spark, **{"return": [0.01, 0.02, -0.01], "signal": [1, 1, 0], "vol_20d": [None, 0.02, 0.03], "label_up": [1, 1, 0]})
    out = T.apply_frictions(T.run_backtest(df), taker=10.0, maker=2.0, base=1.0, mult=100.0).orderBy("date").collect()
    assert [r["slippage_bps"] for r in out] == pytest.approx([3.5, 3.0, 4.0])
    assert [r["turnover"] for r in out] == [1, 0, 1]
    assert [r["cost_taker"] for r in out] == pytest.approx([0.00135, 0, 0.0014])
    assert [r["cost_maker"] for r in out] == pytest.approx([0.00055, 0, 0.0006])
    assert [r["strategy_return_net_taker"] for r in out] == pytest.approx([0.01 - 0.00135, 0.02, -0.0014])
    total = T.friction_summary(T.apply_frictions(T.run_backtest(df), taker=10.0, maker=2.0, base=1.0, mult=100.0)).first()
    assert (total["n_position_changes"], total["total_fee_drag_pct"], total["total_slippage_drag_pct"]) == pytest.approx((2, 0.2, 0.075))


@pytest.mark.parametrize("positions,want", [([0, 1, 1, 0], [0, 0.0030, 0, 0.0024]), ([1, 1, -1], [0.0030, 0, 0.0054])])
def test_pair_costs(spark, positions, want):
    df = frame(spark, position=positions).withColumnRenamed("series_id", "pair")
    np.testing.assert_allclose(column(P.pair_costs(df), "transaction_cost"), want, atol=1e-12)


def test_zero_price_gives_null_not_error(spark):
    from tidemark.functions import series as S

    out = frame(spark, price=[0.0, 1.0, 2.0]).select("date", S.simple_return("price", ts="date").alias("r"))
    assert column(out, "r") == [None, None, 1.0]


def random_prices(spark, n=200):
    rng = np.random.default_rng(5)
    return frame(spark, price=30_000 * np.exp(np.cumsum(rng.normal(0, 0.02, n))))


def test_lagged_features_and_signals_do_not_look_ahead(spark):
    df = random_prices(spark)
    cutoff = F.to_timestamp(F.lit("2024-05-01"))
    keys = ["series_id", "date"]
    assert audit_lookahead(lambda d: X.lagged_features(d, dropna=False), df, cutoff, keys, "date").count() == 0

    def signals(d):
        return G.technical_signals(X.lagged_features(d)).select(*keys, *G.TECHNICAL)

    assert audit_lookahead(signals, df, cutoff, keys, "date").count() == 0


def test_signals_equal_a_plain_loop(spark):
    df = random_prices(spark)
    prices = [r["price"] for r in df.orderBy("date").collect()]
    got = G.rsi_reversion(G.sma_crossover(df)).orderBy("date").collect()
    gain = loss = None
    strength: list = [None]
    for before, now in zip(prices, prices[1:]):
        up, down = max(now - before, 0.0), max(before - now, 0.0)
        gain = up if gain is None else gain + (up - gain) / 14
        loss = down if loss is None else loss + (down - loss) / 14
        strength.append(gain / (gain + loss))
    for t, row in enumerate(got):
        fast, slow = prices[max(t - 10, 0) : t], prices[max(t - 50, 0) : t]
        assert row["signal_sma_crossover"] == int(len(slow) == 50 and sum(fast) / 10 > sum(slow) / 50)
        assert row["signal_rsi_mean_reversion"] == int(t >= 15 and strength[t - 1] < 0.3)


def test_comparison_ranks_by_net_sharpe(spark):
    df = X.lagged_features(random_prices(spark, 300))
    long = G.as_long(G.technical_signals(df), G.TECHNICAL)
    rows = T.compare_strategies(long).collect()
    assert len(rows) == 3
    assert [r["sharpe_net"] for r in rows] == sorted((r["sharpe_net"] for r in rows), reverse=True)


def test_pooled_pnl_counts_changes(spark):
    df = frame(spark, prediction=[2, 2, 0, 1], fwd_log_ret=[0.01, -0.01, 0.02, 0.5])
    got = T.classification_pnl(df, ts="date").first()
    assert got["n_trades"] == 3
    assert got["gross_return_total"] == pytest.approx(0.01 - 0.01 - 0.02)
    assert got["cost_total"] == pytest.approx((1 + 2 + 1) * 0.001)
