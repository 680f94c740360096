"""Queries on signals, backtests, costs and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as T
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import signals as G
from tidemark.operators.splits import chronological_split, standardize
from tidemark.plans import views as V
from tidemark.plans.market import CANDLE_SQL, candle_features, roll
from tidemark.plans.registry import big, day, num, nums, query, shown
from tidemark.plans.series import WILDER, W
from tidemark.session import materialised

LAGGED = X.lagged_columns()

LAGGED_SQL = f"""{V.QUOTES_SQL},
r AS (SELECT *, ln(price) - ln(lag(price) OVER w) AS "return" FROM quotes {W}),
g AS (SELECT *, lag("return", 1) OVER w AS lag_return_1, lag("return", 2) OVER w AS lag_return_2, lag("return", 3) OVER w AS lag_return_3 FROM r {W}),
h AS (SELECT *, {', '.join(f"{roll(fn, 'lag_return_1', n, 'date')} AS {p}_{n}d" for n in (3, 5, 10, 20) for p, fn in (('mom', 'avg'), ('vol', 'stddev_samp')))},
    CASE WHEN "return" > 0 THEN 1 ELSE 0 END AS label_up FROM g),
lagged AS (SELECT * FROM h WHERE {' AND '.join(c + ' IS NOT NULL' for c in LAGGED)})"""


def lagged(spark, sf):
    return X.lagged_features(V.quotes(spark, sf))


@query("lagged_features", f"""WITH {LAGGED_SQL}
SELECT series_id, {day('date', 'date')}, {nums('price ' + ' '.join(LAGGED))}, {num('"return"', '"return"')}, {big('label_up')} FROM lagged""")
def lagged_features(spark, sf):
    return shown(lagged(spark, sf))


SIGNALS_SQL = f"""{LAGGED_SQL},
m AS (SELECT *, {roll('avg', 'price', 10, 'date')} AS fast, {roll('avg', 'price', 50, 'date')} AS slow,
    price - lag(price) OVER w AS delta, lag("return") OVER w AS past FROM lagged {W}),
l AS (SELECT *, array_agg(greatest(delta, 0)) FILTER (delta IS NOT NULL) OVER w AS up,
    array_agg(-least(delta, 0)) FILTER (delta IS NOT NULL) OVER w AS down FROM m {W}),
rs AS (SELECT *, CASE WHEN len(up) >= 14 THEN 100 - 100 / (1 + {WILDER.format(x='up')} / nullif({WILDER.format(x='down')}, 0)) END AS rsi FROM l),
signals AS (SELECT * EXCLUDE (up, down),
    CASE WHEN lag(fast) OVER w > lag(slow) OVER w THEN 1 ELSE 0 END AS signal_sma_crossover,
    CASE WHEN lag(rsi) OVER w < 30 THEN 1 ELSE 0 END AS signal_rsi_mean_reversion,
    CASE WHEN {roll('avg', 'past', 10, 'date')} > 0 THEN 1 ELSE 0 END AS signal_momentum FROM rs {W})"""


def signal_rows(spark, sf):
    return G.technical_signals(lagged(spark, sf))


@query("technical_signals", f"""WITH {SIGNALS_SQL}
SELECT series_id, {day('date', 'date')}, {', '.join(big(s) for s in G.TECHNICAL)} FROM signals""")
def technical_signals(spark, sf):
    return shown(signal_rows(spark, sf).select("series_id", "date", *G.TECHNICAL))


BACKTEST_SQL = f"""{SIGNALS_SQL},
numbered AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM signals {W}),
test AS (SELECT * FROM numbered WHERE idx >= floor(n * 0.7::DOUBLE)),
long AS (
  SELECT 'signal_sma_crossover' AS strategy, signal_sma_crossover AS signal, * FROM test
  UNION ALL SELECT 'signal_rsi_mean_reversion', signal_rsi_mean_reversion, * FROM test
  UNION ALL SELECT 'signal_momentum', signal_momentum, * FROM test),
b1 AS (SELECT *, signal * "return" AS sr, 1.5 + 40 * coalesce(vol_20d, median(vol_20d) OVER (PARTITION BY strategy, series_id)) AS slippage_bps,
    abs(signal - lag(signal, 1, 0) OVER k) AS turnover FROM long WINDOW k AS (PARTITION BY strategy, series_id ORDER BY date)),
b2 AS (SELECT *, turnover * (10 + slippage_bps) / 10000.0 AS cost_taker, turnover * (8 + slippage_bps) / 10000.0 AS cost_maker FROM b1),
b3 AS (SELECT *, product(1 + sr) OVER k AS equity, product(1 + "return") OVER k AS hold, product(1 + sr - cost_taker) OVER k AS eq_taker,
    product(1 + sr - cost_maker) OVER k AS eq_maker FROM b2 WINDOW k AS (PARTITION BY strategy, series_id ORDER BY date)),
bt AS (SELECT *, equity / max(equity) OVER k - 1 AS dd, eq_taker / max(eq_taker) OVER k - 1 AS dd_taker
  FROM b3 WINDOW k AS (PARTITION BY strategy, series_id ORDER BY date))"""


def test_signals(spark, sf):
    """The last 30 percent of every series, one row per strategy."""
    placed = chronological_split(signal_rows(spark, sf), (0.7, 0.3), ("train", "test"), ts="date", slots=False)
    rows = placed.filter(F.col("split") == "test").select("series_id", "date", "return", "label_up", "vol_20d", *G.TECHNICAL)
    return G.as_long(rows, G.TECHNICAL)


KEYS = ["strategy", "series_id"]


@query("backtest_with_costs", f"""WITH {BACKTEST_SQL}
SELECT strategy, series_id, {day('date', 'date')}, {big('signal')}, {num('sr', 'strategy_return')}, {num('equity', 'equity_curve')}, {num('hold', 'buy_hold_curve')},
  {num('dd', 'drawdown')}, {nums('turnover slippage_bps cost_taker cost_maker')}, {num('eq_taker', 'equity_curve_net_taker')},
  {num('eq_maker', 'equity_curve_net_maker')}, {num('dd_taker', 'drawdown_net_taker')} FROM bt""")
def backtest_with_costs(spark, sf):
    bt = T.apply_frictions(T.run_backtest(test_signals(spark, sf), by=KEYS), by=KEYS)
    return shown(bt.select(
        *KEYS, "date", "signal", "strategy_return", "equity_curve", "buy_hold_curve", "drawdown", "turnover", "slippage_bps",
        "cost_taker", "cost_maker", "equity_curve_net_taker", "equity_curve_net_maker", "drawdown_net_taker",
    ))


@query("friction_summary", f"""WITH {BACKTEST_SQL}
SELECT strategy, series_id, {big('sum(turnover)', 'n_position_changes')}, {num('avg(slippage_bps) FILTER (turnover > 0)', 'avg_slippage_bps')},
  {num('sum(turnover * 10 / 10000.0) * 100', 'total_fee_drag_pct')}, {num('sum(turnover * slippage_bps / 10000.0) * 100', 'total_slippage_drag_pct')},
  {num('(sum(turnover * 10 / 10000.0) + sum(turnover * slippage_bps / 10000.0)) * 100', 'total_friction_drag_pct')} FROM bt GROUP BY strategy, series_id""")
def friction_summary(spark, sf):
    bt = T.apply_frictions(T.run_backtest(test_signals(spark, sf), by=KEYS), by=KEYS)
    return shown(T.friction_summary(bt, by=KEYS))


@query("risk_metrics", f"""WITH {BACKTEST_SQL}
SELECT strategy, series_id, {num('CASE WHEN stddev_samp(sr) > 0 THEN avg(sr) / stddev_samp(sr) * sqrt(365) ELSE 0 END', 'sharpe')},
  {num('avg(sr) / nullif(sqrt(avg(least(sr, 0) * least(sr, 0))), 0) * sqrt(365)', 'sortino')},
  {num('coalesce(avg(CASE WHEN sr > 0 THEN 1.0 ELSE 0.0 END) FILTER (signal = 1), 0)', 'win_rate')}, {num('min(dd)', 'max_drawdown')},
  {num('arg_max(equity, date) - 1', 'total_return')}, {big('count(*) FILTER (signal = 1)', 'trades_taken')},
  {num('avg(CASE WHEN label_up = signal THEN 1.0 ELSE 0.0 END)', 'signal_accuracy')} FROM bt GROUP BY strategy, series_id""")
def risk_metrics(spark, sf):
    return shown(T.risk_metrics(T.run_backtest(test_signals(spark, sf), by=KEYS), by=KEYS))


@query("compare_strategies", f"""WITH {BACKTEST_SQL}, net AS (SELECT *, sr - cost_taker AS nr FROM bt)
SELECT *, (rank() OVER (PARTITION BY series_id ORDER BY sharpe_net DESC, strategy))::BIGINT AS rank FROM (SELECT strategy, series_id, {num('CASE WHEN stddev_samp(sr) > 0 THEN avg(sr) / stddev_samp(sr) * sqrt(365) ELSE 0 END', 'sharpe_gross')},
  {num('CASE WHEN stddev_samp(nr) > 0 THEN avg(nr) / stddev_samp(nr) * sqrt(365) ELSE 0 END', 'sharpe_net')},
  {num('min(dd)', 'max_drawdown_gross')}, {num('min(dd_taker)', 'max_drawdown_net')}, {num('arg_max(equity, date) - 1', 'total_return_gross')},
  {num('arg_max(eq_taker, date) - 1', 'total_return_net')},
  {num('coalesce(avg(CASE WHEN nr > 0 THEN 1.0 ELSE 0.0 END) FILTER (signal = 1), 0)', 'win_rate_net')},
  {num('avg(CASE WHEN label_up = signal THEN 1.0 ELSE 0.0 END)', 'signal_accuracy')}, {big('count(*) FILTER (signal = 1)', 'trades_taken')},
  {num('(sum(turnover * 10 / 10000.0) + sum(turnover * slippage_bps / 10000.0)) * 100', 'friction_drag_pct')} FROM net GROUP BY strategy, series_id)""")
def compare_strategies(spark, sf):
    return shown(T.compare_strategies(test_signals(spark, sf)))


@query("compare_model_strategies")
def compare_model_strategies(spark, sf):
    """The technical signals next to those of two models, fitted on each series' first 70 percent."""
    rows = chronological_split(signal_rows(spark, sf), (0.7, 0.3), ("train", "test"), ts="date", slots=False)
    scaled = [f"scaled_{c}" for c in LAGGED]
    rows = materialised(rows.withColumns({n: F.col(c) for n, c in zip(scaled, LAGGED)}), "signals")
    train, test = standardize(rows.filter("split = 'train'"), rows.filter("split = 'test'"), cols=scaled)
    for kind in ("logistic", "boosted_trees"):
        scored = M.predict(M.fit_classifier(train, kind, scaled, "label_up"), test, scaled)
        test = materialised(scored.withColumn(f"signal_{kind}", (F.col("score") >= 0.5).cast("int")).drop("score", "prediction"), "signals")
    names = [*G.TECHNICAL, "signal_logistic", "signal_boosted_trees"]
    return shown(T.compare_strategies(G.as_long(test.select("series_id", "date", "return", "label_up", "vol_20d", *names), names)))


@query("classification_pnl", f"""WITH {CANDLE_SQL},
d AS (SELECT series_id, ts, vol_20, ret_1, ln(lead(close) OVER w) - ln(close) AS fwd FROM features WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
p AS (SELECT *, CASE WHEN ret_1 > 0.3 * vol_20 THEN 1.0 WHEN ret_1 < -0.3 * vol_20 THEN -1.0 ELSE 0.0 END AS pos FROM d WHERE fwd IS NOT NULL),
m AS (SELECT *, abs(pos - lag(pos, 1, 0) OVER (PARTITION BY series_id ORDER BY ts)) AS move FROM p),
q AS (SELECT *, pos * fwd AS gross, move * 0.001 AS cost FROM m)
SELECT series_id, {big('count(*) FILTER (move > 0)', 'n_trades')}, {num('sum(gross)', 'gross_return_total')}, {num('sum(cost)', 'cost_total')},
  {num('sum(gross - cost)', 'net_return_total')}, {num('avg(gross - cost) / stddev_pop(gross - cost) * sqrt(8760)', 'annualized_sharpe_net')} FROM q GROUP BY series_id""")
def classification_pnl(spark, sf):
    """Trading result of predicting that the last candle's class repeats."""
    rows = X.deadzone_label(candle_features(spark, sf))
    limit = 0.3 * F.col("vol_20")
    pred = F.when(F.col("ret_1") > limit, 2).when(F.col("ret_1") < -limit, 0).otherwise(1)
    return shown(T.classification_pnl(rows.withColumn("prediction", pred)))
