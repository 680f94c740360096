"""Queries on bars, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions import shapes
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import ordering as O
from tidemark.plans import views as V
from tidemark.plans.registry import big, day, num, nums, query, shown


@query("trade_bars", f"""WITH {V.TRADES_SQL}
SELECT series_id, {day("date_trunc('day', ts)", 'bin')}, {num('sum(price * quantity) / sum(quantity)', 'vwap')},
  {num('sum(quantity)', 'trade_volume')},
  {num('sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END)', 'signed_volume')},
  {num('sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) / sum(quantity)', 'trade_flow_imbalance')}
FROM trades GROUP BY series_id, date_trunc('day', ts)""")
def trade_bars(spark, sf):
    return shown(B.trade_bars(V.trades(spark, sf), "1 day"))


_DEPTH_BARS = """snaps AS (
  SELECT series_id, ts,
    max(CASE WHEN percentage = -1 THEN depth END) AS bn, max(CASE WHEN percentage = 1 THEN depth END) AS an,
    max(CASE WHEN percentage = -5 THEN depth END) AS bf, max(CASE WHEN percentage = 5 THEN depth END) AS af
  FROM depth GROUP BY ALL),
depth_bars AS (SELECT series_id, date_trunc('{unit}', ts)::TIMESTAMP AS bin,
    last((bn - an) / (bn + an) ORDER BY ts) AS near_depth_imbalance,
    last((bf - af) / (bf + af) ORDER BY ts) AS far_depth_imbalance, last(bf + af ORDER BY ts) AS total_depth
  FROM snaps GROUP BY ALL)"""


@query("depth_bars", f"""WITH {V.DEPTH_SQL}, {_DEPTH_BARS.format(unit='month')}
SELECT series_id, {day('bin', 'bin')}, {nums('near_depth_imbalance far_depth_imbalance total_depth')} FROM depth_bars""")
def depth_bars(spark, sf):
    return shown(B.depth_bars(V.depth(spark, sf), every="1 month"))


@query("bars_with_book", f"""WITH {V.DAY_BARS_SQL}, {V.DEPTH_SQL}, {_DEPTH_BARS.format(unit='day')}
SELECT series_id, {day('bin', 'bin')}, {nums('vwap trade_volume signed_volume trade_flow_imbalance near_depth_imbalance far_depth_imbalance total_depth')}
FROM bars JOIN depth_bars USING (series_id, bin)""")
def bars_with_book(spark, sf):
    return shown(B.join_bars(V.day_bars(spark, sf), B.depth_bars(V.depth(spark, sf), every="1 day")))


def _impact(spark, sf, **kw):
    book = B.depth_bars(V.depth(spark, sf), every="1 day")
    return X.impact_features(B.join_bars(V.day_bars(spark, sf), book), **kw)


_FRAME = "(PARTITION BY series_id ORDER BY {ts} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def roll(fn: str, col: str, n: int, ts: str, needed: int | None = None) -> str:
    """SQL rolling aggregate that is null until the frame has enough values."""
    w = _FRAME.format(ts=ts, n=n - 1)
    return f"CASE WHEN count({col}) OVER {w} >= {needed or n} THEN {fn}({col}) OVER {w} END"


IMPACT_SQL = f"""{V.DAY_BARS_SQL}, {V.DEPTH_SQL}, {_DEPTH_BARS.format(unit='day')},
j AS (SELECT *, ln(vwap) - ln(lag(vwap) OVER w) AS log_return FROM bars JOIN depth_bars USING (series_id, bin)
  WINDOW w AS (PARTITION BY series_id ORDER BY bin)),
f AS (SELECT *, {roll('avg', 'trade_flow_imbalance', 5, 'bin')} AS ofi_roll5,
    {roll('avg', 'trade_flow_imbalance', 15, 'bin')} AS ofi_roll15,
    {roll('avg', 'trade_volume', 5, 'bin')} AS volume_roll5,
    {roll('stddev_samp', 'log_return', 15, 'bin')} AS realized_vol_roll15,
    lag(log_return, 1) OVER w AS lag_return_1, lag(log_return, 5) OVER w AS lag_return_5,
    ln(lead(vwap, 1) OVER w) - ln(vwap) AS future_return_1, ln(lead(vwap, 5) OVER w) - ln(vwap) AS future_return_5,
    ln(lead(vwap, 15) OVER w) - ln(vwap) AS future_return_15
  FROM j WINDOW w AS (PARTITION BY series_id ORDER BY bin)),
impact AS (SELECT * FROM f WHERE {' AND '.join(c + ' IS NOT NULL' for c in (*X.IMPACT_FEATURES, 'future_return_1', 'future_return_5', 'future_return_15'))})"""


@query("impact_features", f"""WITH {IMPACT_SQL}
SELECT series_id, {day('bin', 'bin')}, {nums(' '.join(X.IMPACT_FEATURES) + ' future_return_1 future_return_5 future_return_15')} FROM impact""")
def impact_features(spark, sf):
    cols = [*X.IMPACT_FEATURES, *[f"future_return_{h}" for h in (1, 5, 15)]]
    return shown(_impact(spark, sf).select("series_id", "bin", *cols))


CANDLE_SQL = f"""{V.OHLCV_SQL},
r AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS ret_1, row_number() OVER w AS rn FROM ohlcv
  WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
g AS (SELECT *, CASE WHEN ret_1 > 0 THEN ret_1 ELSE 0 END AS gains, CASE WHEN ret_1 < 0 THEN -ret_1 ELSE 0 END AS losses,
    CASE WHEN ret_1 > 0 THEN 1 WHEN ret_1 < 0 THEN -1 ELSE 0 END AS dir,
    array_agg(close) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 400 PRECEDING AND CURRENT ROW) AS past FROM r),
e AS (SELECT *, list_sum(list_transform(past, lambda v, i: v * pow(11.0 / 13.0, len(past) - i)))
    / list_sum(list_transform(past, lambda v, i: pow(11.0 / 13.0, len(past) - i))) AS ema FROM g),
candle AS (SELECT series_id, ts, open, close, ret_1,
    ln(close) - ln(lag(close, 3) OVER w) AS ret_3, ln(close) - ln(lag(close, 6) OVER w) AS ret_6,
    {roll('stddev_samp', 'ret_1', 10, 'ts')} AS vol_10, {roll('stddev_samp', 'ret_1', 20, 'ts')} AS vol_20,
    100 - 100 / (1 + {roll('avg', 'gains', 14, 'ts')} / ({roll('avg', 'losses', 14, 'ts')} + 1e-12)) AS rsi_14,
    close / {roll('avg', 'close', 10, 'ts')} - 1 AS sma_ratio_10, close / {roll('avg', 'close', 20, 'ts')} - 1 AS sma_ratio_20,
    close / ema - 1 AS ema_ratio_12,
    (volume - {roll('avg', 'volume', 20, 'ts')}) / ({roll('stddev_samp', 'volume', 20, 'ts')} + 1e-12) AS volume_zscore,
    (close - open) / (high - low + 1e-12) AS body_ratio,
    (high - greatest(open, close)) / (high - low + 1e-12) AS upper_wick_ratio,
    (least(open, close) - low) / (high - low + 1e-12) AS lower_wick_ratio,
    {roll('sum', 'dir', 5, 'ts')} AS momentum_streak,
    CASE WHEN lead(close) OVER w > lead(open) OVER w THEN 1 WHEN lead(close) OVER w IS NOT NULL THEN 0 END AS label_next_bullish
  FROM e WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
features AS (SELECT * FROM candle WHERE {' AND '.join(c + ' IS NOT NULL' for c in (*X.CANDLE_FEATURES, 'label_next_bullish'))})"""


def candle_features(spark, sf):
    """Candle features on blocks with a halo; equal to whole-series windows."""
    return O.in_blocks(
        V.ohlcv(spark, sf), lambda df, by: X.ohlcv_features(df, by), lookback=O.ewm_memory(2 / 13) + 1, lookahead=1,
        block_rows=2_000, slot_width=7 * 86_400,
    )


@query("ohlcv_features", f"""WITH {CANDLE_SQL}
SELECT series_id, {day('ts', 'ts')}, {nums(' '.join(X.CANDLE_FEATURES))}, {big('label_next_bullish')} FROM features""")
def ohlcv_features(spark, sf):
    return shown(candle_features(spark, sf).select("series_id", "ts", *X.CANDLE_FEATURES, "label_next_bullish"))


@query("deadzone_label", f"""WITH {CANDLE_SQL},
d AS (SELECT *, ln(lead(close) OVER w) - ln(close) AS fwd_log_ret FROM features WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, {day('ts', 'ts')}, {nums('vol_20 fwd_log_ret')},
  {big('CASE WHEN fwd_log_ret > 0.3 * vol_20 THEN 2 WHEN fwd_log_ret < -0.3 * vol_20 THEN 0 ELSE 1 END', 'label_direction')}
FROM d WHERE fwd_log_ret IS NOT NULL""")
def deadzone_label(spark, sf):
    feats = X.ohlcv_features(V.ohlcv(spark, sf))
    return shown(X.deadzone_label(feats).select("series_id", "ts", "vol_20", "fwd_log_ret", "label_direction"))
