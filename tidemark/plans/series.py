"""Queries on ordered series: returns, rolling values, scans, runs, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.functions.shapes import horizontal_mean
from tidemark.operators import ordering as O
from tidemark.operators import signals as G
from tidemark.plans import views as V
from tidemark.plans.market import roll
from tidemark.plans.registry import big, day, num, nums, query, shown

K = {"ts": "date"}
W = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"
RETURNS_SQL = V.PANEL_SQL + f", rets AS (SELECT *, price / lag(price) OVER w - 1 AS ret FROM panel {W})"


def returns(spark, sf, view=V.panel):
    """Panel with simple daily returns."""
    return view(spark, sf).withColumn("ret", S.simple_return("price", **K))


@query("series_returns", f"""WITH {V.PANEL_SQL}
SELECT series_id, {day('date', 'date')}, {num('ln(price) - ln(lag(price) OVER w)', 'log_1')}, {num('ln(price) - ln(lag(price, 5) OVER w)', 'log_5')},
  {num('price / lag(price) OVER w - 1', 'simple')}, {num('ln(lead(price, 1) OVER w) - ln(price)', 'fwd_1')},
  {num('ln(lead(price, 15) OVER w) - ln(price)', 'fwd_15')} FROM panel {W}""")
def series_returns(spark, sf):
    df = V.panel(spark, sf)
    return shown(df.select(
        "series_id", "date", S.log_return("price", **K).alias("log_1"), S.log_return("price", 5, **K).alias("log_5"),
        S.simple_return("price", **K).alias("simple"), S.forward_return("price", 1, **K).alias("fwd_1"),
        S.forward_return("price", 15, **K).alias("fwd_15"),
    ))


@query("mean_prices", f"""WITH {V.OHLCV_SQL}
SELECT series_id, {day('ts', 'ts')}, {num('list_avg([CASE WHEN open > close THEN open END, high, CASE WHEN volume > 100 THEN low END, close])', 'mean_price')},
  {num('list_avg([CASE WHEN open > close THEN open END, CASE WHEN volume > 100 THEN low END])', 'mean_of_some')} FROM ohlcv""")
def mean_prices(spark, sf):
    """Mean over the columns of a candle that are there; none of them gives null."""
    rows = V.ohlcv(spark, sf).withColumns({"falling": F.when(F.col("open") > F.col("close"), F.col("open")), "busy": F.when(F.col("volume") > 100, F.col("low"))})
    return shown(rows.select("series_id", "ts", horizontal_mean("falling", "high", "busy", "close").alias("mean_price"), horizontal_mean("falling", "busy").alias("mean_of_some")))


@query("rolling_statistics", f"""WITH {RETURNS_SQL}
SELECT series_id, {day('date', 'date')}, {num(roll('avg', 'ret', 20, 'date'), 'mean_20')}, {num(roll('stddev_samp', 'ret', 20, 'date'), 'std_20')},
  {num(roll('sum', 'ret', 5, 'date'), 'sum_5')}, {num(roll('avg', 'ret', 50, 'date', 10), 'mean_50_min_10')},
  {num(roll('stddev_samp', 'ret', 10, 'date', 5), 'std_10_min_5')} FROM rets""")
def rolling_statistics(spark, sf):
    """Full-frame and minimum-sample rolling values, on blocks with a halo."""
    def step(df, by):
        k = {"by": by, "ts": "date"}
        return df.withColumns({
            "mean_20": S.rolling("ret", "mean", 20, **k), "std_20": S.rolling("ret", "std", 20, **k),
            "sum_5": S.rolling("ret", "sum", 5, **k), "mean_50_min_10": S.rolling("ret", "mean", 50, 10, **k),
            "std_10_min_5": S.rolling("ret", "std", 10, 5, **k),
        })

    out = O.in_blocks(returns(spark, sf), step, lookback=50, ts="date", block_rows=500, slot_width=200 * 86_400)
    return shown(out.drop("price", "ret"))


@query("rolling_scores", f"""WITH {V.DAY_BARS_SQL}, {", ".join(["panel AS (SELECT series_id, bin AS date, vwap AS price, trade_volume FROM bars)"])}
SELECT series_id, {day('date', 'date')},
  {num(f"(price - {roll('avg', 'price', 30, 'date')}) / nullif({roll('stddev_samp', 'price', 30, 'date')}, 0)", 'zscore_30')},
  {num(f"(trade_volume - {roll('avg', 'trade_volume', 20, 'date')}) / ({roll('stddev_samp', 'trade_volume', 20, 'date')} + 1e-12)", 'volume_z', 4)},
  {num(f"price / {roll('avg', 'price', 10, 'date')} - 1", 'sma_ratio_10')} FROM panel""")
def rolling_scores(spark, sf):
    df = V.day_bars(spark, sf).withColumnsRenamed({"bin": "date", "vwap": "price"})
    out = df.select(
        "series_id", "date", S.rolling_zscore("price", 30, **K).alias("zscore_30"),
        F.round(S.volume_zscore("trade_volume", 20, **K) + 3.1e-9, 4).alias("volume_z"), S.sma_ratio("price", 10, **K).alias("sma_ratio_10"),
    )
    return shown(out)


@query("ewm_unadjusted", f"""WITH {V.OHLCV_SQL},
l AS (SELECT *, array_agg(close) OVER (PARTITION BY series_id ORDER BY ts) AS past FROM ohlcv)
SELECT series_id, {day('ts', 'ts')},
  {num('list_sum(list_transform(past, lambda v, i: v * pow(13.0 / 14.0, len(past) - i) * CASE WHEN i = 1 THEN 1.0 ELSE 1.0 / 14.0 END))', 'ewm')},
  {num('list_sum(list_transform(past, lambda v, i: v * pow(11.0 / 13.0, len(past) - i))) / list_sum(list_transform(past, lambda v, i: pow(11.0 / 13.0, len(past) - i)))', 'ewm_adjusted')}
FROM l""")
def ewm_unadjusted(spark, sf):
    df = O.ewm_mean(V.ohlcv(spark, sf), "close", "ewm", alpha=1 / 14, adjust=False)
    return shown(O.ewm_mean(df, "close", "ewm_adjusted", span=12).select("series_id", "ts", "ewm", "ewm_adjusted"))


WILDER = "list_sum(list_transform({x}, lambda v, i: v * pow(13.0 / 14.0, len({x}) - i) * CASE WHEN i = 1 THEN 1.0 ELSE 1.0 / 14.0 END))"


@query("rsi_wilder", f"""WITH {V.OHLCV_SQL},
d AS (SELECT series_id, ts, close - lag(close) OVER (PARTITION BY series_id ORDER BY ts) AS delta FROM ohlcv),
l AS (SELECT series_id, ts, array_agg(greatest(delta, 0)) FILTER (delta IS NOT NULL) OVER w AS up,
    array_agg(-least(delta, 0)) FILTER (delta IS NOT NULL) OVER w AS down FROM d WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
a AS (SELECT series_id, ts, {WILDER.format(x='up')} AS u, {WILDER.format(x='down')} AS dn, len(up) AS n FROM l)
SELECT series_id, {day('ts', 'ts')}, {num('CASE WHEN n >= 14 THEN 100 - 100 / (1 + u / nullif(dn, 0)) END', 'rsi')} FROM a""")
def rsi_wilder(spark, sf):
    return shown(G.rsi_wilder(V.ohlcv(spark, sf), 14, "rsi", col="close", ts="ts").select("series_id", "ts", "rsi"))


@query("running_totals", f"""WITH {RETURNS_SQL},
c AS (SELECT series_id, date, coalesce(ret, 0) / 1000 AS r FROM rets),
e AS (SELECT *, sum(r) OVER w AS total, product(1 + r) OVER w AS equity FROM c {W}),
p AS (SELECT *, max(equity) OVER w AS peak FROM e {W})
SELECT series_id, {day('date', 'date')}, {nums('total equity peak')}, {num('equity / peak - 1', 'drawdown')} FROM p""")
def running_totals(spark, sf):
    """Sum, equity, peak and drawdown with totals carried from block to block."""
    df = returns(spark, sf).select("series_id", "date", (F.coalesce("ret", F.lit(0.0)) / 1000).alias("r"))
    df = O.cumulative(df, {"total": ("sum", "r"), "equity": ("product", 1 + F.col("r"))}, ts="date", block_rows=400, slot_width=200 * 86_400)
    df = O.cumulative(df, {"peak": ("max", "equity")}, ts="date", block_rows=400, slot_width=200 * 86_400)
    return shown(df.select("series_id", "date", "total", "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown")))


BAND_SQL = """{name} AS (
  SELECT {key}, {ts}, rn, z, CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END AS pos FROM {src} WHERE rn = 1
  UNION ALL
  SELECT s.{key}, s.{ts}, s.rn, s.z,
    CASE WHEN s.z IS NULL THEN b.pos WHEN b.pos = 0 THEN CASE WHEN s.z > 2 THEN -1 WHEN s.z < -2 THEN 1 ELSE 0 END
         WHEN abs(s.z) < 0.5 THEN 0 ELSE b.pos END
  FROM {name} b JOIN {src} s ON s.{key} = b.{key} AND s.rn = b.rn + 1)"""


@query("hysteresis_position", f"""WITH RECURSIVE {V.REGION_PANEL_SQL},
zs AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn,
  (price - {roll('avg', 'price', 30, 'date')}) / nullif({roll('stddev_samp', 'price', 30, 'date')}, 0) AS z FROM panel),
{BAND_SQL.format(name='band', key='series_id', ts='date', src='zs')}
SELECT series_id, {day('date', 'date')}, {big('CASE WHEN z IS NULL THEN 0 ELSE pos END', 'position')} FROM band""")
def hysteresis_position(spark, sf):
    df = V.region_panel(spark, sf).withColumn("z", S.rolling_zscore("price", 30, **K))
    return shown(O.hysteresis(df, "z", ts="date", block_rows=600).select("series_id", "date", "position"))


@query("direction_runs", f"""WITH {RETURNS_SQL},
s AS (SELECT series_id, date, coalesce(sign(ret), 0)::INT AS direction FROM rets),
c AS (SELECT *, CASE WHEN direction <> lag(direction) OVER w THEN 1 ELSE 0 END AS ch FROM s {W}),
r AS (SELECT *, sum(ch) OVER w AS run FROM c {W})
SELECT series_id, {big('run')}, {big('direction')}, {day('min(date)', 'start')}, {day('max(date)', 'end').replace(' end', ' "end"')}, {big('count(*)', 'n_rows')}
FROM r GROUP BY series_id, run, direction""")
def direction_runs(spark, sf):
    df = returns(spark, sf).withColumn("direction", F.coalesce(F.signum("ret"), F.lit(0.0)).cast("int"))
    return shown(O.runs(df, "direction", ts="date"))


@query("feature_sequences", f"""WITH {RETURNS_SQL},
l AS (SELECT series_id, date, array_agg(price) OVER f AS p, array_agg(coalesce(ret, 0)) OVER f AS r FROM rets
  WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT series_id, {day('date', 'date')}, {big('len(p)', 'n_steps')}, {num('p[1]', 'first_price')}, {num('p[24]', 'last_price')}, {num('list_sum(r)', 'ret_sum')}
FROM l WHERE len(p) = 24""")
def feature_sequences(spark, sf):
    df = returns(spark, sf).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    seq = O.sequences(df, ["price", "ret"], 24, ts="date")
    total = F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v[1])
    return shown(seq.select(
        "series_id", "date", F.size("sequence").alias("n_steps"), F.col("sequence")[0][0].alias("first_price"),
        F.element_at("sequence", -1)[0].alias("last_price"), total.alias("ret_sum"),
    ))


@query("rebased_prices", f"""WITH {V.PANEL_SQL}
SELECT series_id, {day('date', 'date')}, {num('100 * price / first(price) OVER (PARTITION BY series_id ORDER BY date)', 'rebased')} FROM panel""")
def rebased_prices(spark, sf):
    return shown(V.panel(spark, sf).select("series_id", "date", S.rebase("price", **K).alias("rebased")))


@query("row_positions", f"""WITH {V.PANEL_SQL}
SELECT series_id, {day('date', 'date')}, {big('row_number() OVER (PARTITION BY series_id ORDER BY date) - 1', 'row_idx')},
  {big('count(*) OVER (PARTITION BY series_id)', 'n_rows')} FROM panel""")
def row_positions(spark, sf):
    out = O.row_index(V.panel(spark, sf), ts="date", slot_width=90 * 86_400, total="n_rows")
    return shown(out.select("series_id", "date", "row_idx", "n_rows"))


@query("momentum_streaks", f"""WITH {RETURNS_SQL}, s AS (SELECT *, coalesce(sign(ret), 0) AS d FROM rets)
SELECT series_id, {day('date', 'date')}, {num(roll('sum', 'd', 5, 'date'), 'streak')} FROM s""")
def momentum_streaks(spark, sf):
    return shown(returns(spark, sf).select("series_id", "date", S.streak("ret", 5, **K).alias("streak")))


@query("extreme_moves", f"""WITH {RETURNS_SQL}, v AS (SELECT * FROM rets WHERE ret IS NOT NULL)
SELECT * FROM (SELECT 'best' AS side, series_id, {day('date', 'date')}, {nums('ret')} FROM (SELECT * FROM v ORDER BY ret DESC, series_id, date LIMIT 20))
UNION ALL SELECT * FROM (SELECT 'worst' AS side, series_id, {day('date', 'date')}, {nums('ret')} FROM (SELECT * FROM v ORDER BY ret, series_id, date LIMIT 20))""")
def extreme_moves(spark, sf):
    """Largest and smallest daily returns, a top-k report."""
    rows = returns(spark, sf).filter(F.col("ret").isNotNull()).select("series_id", "date", "ret")
    best = O.top_k(rows, "ret", 20, ties=["series_id", "date"]).withColumn("side", F.lit("best"))
    worst = O.top_k(rows, "ret", 20, ascending=True, ties=["series_id", "date"]).withColumn("side", F.lit("worst"))
    return shown(best.unionByName(worst))


@query("newest_rows", f"""WITH {V.PANEL_SQL}
SELECT series_id, {day('date', 'date')}, {nums('price')} FROM panel QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 30""")
def newest_rows(spark, sf):
    return shown(O.tail(V.panel(spark, sf), 30, ts="date"))


@query("thinned_rows", f"""WITH {V.PANEL_SQL},
i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM panel),
picks AS (SELECT series_id, unnest(list_distinct(list_transform(range(least(60, n)), lambda j: (j * (n - 1) // (least(60, n) - 1))::BIGINT))) AS idx
  FROM (SELECT DISTINCT series_id, n FROM i))
SELECT 'every_10th' AS kind, series_id, {day('date', 'date')} FROM i WHERE idx % 10 = 0
UNION ALL SELECT 'even_60' AS kind, series_id, {day('date', 'date')} FROM i JOIN picks USING (series_id, idx)""")
def thinned_rows(spark, sf):
    """Every tenth row, and 60 evenly spaced rows per series."""
    df = V.panel(spark, sf)
    a = O.every_kth(df, 10, ts="date").select(F.lit("every_10th").alias("kind"), "series_id", "date")
    b = O.evenly_spaced(df, 60, ts="date").select(F.lit("even_60").alias("kind"), "series_id", "date")
    return shown(a.unionByName(b))


@query("seeded_sample", "SELECT doc_id, source, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 500")
def seeded_sample(spark, sf):
    """A repeatable sample of 500 documents by key hash."""
    return O.sample_n(V.table(spark, sf, "documents").select("doc_id", "source", "n_chars"), 500, ["doc_id"])


@query("filled_gaps", f"""WITH {RETURNS_SQL}, v AS (SELECT *, {roll('stddev_samp', 'ret', 20, 'date')} AS vol FROM rets)
SELECT series_id, {day('date', 'date')}, {num('coalesce(vol, 0)', 'constant')}, {num('coalesce(vol, (SELECT avg(vol) FROM v))', 'with_mean')},
  {num('coalesce(vol, (SELECT stddev_samp(vol) FROM v))', 'with_std')}, {num('coalesce(vol, median(vol) OVER (PARTITION BY series_id))', 'with_median')}
FROM v""")
def filled_gaps(spark, sf):
    from tidemark.operators.features import fill_missing

    df = returns(spark, sf).withColumn("vol", S.rolling("ret", "std", 20, **K))
    df = df.select("series_id", "date", *[F.col("vol").alias(c) for c in ("constant", "with_mean", "with_std", "with_median")])
    df = fill_missing(df, "constant", 0.0)
    df = fill_missing(df, "with_mean", "mean")
    df = fill_missing(df, "with_std", "std")
    return shown(fill_missing(df, "with_median", "median", by=["series_id"]))
