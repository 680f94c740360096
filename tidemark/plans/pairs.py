"""Queries on pairs: hedge ratios, tests, positions and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import bars as B
from tidemark.operators import evaluate as E
from tidemark.operators import gram as Gm
from tidemark.operators import kalman as Kf
from tidemark.operators import ordering as O
from tidemark.operators import pairs as P
from tidemark.plans import views as V
from tidemark.plans.market import _impact
from tidemark.plans.market import IMPACT_SQL
from tidemark.plans.registry import big, day, num, nums, query, shown
from tidemark.plans.series import BAND_SQL

PAIRS_SQL = """pairs AS (SELECT a.series_id || '/' || b.series_id AS pair, a.series_id AS y_id, b.series_id AS x_id, a.date, a.{v} AS y, b.{v} AS x
  FROM {src} a JOIN {src} b ON a.date = b.date AND a.series_id < b.series_id)"""
LOG_SQL = "logs AS (SELECT series_id, date, round(ln(1000 + price / 100), 9) AS lp FROM panel)"


def log_prices(spark, sf, view):
    """Log of the price plus a base amount, cut to nine digits in both engines."""
    return view(spark, sf).select("series_id", "date", F.round(F.log(1000 + F.col("price") / 100), 9).alias("price"))


def region_pairs(spark, sf):
    return B.pair_panel(log_prices(spark, sf, V.region_panel))


REGION_PAIRS_SQL = f"{V.REGION_PANEL_SQL}, {LOG_SQL}, {PAIRS_SQL.format(src='logs', v='lp')}"
BRAND_PAIRS_SQL = f"{V.PANEL_SQL}, {LOG_SQL}, {PAIRS_SQL.format(src='logs', v='lp')}"


@query("pair_panel", f"""WITH {REGION_PAIRS_SQL} SELECT pair, y_id, x_id, {day('date', 'date')}, {nums('y x')} FROM pairs""")
def pair_panel(spark, sf):
    return shown(region_pairs(spark, sf))


@query("hedge_ratios", f"""WITH {BRAND_PAIRS_SQL}
SELECT pair, {num('regr_slope(y, x)', 'beta')}, {num('regr_intercept(y, x)', 'alpha')}, {num('regr_r2(y, x)', 'r_squared')} FROM pairs GROUP BY pair""")
def hedge_ratios(spark, sf):
    """Static hedge of every pair of brands."""
    return shown(P.pair_hedges(log_prices(spark, sf, V.panel)).select("pair", "beta", "alpha", "r_squared"))


SPREAD_SQL = f"""{REGION_PAIRS_SQL},
hedge AS (SELECT pair, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM pairs GROUP BY pair),
spreads AS (SELECT p.*, beta, alpha, y - (alpha + beta * x) AS spread FROM pairs p JOIN hedge USING (pair)),
zs AS (SELECT *, row_number() OVER w AS rn, CASE WHEN count(spread) OVER f >= 30 THEN (spread - avg(spread) OVER f) / stddev_samp(spread) OVER f END AS z
  FROM spreads WINDOW w AS (PARTITION BY pair ORDER BY date), f AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def spread_scores(spark, sf):
    pairs = region_pairs(spark, sf)
    out = P.spread(pairs, P.grouped_ols(pairs))
    return out.withColumn("zscore", S.rolling_zscore("spread", 30, by=("pair",), ts="date"))


@query("pair_spread", f"""WITH {SPREAD_SQL} SELECT pair, {day('date', 'date')}, {nums('spread')}, {num('z', 'zscore')} FROM zs""")
def pair_spread(spark, sf):
    return shown(spread_scores(spark, sf).select("pair", "date", "spread", "zscore"))


def positions(spark, sf):
    return O.hysteresis(spread_scores(spark, sf), "zscore", by=("pair",), ts="date")


POSITION_SQL = f"""{SPREAD_SQL},
{BAND_SQL.format(name='band', key='pair', ts='date', src='zs')},
held AS (SELECT zs.*, CASE WHEN band.z IS NULL THEN 0 ELSE pos END AS position FROM zs JOIN band USING (pair, rn))"""

COST_SQL = """costed AS (SELECT *, lag(position) OVER w AS prev,
    CASE WHEN position <> 0 AND position <> lag(position, 1, 0) OVER w THEN 0.0030 ELSE 0 END
  + CASE WHEN lag(position, 1, 0) OVER w <> 0 AND position <> lag(position, 1, 0) OVER w THEN 0.0024 ELSE 0 END AS cost
  FROM held WINDOW w AS (PARTITION BY pair ORDER BY date))"""

BACKTEST_SQL = COST_SQL + """,
moved AS (SELECT *, coalesce(prev * ((y / lag(y) OVER w - 1) - beta * (x / lag(x) OVER w - 1)), 0) AS gross
  FROM costed WINDOW w AS (PARTITION BY pair ORDER BY date)),
curves AS (SELECT *, gross - cost AS net, product(1 + gross) OVER w AS eq_gross, product(1 + gross - cost) OVER w AS eq
  FROM moved WINDOW w AS (PARTITION BY pair ORDER BY date)),
falls AS (SELECT *, eq / max(eq) OVER (PARTITION BY pair ORDER BY date) - 1 AS dd FROM curves)"""

SUMMARY_SQL = f"""SELECT pair, {num('arg_max(eq_gross, date) - 1', 'total_return_gross')}, {num('arg_max(eq, date) - 1', 'total_return')},
  {num('CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(365) ELSE 0 END', 'sharpe')},
  {num('avg(net) / nullif(sqrt(avg(least(net, 0) * least(net, 0))), 0) * sqrt(365)', 'sortino')}, {num('min(dd)', 'max_drawdown')},
  {big('count(*) FILTER (position <> prev AND position <> 0)', 'n_trades')},
  {num('coalesce(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (coalesce(prev <> 0, true)), 0)', 'win_rate')},
  {num('sum(cost)', 'total_transaction_cost')} FROM falls GROUP BY pair"""


@query("pair_costs", f"""WITH RECURSIVE {POSITION_SQL}, {COST_SQL}
SELECT pair, {day('date', 'date')}, {big('position')}, {num('cost', 'transaction_cost')} FROM costed""")
def pair_costs(spark, sf):
    return shown(P.pair_costs(positions(spark, sf)).select("pair", "date", "position", "transaction_cost"))


@query("pair_backtest", f"WITH RECURSIVE {POSITION_SQL}, {BACKTEST_SQL} {SUMMARY_SQL}")
def pair_backtest(spark, sf):
    """Static hedge, band positions, both legs' costs."""
    return shown(P.pair_backtest(positions(spark, sf)))


@query("ranked_pairs", f"WITH RECURSIVE {POSITION_SQL}, {BACKTEST_SQL}, s AS ({SUMMARY_SQL}) SELECT pair, sharpe, total_return, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, pair) AS rank FROM s")
def ranked_pairs(spark, sf):
    """Pairs by the Sharpe ratio of their backtest."""
    rows = shown(P.pair_backtest(positions(spark, sf)))
    return shown(E.ranked(rows, "sharpe", ["pair"]).select("pair", "sharpe", "total_return", "rank"))


KALMAN_SQL = f"""{REGION_PAIRS_SQL},
obs AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY date) AS rn FROM pairs),
burn AS (SELECT pair, greatest((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / 58, 1e-8) AS r0 FROM obs WHERE rn <= 60 GROUP BY pair),
seed AS (SELECT o.*, r0, 1e-4 / (1 - 1e-4) AS q FROM obs o JOIN burn USING (pair)),
lists AS (SELECT pair, any_value(r0) AS r0, any_value(q) AS q, array_agg(y ORDER BY rn) AS ys, array_agg(x ORDER BY rn) AS xs, count(*) AS n FROM seed GROUP BY pair),
k AS (
  SELECT pair, 0::BIGINT AS t, 0::DOUBLE AS a, 0::DOUBLE AS b, 1e4::DOUBLE AS paa, 0::DOUBLE AS pab, 1e4::DOUBLE AS pbb, r0::DOUBLE AS r, 0::DOUBLE AS e, 0::DOUBLE AS s FROM lists
  UNION ALL
  SELECT pair, t, a + ga / s * e, b + gb / s * e, paa - ga / s * ga, pab - ga / s * gb, pbb - gb / s * gb,
    (1 - 2.0 / 31.0) * r + 2.0 / 31.0 * e * e, e, s
  FROM (SELECT *, ga + gb * x + r AS s FROM (SELECT *, paa + pab * x AS ga, pab + pbb * x AS gb, y - (a + b * x) AS e
    FROM (SELECT k.pair, k.t + 1 AS t, a, b, paa + q AS paa, pab, pbb + q AS pbb, r, ys[k.t + 1] AS y, xs[k.t + 1] AS x
      FROM k JOIN lists USING (pair) WHERE k.t < n)))),
filtered AS (SELECT obs.*, a AS alpha, b AS beta, e AS spread, s AS innovation_variance, e / sqrt(s) AS z FROM k JOIN obs ON k.pair = obs.pair AND k.t = obs.rn)"""


def filtered(spark, sf):
    return Kf.kalman_hedge(region_pairs(spark, sf))


@query("kalman_hedge", f"""WITH RECURSIVE {KALMAN_SQL}
SELECT pair, {day('date', 'date')}, {nums('alpha beta spread innovation_variance')}, {num('z', 'zscore')} FROM filtered""")
def kalman_hedge(spark, sf):
    return shown(filtered(spark, sf).select("pair", "date", *Kf.OUTPUT))


@query("kalman_backtest", f"""WITH RECURSIVE {KALMAN_SQL},
{BAND_SQL.format(name='band', key='pair', ts='date', src='filtered')},
held AS (SELECT filtered.*, pos AS position FROM filtered JOIN band USING (pair, rn)), {BACKTEST_SQL} {SUMMARY_SQL}""")
def kalman_backtest(spark, sf):
    """Filtered hedge ratio, its own z-score as signal, both legs' costs."""
    held = O.hysteresis(filtered(spark, sf), "zscore", by=("pair",), ts="date")
    return shown(P.pair_backtest(held))


@query("stationarity_tests")
def stationarity_tests(spark, sf):
    """Augmented Dickey-Fuller test of every brand's log price."""
    return shown(P.adf_test(log_prices(spark, sf, V.panel), "price", ts="date"))


@query("stationarity_lag0", f"""WITH {V.PANEL_SQL}, {LOG_SQL},
d AS (SELECT series_id, lag(lp) OVER w AS x, lp - lag(lp) OVER w AS y FROM logs WINDOW w AS (PARTITION BY series_id ORDER BY date)),
m AS (SELECT series_id, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_count(y, x) AS n FROM d GROUP BY series_id)
SELECT series_id, {num('b / sqrt((syy - b * sxy) / (n - 2) / sxx)', 'statistic', 4)}, {big('n', 'n_obs')} FROM m""")
def stationarity_lag0(spark, sf):
    """Dickey-Fuller test without lags of every brand's log price."""
    return shown(P.adf_test(log_prices(spark, sf, V.panel), "price", ts="date", most=0).select("series_id", "statistic", "n_obs"), 4)


@query("pair_screening_lag0", f"""WITH {V.QUOTES_SQL}, logs AS (SELECT series_id, date, ln(price) AS lp FROM quotes), {PAIRS_SQL.format(src='logs', v='lp')},
h AS (SELECT pair, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM pairs GROUP BY pair),
e AS (SELECT pair, y_id, x_id, date, y - (alpha + beta * x) AS e FROM pairs JOIN h USING (pair)),
d AS (SELECT pair, y_id, x_id, lag(e) OVER w AS l, e - lag(e) OVER w AS d FROM e WINDOW w AS (PARTITION BY pair ORDER BY date)),
m AS (SELECT pair, y_id, x_id, sum(l * d) AS ld, sum(l * l) AS ll, sum(d * d) AS dd, count(d) AS n FROM d GROUP BY ALL)
SELECT pair, y_id, x_id, {num('ld / ll / sqrt((dd - ld * ld / ll) / (n - 1) / ll)', 'eg_statistic', 4)} FROM m""")
def pair_screening_lag0(spark, sf):
    """Engle-Granger test without lags of all pairs of brands."""
    return shown(P.screen_pairs(V.quotes(spark, sf), most=0).select("pair", "y_id", "x_id", "eg_statistic"), 4)


@query("pair_screening")
def pair_screening(spark, sf):
    """Engle-Granger test of all pairs of brands, best first."""
    return shown(P.screen_pairs(V.quotes(spark, sf)))


GRAM_COLUMNS = ("trade_flow_imbalance", "near_depth_imbalance", "far_depth_imbalance", "future_return_1")


@query("cross_products", f"""WITH {IMPACT_SQL},
v AS (SELECT series_id, [1.0::DOUBLE, {', '.join(f'{c}::DOUBLE' for c in GRAM_COLUMNS)}] AS r FROM impact),
c AS (SELECT series_id, i, j, sum(r[i] * r[j]) AS s, count(*) AS n FROM v, range(1, 6) a(i), range(1, 6) b(j) WHERE i <= j GROUP BY ALL)
SELECT series_id, {big('n', 'n_rows')}, {big('row_number() OVER (PARTITION BY series_id ORDER BY i, j) - 1', 'cell')}, {num('s', 'total', 5)} FROM c""")
def cross_products(spark, sf):
    """Sums of products behind the linear models, per series."""
    row = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in GRAM_COLUMNS])
    gram = Gm.grouped_gram(_impact(spark, sf).withColumn("row", row), "row", 5, ["series_id"])
    cells = gram.select("series_id", "n_rows", F.posexplode("gram").alias("cell", "total"))
    return shown(cells, 5)
