"""Pair trading: hedge ratios, unit-root and cointegration tests, costs and backtests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators.backtest import DAYS_PER_YEAR, sharpe, sortino
from tidemark.operators.gram import grouped_gram, unpack
from tidemark.operators.ordering import cumulative, drawdown, drop_blocks, split_blocks
from tidemark.operators.panel import pair_moments
from tidemark.operators.tiles import per_tile_pair

PAIR = ("pair",)

# Response surfaces of MacKinnon (1994) for the p-value of the
# Dickey-Fuller statistic with a constant, for one and two variables. The lower
# polynomial holds up to "knee", the upper one above it.
P_SURFACE = {
    1: {"min": -18.83, "knee": -1.61, "max": 2.74, "lower": (2.1659, 1.4412, 0.038269), "upper": (1.7339, 0.93202, -0.12745, -0.010368)},
    2: {"min": -18.86, "knee": -2.62, "max": 0.92, "lower": (2.92, 1.5012, 0.039796), "upper": (2.1945, 0.64695, -0.29198, -0.042377)},
}
# Finite-sample critical values of MacKinnon (2010), as
# polynomials in 1/T, at 1, 5 and 10 percent, with a constant.
CRITICAL = {
    1: {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809)},
    2: {"1%": (-3.89644, -10.9519, -22.527), "5%": (-3.33613, -6.1101, -6.823), "10%": (-3.04445, -4.2412, -2.720)},
}


def _poly(coefs: Sequence[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefs))


def unit_root_pvalue(stat: float, n_vars: int) -> float:
    s = P_SURFACE[n_vars]
    if stat > s["max"]:
        return 1.0
    if stat < s["min"]:
        return 0.0
    z = _poly(s["lower"] if stat <= s["knee"] else s["upper"], stat)
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def critical_value(level: str, n_vars: int, n_obs: int) -> float:
    return _poly(CRITICAL[n_vars][level], 1.0 / n_obs)


def grouped_ols(df: DataFrame, y: str = "y", x: str = "x", by: Sequence[str] = PAIR) -> DataFrame:
    """Slope, intercept and R2 of ``y`` on ``x`` per group, in one aggregate."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_r2(y, x).alias("r_squared")
    )


def spread(pairs: DataFrame, hedge: DataFrame, y: str = "y", x: str = "x", by: Sequence[str] = PAIR) -> DataFrame:
    """``y - (alpha + beta * x)`` with each pair's hedge; the hedge has one row per pair."""
    joined = pairs.join(hedge.select(*by, "alpha", "beta"), list(by))
    return joined.withColumn("spread", F.col(y) - (F.col("alpha") + F.col("beta") * F.col(x)))


def schwert_lags(n: int, n_trend: int) -> int:
    """Largest lag order tried for ``n`` values (Schwert 1989)."""
    return max(0, min(n // 2 - n_trend - 1, math.ceil(12.0 * (n / 100.0) ** 0.25)))


def _t_stat(gram: np.ndarray, keep: Sequence[int], target: int, n: int) -> tuple[float, float]:
    """t value of the first kept column and the residual sum of squares."""
    a = gram[np.ix_(keep, keep)]
    b = gram[keep, target]
    inv = np.linalg.pinv(a)
    w = inv @ b
    sse = max(float(gram[target, target] - w @ b), 0.0)
    dof = n - len(keep)
    se = math.sqrt(sse / dof * inv[0, 0]) if dof > 0 and sse > 0 else float("nan")
    return float(w[0]) / se if se and se == se else float("nan"), sse


def _unit_root_row(gram: np.ndarray, n_trim: int, head: np.ndarray, n: int, lags: int, constant: bool, n_vars: int) -> tuple:
    """Choose the lag order by AIC on the common sample, refit on all usable rows.

    Columns of the Gram matrix: level, differences at lag 1..L, constant, and
    the current difference as target. ``head`` holds the first values, which
    complete the sample once fewer lags are needed.
    """
    width = gram.shape[0]
    target, one = width - 1, width - 2
    best, best_aic = 0, float("inf")
    for k in range(lags + 1):
        keep = [0, *range(1, k + 1)] + ([one] if constant else [])
        _, sse = _t_stat(gram, keep, target, n_trim)
        aic = n_trim * math.log(max(sse, 1e-300) / n_trim) + 2 * len(keep)
        if aic < best_aic - 1e-12:
            best, best_aic = k, aic
    full = gram.copy()
    d = np.diff(head)
    extra = 0
    for t in range(best, min(lags, len(d))):
        row = np.zeros(width)
        row[0], row[one], row[target] = head[t], 1.0, d[t]
        row[1 : best + 1] = d[t - best : t][::-1]
        full += np.outer(row, row)
        extra += 1
    keep = [0, *range(1, best + 1)] + ([one] if constant else [])
    n_obs = n_trim + extra
    stat, _ = _t_stat(full, keep, target, n_obs)
    crit_n = n_obs if n_vars == 1 else n - 1
    crit = [critical_value(level, n_vars, crit_n) for level in ("1%", "5%", "10%")]
    p = unit_root_pvalue(stat, n_vars) if stat == stat else float("nan")
    return stat, p, best, n_obs, *crit


UNIT_ROOT_FIELDS = "statistic double, p_value double, used_lag int, n_obs long, crit_1 double, crit_5 double, crit_10 double"


def unit_root(
    df: DataFrame, col: str, by: Sequence[str], ts: str, constant: bool, n_vars: int, longest: int | None = None, most: int | None = None,
) -> DataFrame:
    """Augmented Dickey-Fuller statistic per group, for all groups in one job.

    Lagged differences come from one window per group, their cross products
    from a map-side combined aggregate; only a matrix of about 30 columns per
    group is then solved. ``longest`` bounds the length of a group and is
    counted when it is not given; ``most`` bounds the lag order.
    """
    by = list(by)
    rows = df.filter(F.col(col).isNotNull())
    if longest is None:
        longest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    top = schwert_lags(longest, 0) if most is None else min(most, schwert_lags(longest, 0))
    w = S.ordered(by, ts)
    lagged = rows.withColumns(
        {
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*by)),
            "_t": F.row_number().over(w) - 1,
            "_level": F.lag(col).over(w),
        }
    )
    lagged = lagged.withColumn("_d", F.col(col) - F.col("_level"))
    n_trend = 1 if constant else 0
    schwert = F.ceil(12.0 * F.pow(F.col("_n") / 100.0, 0.25))
    lags = F.greatest(F.lit(0), F.least(F.floor(F.col("_n") / 2) - n_trend - 1, schwert, F.lit(top))).cast("int")
    lagged = lagged.withColumn("_lags", lags)
    history = [F.lag("_d", k).over(w) for k in range(1, top + 1)]
    past = [F.when(F.lit(k) <= F.col("_lags"), h).otherwise(0.0) for k, h in enumerate(history, 1)]
    row = F.array(F.col("_level"), *past, F.lit(1.0), F.col("_d"))
    usable = lagged.withColumn("_row", row).filter(F.col("_t") > F.col("_lags")).select(
        *by, "_n", "_lags", (F.col("_t") == F.col("_lags") + 1).alias("_first"), "_row"
    )
    # The first usable row is kept apart: its lags give back the values before it.
    width = top + 3
    grams = grouped_gram(usable, "_row", width, [*by, "_n", "_lags", "_first"])
    both = grams.groupBy(*by, "_n", "_lags").agg(
        F.sum("n_rows").alias("rows_used"),
        F.first(F.when(F.col("_first"), F.col("gram")), ignorenulls=True).alias("first_gram"),
        F.first(F.when(~F.col("_first"), F.col("gram")), ignorenulls=True).alias("rest_gram"),
    )
    names = [f.split()[0] for f in UNIT_ROOT_FIELDS.split(", ")]
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                gram = unpack(r.first_gram, width)
                lags = int(r.lags)
                first = gram[width - 2]
                past_d = first[1 : lags + 1][::-1]
                start = first[0] - past_d.sum()
                head = start + np.concatenate([[0.0], np.cumsum(past_d), [past_d.sum() + first[-1]]])
                if r.rest_gram is not None:
                    gram = gram + unpack(r.rest_gram, width)
                key = tuple(getattr(r, b) for b in by)
                out.append((*key, *_unit_root_row(gram, int(r.rows_used), head, int(r.n), lags, constant, n_vars)))
            yield pd.DataFrame(out, columns=[*by, *names])

    tidy = both.select(*by, "rows_used", "first_gram", "rest_gram", F.col("_n").alias("n"), F.col("_lags").alias("lags"))
    return tidy.mapInPandas(solve, f"{keys}, {UNIT_ROOT_FIELDS}")


def adf_test(df: DataFrame, col: str, by: Sequence[str] = S.SERIES, ts: str = "ts", most: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the lag order is chosen by AIC, up to ``most``."""
    out = unit_root(df, col, by, ts, constant=True, n_vars=1, most=most)
    return out.withColumn("is_stationary_5pct", F.col("p_value") < 0.05)


def engle_granger(
    pairs: DataFrame, y: str = "y", x: str = "x", by: Sequence[str] = PAIR, ts: str = "date", longest: int | None = None,
) -> DataFrame:
    """Engle-Granger test: OLS residuals per pair, then Dickey-Fuller without a constant.

    The regression runs as a window over the pair, on the partitioning that the
    lags need as well, so the pairs move once.
    """
    whole = Window.partitionBy(*by)
    fitted = pairs.withColumns(
        {"_b": F.regr_slope(y, x).over(whole), "_a": F.regr_intercept(y, x).over(whole)}
    )
    residuals = fitted.select(*by, ts, (F.col(y) - (F.col("_a") + F.col("_b") * F.col(x))).alias("spread"))
    out = unit_root(residuals, "spread", by, ts, constant=False, n_vars=2, longest=longest)
    return out.withColumn("cointegrated_5pct", F.col("p_value") < 0.05)


def unit_root_of(values: np.ndarray, constant: bool, n_vars: int, most: int | None = None, chunk: int = 8192) -> tuple | None:
    """Augmented Dickey-Fuller test of one series in order, its lag order chosen by AIC up to ``most``.

    Cross products of level, lagged differences and the current difference are
    added over stretches of ``chunk`` rows. A series too short for its longest
    lag has no test.
    """
    n, diffs = len(values), np.diff(values)
    lags = schwert_lags(n, 1 if constant else 0)
    lags = lags if most is None else min(lags, most)
    if n < lags + 3:
        return None
    gram = np.zeros((lags + 3, lags + 3))
    for start in range(lags, n - 1, chunk):
        t = np.arange(start, min(start + chunk, n - 1))
        rows = np.column_stack([values[t], *[diffs[t - k] for k in range(1, lags + 1)], np.ones(len(t)), diffs[t]])
        gram += rows.T @ rows
    return _unit_root_row(gram, n - 1 - lags, values[: lags + 2], n, lags, constant, n_vars)


def tile_tests(names, others, y: np.ndarray, x: np.ndarray, most: int | None = None) -> pd.DataFrame:
    """Engle-Granger test of every pair of two tiles over the pair's common dates."""
    out = []
    there_y, there_x = ~np.isnan(y), ~np.isnan(x)
    for i, one in enumerate(names):
        for j, other in enumerate(others):
            if one >= other:
                continue
            both = there_y[:, i] & there_x[:, j]
            a, b = y[both, i], x[both, j]
            if len(a) < 3:
                continue
            spread_x = b - b.mean()
            var = float(spread_x @ spread_x)
            if not var > 0:
                continue
            slope = float(spread_x @ (a - a.mean())) / var
            found = unit_root_of(a - a.mean() - slope * spread_x, False, 2, most)
            if found is not None:
                out.append((f"{one}/{other}", one, other, found[0], found[1], found[2]))
    return pd.DataFrame(out, columns=["pair", "y_id", "x_id", "eg_statistic", "eg_pvalue", "used_lag"])


def screen_pairs(prices: DataFrame, ts: str = "date", most: int | None = None) -> DataFrame:
    """Engle-Granger on log prices for every pair of series, best p-value first.

    Two tiles of series meet in a task; a pair is a row only in the result. Pairs
    with too few common dates, or a series that does not vary, are left out.
    ``most`` bounds the lag order that AIC chooses.
    """
    logs = prices.select("series_id", ts, F.log("price").alias("price"))
    schema = "pair string, y_id string, x_id string, eg_statistic double, eg_pvalue double, used_lag int"
    tested = per_tile_pair(logs, lambda names, others, _, y, x: tile_tests(names, others, y, x, most), schema, ts=ts)
    return tested.withColumn("cointegrated_5pct", F.col("eg_pvalue") < 0.05).orderBy("eg_pvalue", "pair")


def pair_hedges(prices: DataFrame, value: str = "price", ts: str = "date", series: str = "series_id") -> DataFrame:
    """Slope, intercept and R2 of the lesser series on the greater one for every pair, from their moments.

    Dates are reduced to sums by matrix products before anything is shuffled, so
    no row for a pair and a date is made.
    """
    known = prices.filter(F.col(value).isNotNull())
    cells = pair_moments(prices, value, ts=ts, series=series).filter(F.col("i") < F.col("j"))
    origin = known.groupBy(series).agg(F.min(F.col(value).cast("double")).alias("o"))
    cells = cells.join(origin.select(F.col(series).alias("i"), F.col("o").alias("oy")), "i").join(origin.select(F.col(series).alias("j"), F.col("o").alias("ox")), "j")
    vx, vy = F.col("sxx"), F.col("syy")
    # The moments name the lesser series i and its sums x.
    vi, vj = vx - F.col("sx") * F.col("sx") / F.col("n"), vy - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    beta = F.when(vj > 0, cov / vj)
    alpha = F.col("oy") + F.col("sx") / F.col("n") - beta * (F.col("ox") + F.col("sy") / F.col("n"))
    r2 = F.when(vj > 0, F.when(vi > 0, cov * cov / (vi * vj)).otherwise(1.0))
    return cells.select(F.concat_ws("/", "i", "j").alias("pair"), F.col("i").alias("y_id"), F.col("j").alias("x_id"), beta.alias("beta"), alpha.alias("alpha"), r2.alias("r_squared"))


# Pair trading costs in basis points per leg.
PAIR_TAKER_BPS = 10.0
PAIR_ENTRY_BPS = 5.0
PAIR_EXIT_BPS = 2.0


def pair_costs(
    df: DataFrame, position: str = "position", taker: float = PAIR_TAKER_BPS, entry: float = PAIR_ENTRY_BPS,
    exit: float = PAIR_EXIT_BPS, out: str = "transaction_cost", by: Sequence[str] = PAIR, ts: str = "date",
) -> DataFrame:
    """Costs of both legs when the position changes; a direct flip pays an exit and an entry."""
    now, was = F.col(position), F.lag(position, 1, 0).over(S.ordered(by, ts))
    open_cost = F.lit((taker + entry) / 10_000.0 * 2)
    close_cost = F.lit((taker + exit) / 10_000.0 * 2)
    opened = F.when((now != 0) & (now != was), open_cost).otherwise(0.0)
    closed = F.when((was != 0) & (now != was), close_cost).otherwise(0.0)
    return df.withColumn(out, opened + closed)


def pair_returns(
    df: DataFrame, beta: Column | str = "beta", position: str = "position", y: str = "y", x: str = "x",
    include_costs: bool = True, lag_beta: bool = False, by: Sequence[str] = PAIR, ts: str = "date",
    block_rows: int | None = None,
) -> DataFrame:
    """Daily gross and net returns and equity of the spread position held since yesterday.

    A filtered hedge ratio has already seen today's price. ``lag_beta=True``
    uses yesterday's instead; the default follows the published results.
    """
    w = S.ordered(by, ts)
    b = F.col(beta) if isinstance(beta, str) else beta
    costs = pair_costs(df, position, by=by, ts=ts) if include_costs else df.withColumn("transaction_cost", F.lit(0.0))
    costs = costs.withColumn("_beta", b)
    used = F.lag("_beta").over(w) if lag_beta else F.col("_beta")
    held = F.lag(position).over(w)
    move = S.simple_return(y, by, ts) - used * S.simple_return(x, by, ts)
    rows = costs.withColumns({"prev_position": held, "gross_return": F.coalesce(held * move, F.lit(0.0))}).drop("_beta")
    rows = rows.withColumn("strategy_return", F.col("gross_return") - F.col("transaction_cost"))
    if block_rows:
        rows = split_blocks(rows, by, ts, block_rows)
    rows = cumulative(
        rows,
        {"equity_gross": ("product", 1 + F.col("gross_return")), "equity": ("product", 1 + F.col("strategy_return"))},
        by, ts,
    )
    return drop_blocks(drawdown(rows, "equity", "drawdown", by, ts))


def pair_summary(rows: DataFrame, position: str = "position", by: Sequence[str] = PAIR, ts: str = "date", periods: int = DAYS_PER_YEAR) -> DataFrame:
    """Totals, ratios, trades and win rate per pair.

    The first row has no previous position and counts as active, and an entry
    on it is no trade, as in the published results.
    """
    r, was, now = F.col("strategy_return"), F.col("prev_position"), F.col(position)
    active = F.coalesce(was != 0, F.lit(True))
    return rows.groupBy(*by).agg(
        (F.max_by("equity_gross", ts) - 1).alias("total_return_gross"),
        (F.max_by("equity", ts) - 1).alias("total_return"),
        sharpe(r, periods).alias("sharpe"),
        sortino(r, periods).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(F.when((now != was) & (now != 0), 1)).alias("n_trades"),
        F.coalesce(F.avg(F.when(active, (r > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.sum("transaction_cost").alias("total_transaction_cost"),
    )


def pair_backtest(df: DataFrame, **kw) -> DataFrame:
    """Summary of ``pair_returns`` per pair."""
    rows = pair_returns(df, **kw)
    keys = {k: kw[k] for k in ("position", "by", "ts") if k in kw}
    return pair_summary(rows, **keys)
