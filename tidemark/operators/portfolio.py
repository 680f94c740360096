"""Portfolio moments, performance, random portfolios and long-only optimisation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import ratio
from tidemark.operators.ordering import key_digest
from tidemark.operators.panel import both_ways, correlation, covariance, pair_moments
from tidemark.session import fan_out

TRADING_DAYS = 365
RISK_FREE = 0.045


def annualised_moments(
    returns: DataFrame, periods: int = TRADING_DAYS, ts: str = "date", value: str = "ret", by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Annualised mean per series and covariance (ddof 1) per pair of series, long.

    ``by`` separates baskets, each with its own moments.
    """
    mean = returns.groupBy(*by, "series_id").agg((F.avg(value) * periods).alias("mean_return"))
    upper = pair_moments(returns, value, by, ts).withColumn("value", covariance() * periods)
    return mean, both_ways(upper, by)


def correlation_matrix(returns: DataFrame, ts: str = "date", value: str = "ret") -> DataFrame:
    """Full-period correlation, long: ``i, j, value``."""
    upper = pair_moments(returns, value, (), ts)
    return both_ways(upper.withColumn("value", F.when(F.col("i") == F.col("j"), 1.0).otherwise(correlation())))


def portfolio_performance(weights: DataFrame, mean: DataFrame, cov: DataFrame, rf: float = RISK_FREE, key: str = "portfolio_id") -> DataFrame:
    """Expected return, volatility and Sharpe ratio of every portfolio.

    ``weights`` is long (portfolio, series, weight). The covariance product is
    two joins on the asset, with the partial sum per asset in between.
    """
    ret = weights.join(mean, "series_id").groupBy(key).agg(F.sum(F.col("weight") * F.col("mean_return")).alias("ret"))
    inner = (
        weights.join(cov, weights.series_id == cov.j)
        .groupBy(key, "i").agg(F.sum(F.col("weight") * F.col("value")).alias("_inner"))
    )
    own = weights.select(key, F.col("series_id").alias("i"), "weight")
    risk = own.join(inner, [key, "i"]).groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("_inner"))).alias("vol"))
    return ret.join(risk, key).select(key, "ret", "vol", ratio(F.col("ret") - rf, "vol").alias("sharpe"))


def random_weights(mean: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """Uniform random long-only weights: normalised exponentials of hashed draws.

    Every asset row spreads over the portfolio numbers, so no product of two
    tables is needed and a rerun of a task draws the same numbers.
    """
    spread = mean.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("portfolio_id"))
    bits = F.conv(F.substring(key_digest(["portfolio_id", "series_id"], seed), 1, 13), 16, 10).cast("long")
    draw = -F.log((bits + 0.5) / F.lit(float(2**52)))
    drawn = spread.withColumn("_e", draw)
    total = F.sum("_e").over(Window.partitionBy("portfolio_id"))
    return drawn.select("portfolio_id", "series_id", (F.col("_e") / total).alias("weight"))


def random_portfolios(mean: DataFrame, cov: DataFrame, n: int = 5000, seed: int = 42, rf: float = RISK_FREE) -> DataFrame:
    return portfolio_performance(random_weights(mean, n, seed), mean, cov, rf)


def _long_only(cov: np.ndarray, a: np.ndarray, start: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Minimise ``w' cov w`` over ``a w = a start, w >= 0`` by an active set of zero weights."""
    w = start.astype(float).copy()
    free = w > 0
    for _ in range(rounds):
        idx = np.flatnonzero(free)
        k, m = len(idx), len(a)
        kkt = np.zeros((k + m, k + m))
        kkt[:k, :k] = cov[np.ix_(idx, idx)]
        kkt[:k, k:] = a[:, idx].T
        kkt[k:, :k] = a[:, idx]
        rhs = np.concatenate([-(cov @ w)[idx], np.zeros(m)])
        sol = np.linalg.lstsq(kkt, rhs, rcond=None)[0]
        step = sol[:k]
        if np.abs(step).max(initial=0.0) < 1e-12:
            slack = cov @ w + a.T @ sol[k:]
            slack[free] = 0.0
            worst = int(np.argmin(slack))
            if slack[worst] >= -1e-10:
                break
            free[worst] = True
            continue
        down = np.flatnonzero(step < 0)
        ratios = -w[idx[down]] / step[down]
        if len(down) and ratios.min() < 1.0:
            hit = idx[down[int(np.argmin(ratios))]]
            w[idx] += max(ratios.min(), 0.0) * step
            w[hit] = 0.0
            free[hit] = False
        else:
            w[idx] += step
    else:  # not at the optimum: no answer is better than a wrong one
        return np.full(len(w), np.nan)
    return np.maximum(w, 0.0)


def min_volatility(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    start = np.zeros(len(mean))
    start[int(np.argmin(np.diag(cov)))] = 1.0
    return _long_only(cov, np.ones((1, len(mean))), start)


def max_sharpe(mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray | None:
    """None when no asset beats the risk-free rate: the ratio has no convex optimum then."""
    excess = mean - rf
    best = int(np.argmax(excess))
    if excess[best] <= 0:
        return None
    start = np.zeros(len(mean))
    start[best] = 1.0 / excess[best]
    y = _long_only(cov, excess[None, :], start)
    return y / y.sum()


def at_return(mean: np.ndarray, cov: np.ndarray, target: float) -> np.ndarray:
    lo, hi = int(np.argmin(mean)), int(np.argmax(mean))
    start = np.zeros(len(mean))
    span = mean[hi] - mean[lo]
    part = min(max((target - mean[lo]) / span, 0.0), 1.0) if span > 0 else 1.0
    start[hi] += part
    start[lo] += 1.0 - part
    return _long_only(cov, np.vstack([np.ones(len(mean)), mean]), start)


@dataclass
class Frontier:
    """The long-only efficient frontier by its turning points, from the greatest return down to the least variance.

    Between two of them weights and returns are straight lines of the price of
    return ``trade``, which falls to zero at the least variance.
    """

    trade: np.ndarray
    weights: np.ndarray
    returns: np.ndarray

    def at(self, target: float) -> np.ndarray:
        """Weights of the efficient portfolio with a return; the ends beyond the frontier."""
        k = int(np.searchsorted(-self.returns, -target))
        if k == 0 or k == len(self.returns):
            return self.weights[min(k, len(self.returns) - 1)]
        high, low = self.returns[k - 1], self.returns[k]
        share = (high - target) / (high - low) if high > low else 1.0
        return (1 - share) * self.weights[k - 1] + share * self.weights[k]

    def best_ratio(self, mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray | None:
        """The greatest excess return per volatility; none if no asset beats the risk-free rate.

        On a segment the ratio has one stationary point, where the straight line
        from the risk-free rate touches the parabola of the variance.
        """
        if not mean.max() > rf:
            return None
        found = [self.weights[0], self.weights[-1]]
        for u, v in itertools.pairwise(self.weights):
            d = v - u
            e0, e1 = float(u @ mean) - rf, float(d @ mean)
            q0, q1, q2 = float(u @ cov @ u), float(u @ cov @ d), float(d @ cov @ d)
            below = e1 * q1 - e0 * q2
            t = (e0 * q1 - e1 * q0) / below if below else 0.0
            found.append(u + min(max(t, 0.0), 1.0) * d)
        ratio = [(float(w @ mean) - rf) / math.sqrt(max(float(w @ cov @ w), 1e-300)) for w in found]
        return found[int(np.argmax(ratio))]


def critical_line(mean: np.ndarray, cov: np.ndarray) -> Frontier | None:
    """All turning points of ``min w' cov w / 2 - trade * mean w`` over long-only weights of sum one.

    While the same assets are held, their weights are ``a + trade * b``. As the
    price of return falls, the next event is that a weight reaches zero or that
    an asset left out is as good as those held. None if events do not come to an
    end, as may happen without a proper covariance matrix.
    """
    n = len(mean)
    top = np.flatnonzero(mean >= mean.max())
    start = np.zeros(n)
    start[top[int(np.argmin(np.diag(cov)[top]))]] = 1.0
    if len(top) > 1:
        start[top] = _long_only(cov[np.ix_(top, top)], np.ones((1, len(top))), start[top])
    held = start > 0
    trade, trades, points = math.inf, [], []
    for _ in range(20 * n + 20):
        idx = np.flatnonzero(held)
        k = len(idx)
        kkt = np.ones((k + 1, k + 1))
        kkt[:k, :k], kkt[k, k] = cov[np.ix_(idx, idx)], 0.0
        rhs = np.zeros((k + 1, 2))
        rhs[k, 0], rhs[:k, 1] = 1.0, mean[idx]
        solved = np.linalg.lstsq(kkt, rhs, rcond=None)[0]
        a, b = np.zeros(n), np.zeros(n)
        a[idx], b[idx] = solved[:k, 0], solved[:k, 1]
        slack, slope = cov @ a + solved[k, 0], cov @ b + solved[k, 1] - mean
        events = np.full(n, -math.inf)
        leaves = held & (b > 1e-14)
        events[leaves] = -a[leaves] / b[leaves]
        enters = ~held & (slope > 1e-14)
        events[enters] = -slack[enters] / slope[enters]
        # An event just behind is one that rounding has put there.
        late = events > trade
        events[late] = np.where(events[late] <= trade * (1 + 1e-9) + 1e-12, trade, -math.inf)
        which = int(np.argmax(events))
        here = max(float(events[which]), 0.0)
        weights = np.maximum(a + here * b, 0.0)
        trades.append(here)
        points.append(weights / weights.sum())
        if here <= 0.0:
            points.insert(0, start)
            trades.insert(0, math.inf)
            points = np.array(points)
            return Frontier(np.array(trades), points, points @ mean)
        held[which] = ~held[which]
        trade = here
    return None


def optimize_portfolios(
    mean: DataFrame, cov: DataFrame, goals: Sequence[str] = ("max_sharpe", "min_vol"), n_frontier: int = 60,
    rf: float = RISK_FREE, basket: str = "basket",
) -> DataFrame:
    """Best long-only portfolios of many baskets at once.

    The moments of a basket become two arrays (its size is the number of its
    assets), once; its turning points give every goal and frontier point. Baskets
    are solved in parallel. A basket with assets that never traded on a common date
    has no covariance matrix, and one without excess return no best ratio:
    their rows come back with nulls.
    """
    vec = mean.groupBy(basket).agg(F.array_sort(F.collect_list(F.struct("series_id", "mean_return"))).alias("_m"))
    mat = cov.groupBy(basket).agg(F.array_sort(F.collect_list(F.struct("i", "j", "value"))).alias("_c"))
    tasks = vec.join(mat, basket).select(basket, F.col("_m.series_id").alias("ids"), F.col("_m.mean_return").alias("mu"), F.col("_c.value").alias("sigma"))
    tasks = fan_out(tasks, basket)
    kind = mean.schema[basket].dataType.simpleString()
    wanted = [(g, 0) for g in goals] + [("frontier", k) for k in range(n_frontier)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, ids, mu, sigma in zip(pdf[basket], pdf["ids"], pdf["mu"], pdf["sigma"]):
                mu, sigma = np.asarray(mu, dtype=float), np.asarray(sigma, dtype=float)
                line = critical_line(mu, sigma.reshape(len(mu), len(mu))) if len(sigma) == len(mu) ** 2 else None
                for goal, point in wanted:
                    w = None
                    if line is not None:
                        sigma = sigma.reshape(len(mu), len(mu))
                        low, high = float(line.returns[-1]), float(mu.max())
                        share = point / max(n_frontier - 1, 1)
                        w = line.best_ratio(mu, sigma, rf) if goal == "max_sharpe" else line.weights[-1] if goal == "min_vol" else line.at(low + share * (high - low))
                    if w is None:
                        out.append((name, goal, point, None, None, None, None))
                        continue
                    ret, vol = float(w @ mu), float(np.sqrt(max(w @ sigma @ w, 0.0)))
                    out.append((name, goal, point, ret, vol, (ret - rf) / vol if vol else None, dict(zip(ids, w.tolist()))))
            yield pd.DataFrame(out, columns=[basket, "goal", "point", "ret", "vol", "sharpe", "weights"])

    return tasks.mapInPandas(solve, f"{basket} {kind}, goal string, point int, ret double, vol double, sharpe double, weights map<string,double>")
