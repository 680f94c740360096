import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kalman as K
from tidemark.operators import pairs as P
from tidemark.operators.audit import audit_lookahead
from tidemark.operators.bars import align_panel, pair_panel


def pair_frame(spark, parts):
    rows = []
    for name, (y, x) in parts.items():
        rows.append(pd.DataFrame({"pair": name, "date": pd.date_range("2020-01-01", periods=len(y)), "y": y, "x": x}))
    return spark.createDataFrame(pd.concat(rows, ignore_index=True)).repartition(4)


def cointegrated(n=400, seed=0):
    """A price that swings and drifts by fixed steps, and half of it plus averaged uniform noise."""
    rng = np.random.default_rng(seed)
    x = 3.5 + np.sin(np.arange(n) / 40) / 5 + 0.015 * np.cumsum(rng.choice([-1.0, 1.0], n))
    u = rng.uniform(-0.02, 0.02, n + 2)
    return 0.8 + 0.5 * x + (u[2:] + u[1:-1] + u[:-2]) / 3, x


def walks(n=400, seed=1):
    """Two unrelated prices made of signs."""
    rng = np.random.default_rng(seed)
    steps = 0.02 * rng.choice([-1.0, 1.0], (2, n))
    return tuple(4.2 + steps.cumsum(axis=1))


def brute_adf(e, constant):
    """Plain least squares, lag order by AIC on the common sample."""
    n = len(e)
    top = max(0, min(n // 2 - (1 if constant else 0) - 1, math.ceil(12 * (n / 100) ** 0.25)))
    d = np.diff(e)

    def design(k, start):
        cols = [e[start:-1]] + [d[start - i : len(d) - i] for i in range(1, k + 1)]
        if constant:
            cols.append(np.ones(len(d) - start))
        return np.column_stack(cols), d[start:]

    best = None
    for k in range(top + 1):
        a, b = design(k, top)
        w = np.linalg.lstsq(a, b, rcond=None)[0]
        aic = len(b) * math.log(((b - a @ w) ** 2).sum() / len(b)) + 2 * a.shape[1]
        if best is None or aic < best[0]:
            best = (aic, k)
    a, b = design(best[1], best[1])
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    s2 = ((b - a @ w) ** 2).sum() / (len(b) - a.shape[1])
    return w[0] / math.sqrt(s2 * np.linalg.inv(a.T @ a)[0, 0]), best[1], len(b)


def test_unit_root_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    ar = np.zeros(260)
    for t in range(2, 260):
        ar[t] = 0.5 * ar[t - 1] + 0.3 * ar[t - 2] + rng.normal()
    parts = {"walk": np.cumsum(rng.normal(size=300)) + 10, "ar": ar}
    rows = [(k, i, float(v)) for k, s in parts.items() for i, v in enumerate(s)]
    got = {r["series_id"]: r for r in P.adf_test(spark.createDataFrame(rows, "series_id string, ts long, v double"), "v").collect()}
    for name, s in parts.items():
        stat, lag, n = brute_adf(s, True)
        assert got[name]["statistic"] == pytest.approx(stat, rel=1e-6)
        assert (got[name]["used_lag"], got[name]["n_obs"]) == (lag, n)
    assert got["ar"]["is_stationary_5pct"] and not got["walk"]["is_stationary_5pct"]


def test_pvalue_surface_agrees_with_critical_values():
    for n_vars in (1, 2):
        for level, p in (("1%", 0.01), ("5%", 0.05), ("10%", 0.10)):
            assert P.unit_root_pvalue(P.critical_value(level, n_vars, 10**9), n_vars) == pytest.approx(p, abs=0.002)


def test_pvalues_of_simulated_random_walks_are_uniform(spark):
    rng = np.random.default_rng(11)
    rows = [(f"s{k}", i, float(v)) for k in range(150) for i, v in enumerate(np.cumsum(rng.normal(size=120)))]
    p = P.adf_test(spark.createDataFrame(rows, "series_id string, ts long, v double"), "v").toPandas()["p_value"]
    assert 0.35 < p.mean() < 0.65 and (p < 0.05).mean() < 0.12


def test_engle_granger_separates_pairs(spark):
    df = pair_frame(spark, {"tied": cointegrated(), "loose": walks()})
    got = {r["pair"]: r for r in P.engle_granger(df).collect()}
    assert got["tied"]["cointegrated_5pct"] and not got["loose"]["cointegrated_5pct"]
    y, x = cointegrated()
    b, a = np.polyfit(x, y, 1)
    stat, _, _ = brute_adf(y - a - b * x, False)
    assert got["tied"]["statistic"] == pytest.approx(stat, rel=1e-6)


def test_screening_covers_all_pairs_best_first(spark):
    y, x = cointegrated(250)
    z = walks(250)[0]
    days = pd.date_range("2020-01-01", periods=250)
    pdf = pd.concat([pd.DataFrame({"series_id": n, "date": days, "price": np.exp(s)}) for n, s in (("A", y), ("B", x), ("C", z))])
    got = P.screen_pairs(spark.createDataFrame(pdf)).collect()
    assert {r["pair"] for r in got} == {"A/B", "A/C", "B/C"} and got[0]["pair"] == "A/B"
    assert [r["eg_pvalue"] for r in got] == sorted(r["eg_pvalue"] for r in got)


def least_squares_view(y, x, errors, q=1e-4 / (1 - 1e-4), prior=1e4, share=2 / 31):
    """What a filter must give, from the joint normal distribution of states and data.

    States are a random walk from the prior, so the covariance of all data is
    known in closed form; its Cholesky factor gives the one-step errors and
    their variances, and regression on the data so far gives the states.
    """
    n = len(y)
    line = np.polynomial.Polynomial.fit(x[:60], y[:60], 1)
    noise = [max(((y[:60] - line(x[:60])) ** 2).sum() / (min(60, n) - 2), 1e-8)]
    for e in errors[:-1]:
        noise.append(noise[-1] + share * (e * e - noise[-1]))
    shared = prior + q * (1 + np.minimum.outer(np.arange(n), np.arange(n)))
    f = np.stack([np.ones(n), x])
    cov = (f.T @ f) * shared + np.diag(noise)
    root = np.linalg.cholesky(cov)
    scaled = np.linalg.solve(root, y)
    states = [(f[:, : t + 1] * shared[t, : t + 1]) @ np.linalg.solve(cov[: t + 1, : t + 1], y[: t + 1]) for t in range(n)]
    return np.array(states), np.diag(root) * scaled, np.diag(root) ** 2


def test_kalman_equals_joint_regression(spark):
    parts = {"p1": cointegrated(90), "p2": walks(70), "short": walks(20)}
    got = K.kalman_hedge(pair_frame(spark, parts)).toPandas().sort_values(["pair", "date"])
    for name, (y, x) in parts.items():
        own = got[got["pair"] == name]
        states, errors, variances = least_squares_view(y, x, own["spread"].to_numpy())
        np.testing.assert_allclose(own[["alpha", "beta"]].to_numpy()[3:], states[3:], rtol=1e-3, atol=1e-4)
        np.testing.assert_allclose(own["spread"].to_numpy()[3:], errors[3:], rtol=1e-3, atol=1e-4)
        np.testing.assert_allclose(own["innovation_variance"].to_numpy()[3:], variances[3:], rtol=1e-3)
        np.testing.assert_allclose(own["zscore"], own["spread"] / np.sqrt(own["innovation_variance"]))


def test_kalman_goes_on_after_a_gap(spark):
    y, x = cointegrated(120)
    y = y.copy()
    y[[0, 40, 80, 81]] = np.nan
    got = K.kalman_hedge(pair_frame(spark, {"p": (y, x)})).orderBy("date").collect()
    missing = [i for i, r in enumerate(got) if r["beta"] is None]
    assert missing == [0, 40, 80, 81] and all(r["zscore"] is None for r in (got[i] for i in missing))
    assert abs(got[-1]["alpha"] + got[-1]["beta"] * x[-1] - y[-1]) < 0.1


def test_kalman_recovers_a_constant_hedge(spark):
    x = cointegrated(500, 4)[1]
    y = 1.5 - 0.4 * x + np.random.default_rng(4).uniform(-0.05, 0.05, 500)
    out = K.kalman_hedge(pair_frame(spark, {"p": (y, x)})).toPandas().sort_values("date")
    assert (out["innovation_variance"] > 0).all()
    resid = y - (out["alpha"] + out["beta"] * x).to_numpy()
    assert np.abs(resid[100:]).mean() < 0.05


def test_kalman_passes_the_audit_and_static_hedge_fails_it(spark):
    df = pair_frame(spark, {"p": cointegrated(400)})
    cutoff = F.to_timestamp(F.lit("2020-10-26"))
    keys = ["pair", "date"]
    assert audit_lookahead(lambda d: K.kalman_hedge(d), df, cutoff, keys, "date").count() == 0

    def static(d):
        return P.spread(d, P.grouped_ols(d)).select(*keys, "spread")

    assert audit_lookahead(static, df, cutoff, keys, "date").count() > 0


def test_lagged_beta_changes_only_the_hedge(spark):
    held = K.kalman_hedge(pair_frame(spark, {"p": cointegrated(200)})).withColumn("position", F.lit(1))
    now = P.pair_returns(held).toPandas().sort_values("date")
    lagged = P.pair_returns(held, lag_beta=True).toPandas().sort_values("date")
    assert not np.allclose(now["gross_return"], lagged["gross_return"])
    assert np.allclose(now["transaction_cost"], lagged["transaction_cost"])


def test_costs_never_help(spark):
    held = K.kalman_hedge(pair_frame(spark, {"p": cointegrated(300)}))
    from tidemark.operators.ordering import hysteresis

    held = hysteresis(held, "zscore", 1.0, 0.3, by=("pair",), ts="date")
    row = P.pair_backtest(held).first()
    free = P.pair_backtest(held, include_costs=False).first()
    assert row["total_return"] <= row["total_return_gross"] + 1e-12
    assert free["total_return"] == pytest.approx(row["total_return_gross"])


def test_pair_panel_and_alignment(spark):
    rows = [("A", "2024-01-01", 1.0), ("B", "2024-01-01", 2.0), ("C", "2024-01-01", 3.0), ("A", "2024-01-02", 4.0), ("B", "2024-01-02", 5.0)]
    df = spark.createDataFrame(rows, "series_id string, date string, price double")
    got = {(r["pair"], r["date"], r["y"], r["x"]) for r in pair_panel(df).collect()}
    assert got == {("A/B", "2024-01-01", 1.0, 2.0), ("A/C", "2024-01-01", 1.0, 3.0), ("B/C", "2024-01-01", 2.0, 3.0), ("A/B", "2024-01-02", 4.0, 5.0)}
    assert align_panel(df).count() == 3 and align_panel(df, "outer").count() == 5
