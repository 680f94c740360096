import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly as A
from tidemark.operators import book as Bk
from tidemark.operators import portfolio as Pf
from tidemark.operators import regimes as R
from tidemark.operators import text as X


def moments(seed=7, n=5):
    rng = np.random.default_rng(seed)
    root = rng.normal(size=(n, n))
    return rng.uniform(0.02, 0.4, n), root @ root.T / n + 0.05 * np.eye(n)


@pytest.mark.parametrize("seed", range(6))
def test_long_only_optima_satisfy_kkt(seed):
    mu, cov = moments(seed)
    for w in (Pf.min_volatility(mu, cov), Pf.max_sharpe(mu, cov, 0.045), Pf.at_return(mu, cov, float(np.quantile(mu, 0.7)))):
        assert w.min() >= 0 and w.sum() == pytest.approx(1.0)
    w = Pf.min_volatility(mu, cov)
    grad = cov @ w
    held = w > 1e-9
    assert np.ptp(grad[held]) < 1e-8 and (grad[~held] >= grad[held].min() - 1e-8).all()
    rng = np.random.default_rng(seed)
    cloud = rng.dirichlet(np.ones(len(mu)), 3000)
    vols = np.sqrt(np.einsum("ij,jk,ik->i", cloud, cov, cloud))
    assert np.sqrt(w @ cov @ w) <= vols.min() + 1e-9
    s = Pf.max_sharpe(mu, cov, 0.045)
    assert (s @ mu - 0.045) / np.sqrt(s @ cov @ s) >= ((cloud @ mu - 0.045) / vols).max() - 1e-9


@pytest.mark.parametrize("seed,n", [(0, 2), (1, 5), (2, 12), (3, 30), (4, 12)])
def test_critical_line_equals_single_goals(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, n)) @ rng.normal(size=(n, n)) / 4
    mu, cov = rng.normal(0.08, 0.1, n), np.cov(x.T)
    if seed == 4:
        mu[1] = mu[0] = mu.max() + 0.01  # two assets share the greatest return
    line = Pf.critical_line(mu, cov)
    assert (np.diff(line.trade) <= 0).all() and (np.diff(line.returns) <= 1e-12).all() and line.trade[-1] == 0
    assert np.allclose(line.weights.sum(axis=1), 1) and (line.weights >= 0).all()
    for trade, w in zip(line.trade[1:], line.weights[1:]):
        # stationary at its price of return: gradients are equal where held, no less elsewhere
        grad = cov @ w - trade * mu
        assert (grad >= grad[w > 1e-9].max() - 1e-8).all()
    risk = lambda w: float(w @ cov @ w)
    assert risk(line.weights[-1]) == pytest.approx(risk(Pf.min_volatility(mu, cov)), rel=1e-8)
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        target = line.returns[-1] + share * (line.returns[0] - line.returns[-1])
        w = line.at(target)
        assert float(w @ mu) == pytest.approx(target, abs=1e-10) and risk(w) == pytest.approx(risk(Pf.at_return(mu, cov, target)), rel=1e-6)
    best, other = line.best_ratio(mu, cov, 0.02), Pf.max_sharpe(mu, cov, 0.02)
    ratio = lambda w: (float(w @ mu) - 0.02) / risk(w) ** 0.5
    assert ratio(best) == pytest.approx(ratio(other), rel=1e-8)
    assert line.best_ratio(mu, cov, mu.max()) is None


def test_critical_line_of_one_asset_and_of_none_that_varies():
    line = Pf.critical_line(np.array([0.1]), np.array([[0.04]]))
    assert line.at(0.3).tolist() == line.at(-1.0).tolist() == [1.0]
    flat = Pf.critical_line(np.array([0.1, 0.2]), np.zeros((2, 2)))
    assert flat is None or np.allclose(flat.weights.sum(axis=1), 1)


def test_a_stored_forest_scores_the_same_in_another_engine(spark):
    """Trees are rows: read back, and walked by recursive SQL outside of Spark, they give Spark's scores."""
    import duckdb

    from tidemark.operators import anomaly as A
    from tidemark.session import work_path

    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(6, 1, size=(6, 3))])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(len(x)))
    df = spark.createDataFrame(pdf)
    forest, size = A.fit_forest(df, ["a", "b", "c"], ["id"], trees=40, sample=64)
    table = work_path(spark, "forests")
    assert [A.store_forest(spark, f, size, table) for f in (forest[:5], forest)] == [1, 2]
    again, same_size = A.read_forest(spark, table)
    assert same_size == size and len(again) == 40 and len(A.read_forest(spark, table, 1)[0]) == 5
    scored = A.score_with_forest(df, ["a", "b", "c"], again, size).toPandas().set_index("id")["anomaly_score"]
    nodes, points = spark.read.parquet(table).filter("run_id = 2").toPandas(), pdf  # noqa: F841
    scale = float(A.path_correction(size))
    sql = f"""WITH RECURSIVE walk AS (
      SELECT id, tree, 0 AS node FROM points, (SELECT DISTINCT tree FROM nodes)
      UNION ALL
      SELECT w.id, w.tree, CASE WHEN [p.a, p.b, p.c][n.feature + 1] <= n.threshold THEN n.left ELSE n.right END
      FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN points p ON p.id = w.id WHERE n.feature >= 0)
    SELECT id, pow(2, -avg(depth_cost) / {scale!r}) AS score FROM walk JOIN nodes USING (tree, node) WHERE feature < 0 GROUP BY id"""
    found = duckdb.sql(sql).df().set_index("id")["score"]
    np.testing.assert_allclose(found.loc[scored.index], scored, rtol=1e-12)
    assert scored.loc[300:].min() > scored.loc[:299].median()


def test_max_sharpe_without_excess_return():
    mu, cov = moments()
    assert Pf.max_sharpe(mu * 0, cov, 0.045) is None


def test_frontier_and_performance_on_spark(spark):
    mu, cov = moments()
    ids = [f"a{i}" for i in range(len(mu))]
    mean = spark.createDataFrame([("b", i, float(m)) for i, m in zip(ids, mu)], "basket string, series_id string, mean_return double")
    c = spark.createDataFrame([("b", ids[i], ids[j], float(cov[i, j])) for i in range(5) for j in range(5)], "basket string, i string, j string, value double")
    out = Pf.optimize_portfolios(mean, c, n_frontier=10).toPandas()
    line = out[out["goal"] == "frontier"].sort_values("point")
    assert len(line) == 10 and line["vol"].is_monotonic_increasing and line["ret"].is_monotonic_increasing
    assert line["ret"].iloc[-1] == pytest.approx(mu.max(), abs=1e-8)
    best = out[out["goal"] == "max_sharpe"].iloc[0]
    weights = spark.createDataFrame([("p", k, float(v)) for k, v in best["weights"].items()], "portfolio_id string, series_id string, weight double")
    row = Pf.portfolio_performance(weights, mean.drop("basket"), c.drop("basket")).first()
    assert (row["ret"], row["vol"], row["sharpe"]) == pytest.approx((best["ret"], best["vol"], best["sharpe"]))
    cloud = Pf.random_portfolios(mean.drop("basket"), c.drop("basket"), n=300).toPandas()
    assert len(cloud) == 300 and cloud["sharpe"].max() <= best["sharpe"] + 1e-9
    total = Pf.random_weights(mean, 50).groupBy("portfolio_id").agg(F.sum("weight").alias("w")).toPandas()["w"]
    np.testing.assert_allclose(total, 1.0)


def test_unsolvable_baskets_give_nulls(spark):
    mean = spark.createDataFrame([("gap", "a", 0.1), ("gap", "b", 0.2), ("poor", "a", 0.01)], "basket string, series_id string, mean_return double")
    cov = spark.createDataFrame([("gap", "a", "a", 0.1), ("gap", "b", "b", 0.1), ("poor", "a", "a", 0.1)], "basket string, i string, j string, value double")
    out = Pf.optimize_portfolios(mean, cov, n_frontier=0).toPandas().set_index(["basket", "goal"])
    assert out.loc["gap"]["ret"].isna().all() and np.isnan(out.loc[("poor", "max_sharpe"), "ret"])
    assert out.loc[("poor", "min_vol"), "ret"] == pytest.approx(0.01)


def test_pair_moments_equal_pandas_with_gaps(spark):
    rng = np.random.default_rng(9)
    m = pd.DataFrame(rng.normal(0.01, 0.1, (80, 4)), columns=list("wxyz"), index=pd.date_range("2024-01-01", periods=80))
    m = m.mask(rng.random(m.shape) < 0.2)
    long = m.rename_axis("date").reset_index().melt("date", var_name="series_id", value_name="ret").dropna()
    df = spark.createDataFrame(long).repartition(3)
    _, cov = Pf.annualised_moments(df, periods=1)
    got = cov.toPandas().pivot(index="i", columns="j", values="value")
    np.testing.assert_allclose(got.to_numpy(), m.cov().to_numpy(), atol=1e-12)
    corr = Pf.correlation_matrix(df).toPandas().pivot(index="i", columns="j", values="value")
    np.testing.assert_allclose(corr.to_numpy(), m.corr().to_numpy(), atol=1e-12)
    groups = df.select("date", (F.month("date") % 2).alias("cluster")).distinct()
    per = R.correlation_by_group(df, groups).filter("cluster = 0 and i = 'w' and j = 'z'").first()["value"]
    part = m[m.index.month % 2 == 0]
    assert per == pytest.approx(part["w"].corr(part["z"]))


def test_moments_far_from_zero(spark):
    """A level of 1e8 must not cost the digits of deviations of 0.1."""
    t = np.arange(60)
    m = pd.DataFrame({"x": 1e8 + 0.1 * np.sin(t), "y": 1e8 + 0.1 * np.sin(t + 0.5), "flat": 0.1}, index=pd.date_range("2024-01-01", periods=60))
    df = spark.createDataFrame(m.rename_axis("date").reset_index().melt("date", var_name="series_id", value_name="ret")).repartition(3)
    dev = m[["x", "y"]].to_numpy() - 1e8
    _, cov = Pf.annualised_moments(df, periods=1)
    got = {(r["i"], r["j"]): r["value"] for r in cov.collect()}
    assert got[("x", "y")] == pytest.approx(np.cov(dev.T)[0, 1], rel=1e-6) and got[("x", "x")] == pytest.approx(dev[:, 0].var(ddof=1), rel=1e-6)
    corr = {(r["i"], r["j"]): r["value"] for r in Pf.correlation_matrix(df).collect()}
    assert corr[("x", "y")] == pytest.approx(np.corrcoef(dev.T)[0, 1], rel=1e-6) and corr.get(("flat", "x")) is None


def returns_frame(spark, panel):
    n = len(next(iter(panel.values())))
    parts = [pd.DataFrame({"series_id": k, "date": pd.date_range("2024-01-01", periods=n), "ret": v}) for k, v in panel.items()]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def test_equal_series_correlate_fully(spark):
    v = np.random.default_rng(0).normal(0, 0.01, 30)
    got = R.rolling_mean_corr(returns_frame(spark, {"a": v, "b": v, "c": v}), 10).toPandas()["avg_pairwise_corr"]
    assert len(got) == 21 and np.allclose(got, 1.0)


def test_regime_features_of_given_returns(spark):
    """Two series, one twice the other: all values are worked out by hand."""
    frame = returns_frame(spark, {"a": [0.1, -0.1, 0.2, 0.0], "b": [0.2, -0.2, 0.4, 0.0]})
    first, second = R.regime_features(frame, 3).orderBy("date").collect()
    # Means of the days: 0.15, -0.15, 0.3, 0; half distances between the two: 0.05, 0.05, 0.1, 0.
    assert first["avg_pairwise_corr"] == pytest.approx(1) and second["avg_pairwise_corr"] == pytest.approx(1)
    assert first["dispersion"] == pytest.approx(0.2 / 3) and second["dispersion"] == pytest.approx(0.05)
    assert first["drawdown"] == pytest.approx(-0.15)
    # Squared deviations of a: 0.14 / 3 and, a day later, 0.14 / 3 as well; b is twice a.
    assert first["avg_volatility"] == pytest.approx(1.5 * (0.14 / 3 / 2) ** 0.5)
    assert second["avg_volatility"] == pytest.approx(1.5 * (0.14 / 3 / 2) ** 0.5)


def test_regime_names(spark):
    rows = [(0, 0.02, 0.1), (1, 0.02, 0.1), (2, -0.02, 0.4), (3, -0.02, 0.4)]
    got = {r["cluster"]: r["regime_label"] for r in R.label_regimes(spark.createDataFrame(rows, "cluster int, avg_return double, avg_volatility double")).collect()}
    assert got == {0: "Bull Quiet (1)", 1: "Bull Quiet (2)", 2: "Bear Crash (1)", 3: "Bear Crash (2)"}


def levels_frame(spark, n=120):
    """A book of repeating patterns, no two snapshots in a row alike."""
    rows = []
    for t in range(n):
        for s, side in enumerate(("bid", "ask")):
            for level in range(5):
                placed = 6 + (5 * t + 3 * level + s) % 13
                executed = (t + level * s) % 4
                size = 1.0 + (7 * t + 4 * level * level + 2 * s) % 17 / 2
                rows.append(("s", t, side, level, size, placed, placed - executed, executed))
    return spark.createDataFrame(rows, "series_id string, snapshot_id long, side string, level int, size double, placed long, canceled long, executed long")


def test_book_features_on_blocks_equal_plain(spark):
    df = levels_frame(spark)
    cols = ["top_level_size_ratio", *Bk.level_columns(), "max_size_velocity_across_levels"]
    for fill in ("global", "expanding"):
        plain = Bk.book_features(df, fill=fill).toPandas().sort_values("snapshot_id")
        assert len(plain) == 120 and plain[cols].notna().all().all()
        if fill == "global":
            blocked = Bk.book_features(df, fill=fill, block_rows=16).toPandas().sort_values("snapshot_id")
            np.testing.assert_allclose(plain[cols], blocked[cols], atol=1e-9)


def test_expanding_fill_uses_only_the_past(spark):
    from tidemark.operators.audit import audit_lookahead

    df = levels_frame(spark, 80)
    keys = ["series_id", "snapshot_id"]
    cols = ["top_level_size_ratio", "max_size_velocity_across_levels"]
    assert audit_lookahead(lambda d: Bk.book_features(d, fill="expanding"), df, 8, keys, "snapshot_id", cols).count() == 0
    assert audit_lookahead(lambda d: Bk.book_features(d), df, 8, keys, "snapshot_id", cols).count() > 0


def points(spark, n=1500, planted=20):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    x[:planted] += 7
    rng.shuffle(x)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(series_id="s", snapshot_id=range(n))
    pdf["truth"] = pdf["a"] > 3.9
    return spark.createDataFrame(pdf).repartition(4)


def test_forest_finds_planted_outliers(spark):
    df = points(spark)
    out = A.isolation_forest(df, ["a", "b", "c"], ["snapshot_id"], trees=60).toPandas()
    assert out["anomaly_score"].between(0, 1).all()
    assert abs(out["is_anomaly"].sum() - 30) <= 1
    assert out.loc[out["truth"], "is_anomaly"].mean() > 0.9
    again = A.isolation_forest(df.repartition(3), ["a", "b", "c"], ["snapshot_id"], trees=60).toPandas()
    np.testing.assert_allclose(out.sort_values("snapshot_id")["anomaly_score"], again.sort_values("snapshot_id")["anomaly_score"])


def test_tree_samples_are_whole_and_bounded(spark):
    rows, size = A.tree_samples(points(spark), ["a", "b", "c"], ["snapshot_id"], 20, 256, 1)
    counts = rows.groupBy("tree").count().toPandas()["count"]
    assert size == 256 and len(counts) == 20 and (counts == 256).all()
    big, size = A.tree_samples(points(spark, 1500), ["a"], ["snapshot_id"], 4, 32, 1)
    assert (big.groupBy("tree").count().toPandas()["count"] == 32).all()


def test_walk_forward_scores_have_warm_up_and_no_future(spark):
    df = points(spark, 700)
    kw = {"initial": 300, "refit": 100, "rolling": 250, "trees": 20}
    full = A.walk_forward_scores(df, ["a", "b", "c"], **kw).toPandas().sort_values("snapshot_id")
    assert full["streaming_score"].iloc[:300].isna().all() and full["streaming_score"].iloc[300:].notna().all()
    assert (full["streaming_model_id"].iloc[:300] == -1).all() and full["streaming_model_id"].max() == 3
    cut = A.walk_forward_scores(df.filter("snapshot_id < 500"), ["a", "b", "c"], **kw).toPandas().sort_values("snapshot_id")
    np.testing.assert_allclose(full["streaming_score"].iloc[:500], cut["streaming_score"])


def test_reconstruction_error_finds_broken_structure(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(500, 1))
    x = base @ np.ones((1, 4)) + rng.normal(0, 0.05, (500, 4))
    x[:5, 0] += 3
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(k=range(500))
    out = A.pca_reconstruction_score(spark.createDataFrame(pdf), list("abcd"), k=1).toPandas().sort_values("reconstruction_error")
    assert set(out["k"].tail(5)) == set(range(5))


def test_tfidf_equals_direct_computation(spark):
    docs = ["Gain gain LOSS a b", "loss of value", "gain of value value"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, t string")
    got = X.tfidf(df, "t").toPandas()
    toks = [[w for w in d.lower().split() if len(w) > 1] for d in docs]
    grams = [t + [" ".join(p) for p in zip(t, t[1:])] for t in toks]
    freq = {w: sum(w in g for g in grams) for g in grams for w in g}
    for i, g in enumerate(grams):
        raw = {w: g.count(w) * (np.log(4 / (1 + freq[w])) + 1) for w in set(g)}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        mine = got[got["doc_id"] == i].set_index("term")["weight"].to_dict()
        assert set(mine) == set(raw)
        for w in raw:
            assert mine[w] == pytest.approx(raw[w] / norm)


def test_vectors_follow_the_vocabulary(spark):
    df = spark.createDataFrame([(0, "bb aa"), (1, "aa cc")], "doc_id long, t string")
    vocab = X.vocabulary(df, "t", ["doc_id"], (1, 1))
    out = X.as_vectors(X.tfidf(df, "t", ngram=(1, 1)), vocab, ["doc_id"]).orderBy("doc_id").collect()
    assert [len(r["features"]) for r in out] == [3, 3]
    assert out[0]["features"][2] == 0 and out[1]["features"][1] == 0


def test_sentiment_map_rules(spark):
    df = spark.createDataFrame([({"Positive": 0.7, "NEGATIVE": 0.1, "neutral": 0.2},), ({"neutral": 1.0},)], "probs map<string,double>")
    got = [(r["predicted_label"], round(r["sentiment_score"], 6)) for r in X.sentiment_from_probs(df).collect()]
    assert got == [("positive", 0.6), ("neutral", 0.0)]
