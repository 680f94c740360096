import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import gram as G
from tidemark.operators import quantiles as Q
from tidemark.operators import splits


def values(spark, v):
    return spark.createDataFrame(pd.DataFrame({"v": v})).repartition(4)


@pytest.mark.parametrize("kind", ["spread", "ties", "edges", "two"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(0)
    v = {
        "spread": rng.lognormal(0, 3, 5000),
        "ties": np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)]),
        "edges": np.concatenate([np.full(2000, -1.0), rng.normal(size=1000), np.full(2000, 9.0)]),
        "two": np.array([1.0, 5.0]),
    }[kind]
    probs = [0.0, 0.005, 0.25, 0.5, 0.61, 0.98, 0.995, 1.0]
    np.testing.assert_allclose(Q.exact_quantiles(values(spark, v), "v", probs), np.quantile(v, probs), rtol=1e-12, atol=1e-12)


def test_quantiles_with_infinite_values(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 50 THEN -double('inf') WHEN id >= 2900 THEN double('inf') ELSE double(id) END AS v")
    got = Q.exact_quantiles(df, "v", [0.0, 0.01, 0.5, 0.9, 0.99, 1.0])
    assert got[0] == got[1] == -np.inf and got[2:4] == pytest.approx([1499.5, 2699.1]) and got[4] == got[5] == np.inf
    odd = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "v double")
    got = Q.exact_quantiles(odd, "v", [0.0, 0.5, 1.0])
    assert got[:2] == [1.0, 2.0] and np.isnan(got[2])


def test_quantiles_of_groups_and_columns(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 9000, p=[0.9, 0.09, 0.01]), "x": rng.normal(size=9000), "y": np.round(rng.exponential(size=9000), 1)})
    pdf.loc[::11, "x"] = np.nan
    pdf.loc[pdf.k == "c", "y"] = np.inf
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, x double, y double").repartition(5)
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 2.0), (None, None, 4.0), ("none", None, None)], df.schema))
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]

    def check():
        found = {(r["k"], r["column"], r["prob"]): r["value"] for r in Q.quantile_table(df, {"x": probs, "y": probs}, ["k"]).collect()}
        for key in ("a", "b", "c"):
            for c in ("x", "y"):
                if (key, c) == ("c", "y"):
                    assert all(found[key, c, p] == np.inf for p in probs)
                else:
                    want = np.quantile(pdf.loc[(pdf.k == key) & pdf[c].notna(), c], probs)
                    np.testing.assert_allclose([found[key, c, p] for p in probs], want, rtol=1e-12, atol=1e-12)
        assert found[None, "x", 0.5] == 1.0 and found[None, "y", 0.5] == 3.0 and found["none", "x", 0.5] is None

    check()
    monkeypatch.setattr(Q, "FEW_TARGETS", 0)
    monkeypatch.setattr(Q, "SKETCH", 8)  # brackets miss and are widened
    check()


def test_filled_by_group_and_for_all(spark):
    from tidemark.operators.features import fill_missing

    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 7.0), ("b", None), (None, 9.0), (None, None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("_fill", F.lit("kept away")).drop("_fill")
    got = lambda out: sorted(out.collect(), key=repr)
    by = {(r["k"], r["v"]) for r in got(fill_missing(df, "v", "median", ["k"]))}
    assert by == {("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 7.0), (None, 9.0), ("c", None)}
    assert {r["v"] for r in got(fill_missing(df, "v", "median"))} == {1.0, 3.0, 5.0, 7.0, 9.0}
    assert {(r["k"], r["v"]) for r in got(fill_missing(df, "v", "mean", ["k"]))} == by


def test_scoring_keeps_every_row(spark):
    from tidemark.operators import models as M

    rows = [(float(i % 7), None if i % 10 == 0 else float(i % 3), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    out = M.predict(M.fit_classifier(df, "logistic", ["a", "b"], "y"), df, ["a", "b"])
    assert out.count() == 100 and out.filter("score IS NULL").count() == 10 and out.filter("b IS NULL AND prediction IS NOT NULL").isEmpty()


def test_ridge_far_from_zero(spark):
    t = np.arange(80.0)
    pdf = pd.DataFrame({"k": "s", "x": 1e8 + np.sin(t), "z": np.cos(2 * t), "y": 2e8 + 3 * np.sin(t) - np.cos(2 * t)})
    model = {r["feature"]: r for r in G.fit_ridge(spark.createDataFrame(pdf), ["x", "z"], "y", ["k"], 1e-6).collect()}
    assert model["x"]["coefficient"] / model["x"]["std"] == pytest.approx(3, rel=1e-5) and model["z"]["coefficient"] / model["z"]["std"] == pytest.approx(-1, rel=1e-5)
    assert model["x"]["mean"] == pytest.approx(pdf["x"].mean(), rel=1e-12) and model["(intercept)"]["coefficient"] == pytest.approx(pdf["y"].mean(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert Q.exact_quantiles(values(spark, [1.0]).filter("v > 2"), "v", [0.5]) == [None]


def test_budget_flags_the_right_share(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"score": rng.normal(size=10_000), "truth": rng.random(10_000) < 0.02})
    table = E.precision_at_budget(spark.createDataFrame(pdf), "score", "truth").toPandas().set_index("budget_pct")
    assert abs(table.loc[2.0, "n_flagged"] - 200) <= 2
    assert table["n_flagged"].is_monotonic_increasing


def brute_auc(t, s):
    p, n = s[t], s[~t]
    return ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / (len(p) * len(n))


def test_auc_with_heavy_ties_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    s = np.where(rng.random(600) < 0.35, 0.5, np.round(rng.random(600), 2))
    t = rng.random(600) < 0.3 + 0.4 * s
    df = spark.createDataFrame(pd.DataFrame({"s": s, "t": t})).repartition(4)
    assert E.roc_auc(df, "t", "s").first()["roc_auc"] == pytest.approx(brute_auc(t, s), abs=1e-12)
    curve = E.roc_curve(df, "t", "s").toPandas().sort_values("threshold", ascending=False)
    assert curve["tpr"].is_monotonic_increasing and curve["tpr"].iloc[-1] == 1.0


def test_auc_of_one_class_is_null(spark):
    assert E.roc_auc(spark.createDataFrame([(1.0, True)], "s double, t boolean"), "t", "s").first()["roc_auc"] is None


def test_metrics_of_empty_classes_are_zero(spark):
    row = E.binary_metrics(spark.createDataFrame([(False, False)], "t boolean, p boolean"), "t", "p").first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_identical_labelings_have_rand_one(spark):
    df = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(30)], "a long, b string")
    assert E.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1.0)


def test_ridge_equals_direct_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = x @ [0.5, -0.2, 3.0] + rng.normal(size=400) + 2
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, g="g")
    df = spark.createDataFrame(pdf).repartition(4)
    model = G.fit_ridge(df, ["a", "b", "c"], "y", ["g"], alpha=1.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    got = model.filter("feature != '(intercept)'").orderBy("feature").toPandas()["coefficient"]
    np.testing.assert_allclose(got, want, rtol=1e-8)
    scored = G.predict_ridge(df, model, ["a", "b", "c"], ["g"]).toPandas().sort_values("a")
    np.testing.assert_allclose(scored["prediction"], (z @ want + y.mean())[np.argsort(x[:, 0])], rtol=1e-8)


def test_ridge_search_equals_refits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 2))
    y = x @ [1.0, -1.0] + rng.normal(size=100)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y, series_id="s", ts=range(100)))
    got = G.ridge_search(splits.expanding_folds(df, 4), ["a", "b"], "y", (1.0,), ["series_id"]).toPandas().sort_values("fold")
    for k in range(4):
        cut = 100 - (4 - k) * 20
        m, s = x[:cut].mean(0), x[:cut].std(0)
        z = (x[:cut] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y[:cut] - y[:cut].mean()))
        pred = (x[cut : cut + 20] - m) / s @ w + y[:cut].mean()
        assert got["rmse"].iloc[k] == pytest.approx(np.sqrt(((y[cut : cut + 20] - pred) ** 2).mean()))


def test_folds_are_in_time_order(hot):
    _, df = hot
    rows = splits.assign_folds(df.filter("series_id = 'hot'")).groupBy("fold", "role").agg(F.min("row_idx").alias("a"), F.max("row_idx").alias("b")).toPandas()
    at = {(r.fold, r.role): (r.a, r.b) for r in rows.itertuples()}
    for k in range(5):
        assert at[k, "train"][1] < at[k, "val"][0] and at[k, "val"][1] < at[k, "test"][0]
    assert at[4, "test"][1] == 899


def test_refit_windows_train_only_on_the_past(hot):
    _, df = hot
    rows = splits.assign_refit_windows(df, 300, 100, 250)
    per = rows.groupBy("series_id", "model_id", "role").agg(F.min("row_idx").alias("a"), F.max("row_idx").alias("b"), F.count("*").alias("n")).toPandas()
    assert set(per["series_id"]) == {"hot"} and per["model_id"].max() == 5
    for m, part in per.groupby("model_id"):
        p = part.set_index("role")
        assert p.loc["train", "b"] == p.loc["score", "a"] - 1 and p.loc["train", "n"] == 250


def test_stratified_split_shares(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id long, y int")
    got = splits.stratified_split(df, "y", ["id"]).groupBy("y", "split").count().toPandas().set_index(["y", "split"])["count"]
    assert got[0, "test"] == 225 and got[1, "test"] == 25


def test_scaling_is_learnt_on_train_only(spark):
    train, test = splits.standardize(values(spark, [1.0, 3.0]), values(spark, [5.0]), cols=["v"])
    assert sorted(r["v"] for r in train.collect()) == [-1.0, 1.0] and test.first()["v"] == 3.0
    flat = splits.zscore_flag(values(spark, [2.0, 2.0]), "v").first()
    assert flat["zscore"] == 0.0 and not flat["is_anomaly"]
