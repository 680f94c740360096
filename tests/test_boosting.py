"""Boosted trees from histograms next to trees grown row by row."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import boosting


def frame(n=150, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.sin(2 * x[:, 0]) + 0.5 * (x[:, 1] > 0) + rng.normal(0, 0.1, n)
    return pd.DataFrame({"series_id": "s", "ts": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


def plain_boost(x, y, settings):
    """Fit by trying every value of every feature at every node; returns a function of rows."""
    lam, base = settings["reg_lambda"], y.mean()
    trees, at = [], np.full(len(y), base)

    def grow(rows, g, depth):
        def leaf():
            return -settings["learning_rate"] * g[rows].sum() / (len(rows) + lam)

        if depth == settings["max_depth"]:
            return leaf()
        best, pick = 0.0, None
        whole = g[rows].sum() ** 2 / (len(rows) + lam)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f]):
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if len(left) and len(right):
                    gain = g[left].sum() ** 2 / (len(left) + lam) + g[right].sum() ** 2 / (len(right) + lam) - whole
                    if gain > best + 1e-9:
                        best, pick = gain, (f, cut, left, right)
        if pick is None:
            return leaf()
        f, cut, left, right = pick
        return f, cut, grow(left, g, depth + 1), grow(right, g, depth + 1)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(settings["n_estimators"]):
        tree = grow(np.arange(len(y)), at - y, 0)
        trees.append(tree)
        at = at + np.array([walk(tree, r) for r in x])
    return lambda rows: base + np.array([sum(walk(t, r) for t in trees) for r in rows])


SPACE = {"max_depth": [1, 2, 3], "learning_rate": [0.1, 0.3], "n_estimators": [4, 9], "subsample": [1.0], "colsample_bytree": [1.0], "reg_lambda": [0.5, 2.0]}


def rmse_table(out):
    return {(r["candidate"], r["fold"]): r["rmse"] for r in out.collect()}


def test_equals_plain_trees(spark):
    pdf = frame()
    best, table = boosting.boosted_search(spark.createDataFrame(pdf).repartition(3), ["a", "b", "c"], "y", SPACE, n_iter=3, n_splits=3)
    found, candidates = rmse_table(table), boosting.draw_candidates(SPACE, 3, 42)
    size = len(pdf) // 4
    want = {}
    for c, settings in enumerate(candidates):
        for fold in range(3):
            start = len(pdf) - (3 - fold) * size
            x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
            model = plain_boost(x[:start], y[:start], settings)
            want[c, fold] = float(np.sqrt(np.mean((y[start : start + size] - model(x[start : start + size])) ** 2)))
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-6 for k in want)
    means = [np.mean([want[c, f] for f in range(3)]) for c in range(3)]
    assert best == candidates[int(np.argmin(means))]


@pytest.mark.parametrize("block", [16, 64])
def test_levels_over_blocks_grow_the_same_trees(spark, block, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
    monkeypatch.setattr(boosting, "TREES_KEPT", 2)
    space = {**SPACE, "n_estimators": [3, 5], "subsample": [0.6, 0.8], "colsample_bytree": [0.4, 0.7]}
    df = spark.createDataFrame(frame(200)).repartition(3)
    tables = [rmse_table(boosting.boosted_search(df, ["a", "b", "c"], "y", space, n_iter=4, n_splits=2, alone=alone)[1]) for alone in (True, False)]
    assert len(tables[0]) == 8 and all(abs(tables[0][k] - tables[1][k]) < 1e-12 for k in tables[0])


def test_gaps_ties_and_short_series(spark):
    pdf = pd.concat([frame(40), frame(40).assign(series_id="flat", a=1.0, b=1.0, c=1.0, y=5.0), frame(3).assign(series_id="short")])
    pdf.loc[pdf.index[::7], "a"] = None
    df = spark.createDataFrame(pdf.replace({np.nan: None}))
    _, table = boosting.boosted_search(df, ["a", "b", "c"], "y", SPACE, n_iter=2, n_splits=2)
    assert len(rmse_table(table)) == 4
    with pytest.raises(ValueError):
        boosting.boosted_search(df.limit(0), ["a"], "y", SPACE)


def test_candidates_differ():
    drawn = boosting.draw_candidates(boosting.SPACE, 20, 42)
    assert len({tuple(d.values()) for d in drawn}) == 20 and drawn == boosting.draw_candidates(boosting.SPACE, 20, 42)
