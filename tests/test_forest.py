"""Forests grown in full: single splits against direct sums, and the same trees however rows are dealt and whoever grows them."""

import numpy as np
import pandas as pd
import pytest


def vectors(spark, x, y, split, ids=None, parts=3, dense=()):
    """Rows (doc_id, split, y, features); vectors of ``dense`` rows hold their zeros, a row of NaN has none."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    def vector(i):
        if np.isnan(x[i]).any():
            return None
        return Vectors.dense(x[i]) if i in dense else Vectors.sparse(x.shape[1], [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])])

    schema = T.StructType().add("doc_id", "long").add("split", "string").add("y", "integer").add("features", VectorUDT())
    rows = [(int(i if ids is None else ids[i]), split[i], None if y[i] is None else int(y[i]), vector(i)) for i in range(len(x))]
    return spark.createDataFrame(rows, schema).repartition(parts)


def scores(df, n, **kw):
    from pyspark.sql import functions as F

    from tidemark.operators import forest as Fo

    out = Fo.forest_scores(df, "features", "y", F.col("split") == "train", ["doc_id"], n, **kw)
    return {r["doc_id"]: (tuple(r["score"]) if r["score"] else None, r["prediction"]) for r in out.collect()}


def sparse_table(n=500, f=12, classes=3, seed=4):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, f)) < 0.35, rng.random((n, f)), 0.0)
    x[:, 1] *= rng.choice([-1.0, 1.0], n)
    x[n // 2 :: 7] = x[3]  # equal rows of several classes
    x[5] = 0.0
    y = np.digitize(x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.2, n), np.linspace(0.1, 0.5, classes - 1))
    return x, y, np.where(rng.random(n) < 0.75, "train", "test")


@pytest.mark.parametrize("classes", [2, 3])
def test_every_split_is_the_purest_of_its_draw_and_leaves_cannot_be_split(classes):
    from tidemark.operators import forest as Fo

    rng = np.random.default_rng(11)
    bins = np.where(rng.random((400, 9)) < 0.4, rng.integers(1, 40, (400, 9)), 0).astype(np.uint8)
    bins[200:260] = bins[0]
    y, weight = rng.integers(0, classes, 400), rng.poisson(1.0, 400).astype(np.int64)
    root, k = Fo.roots(1, 7)[0], 3
    tree = Fo.grow(bins, y, weight, root, classes, k)

    def impurity(rows):
        n = np.bincount(y[rows], weight[rows], classes)
        return n.sum() - (n * n).sum() / n.sum() if n.sum() else 0.0

    todo, seen = [(0, root, np.flatnonzero(weight))], 0
    while todo:
        node, path, rows = todo.pop()
        seen += 1
        n = np.bincount(y[rows], weight[rows], classes)
        alike = (bins[rows] == bins[rows[0]]).all()
        if tree.feature[node] < 0:
            assert (n > 0).sum() == 1 or alike
            assert np.array_equal(tree.votes[node], np.rint(n / n.sum() * Fo.ONE))
            continue
        f, c = tree.feature[node], tree.cut[node]
        drawn = Fo.drawn_features(np.array([path]), 9, k)[0]
        assert len(set(drawn.tolist())) == k
        told = [j for j in drawn if len(set(bins[rows, j].tolist())) > 1]
        assert f in told if told else len(set(bins[rows, f].tolist())) > 1
        left = bins[rows, f] <= c
        mine = impurity(rows[left]) + impurity(rows[~left])
        for j in told or [f]:
            for v in sorted(set(bins[rows, j].tolist()))[:-1]:
                other = bins[rows, j] <= v
                assert mine <= impurity(rows[other]) + impurity(rows[~other]) + 1e-9
        a, b = Fo.children(np.array([path]))
        todo += [(tree.left[node], a, rows[left]), (tree.left[node] + 1, b, rows[~left])]
    assert seen == len(tree.feature)


def test_large_nodes_are_split_as_small_ones(monkeypatch):
    from tidemark.operators import forest as Fo

    rng = np.random.default_rng(2)
    bins = np.where(rng.random((3000, 20)) < 0.3, rng.integers(1, 255, (3000, 20)), 0).astype(np.uint8)
    y, weight = rng.integers(0, 2, 3000), rng.poisson(1.0, 3000).astype(np.int64)
    whole = Fo.grow(bins, y, weight, Fo.roots(1, 1)[0], 2, 4)
    monkeypatch.setattr(Fo, "CHUNK", 100)
    pieces = Fo.grow(bins, y, weight, Fo.roots(1, 1)[0], 2, 4)
    for a, b in zip(vars(whole).values(), vars(pieces).values()):
        assert np.array_equal(a, b)


def test_trees_have_no_limit_of_depth(spark):
    """Alternating classes along one feature need a tree deeper than 30, Spark's greatest."""
    n = 200
    x = np.arange(1.0, n + 1)[:, None] / n
    y = [i % 2 for i in range(n)] * 2
    df = vectors(spark, np.concatenate([x, x]), y, ["train"] * n + ["test"] * n)
    got = scores(df, 1, trees=40)
    assert len(got) == n and np.mean([got[n + i][1] == i % 2 for i in range(n)]) > 0.95


def test_forest_does_not_depend_on_the_dealing_or_on_who_grows_it(spark, monkeypatch):
    from tidemark.operators import forest as Fo

    x, y, split = sparse_table()
    want = scores(vectors(spark, x, y, split), 12, n_classes=3, trees=9)
    assert len(want) == (split == "test").sum()
    assert np.mean([want[i][1] == y[i] for i in want]) > 0.6
    assert all(abs(sum(s) - 1) < 1e-6 for s, _ in want.values())
    assert scores(vectors(spark, x, y, split, parts=7, dense=range(0, 500, 3)), 12, n_classes=3, trees=9) == want
    monkeypatch.setattr(Fo, "BLOCK_ROWS", 64)
    for rows in (250, 40):
        monkeypatch.setattr(Fo, "SUM_BYTES", rows * 4000)
        assert scores(vectors(spark, x, y, split), 12, n_classes=3, trees=9, task_bytes=12 * rows) == want, rows


def test_no_task_gets_more_training_rows_than_it_may_hold(spark, monkeypatch):
    from tidemark.operators import forest as Fo

    plain, sizes = Fo._finish, []
    monkeypatch.setattr(Fo, "_finish", lambda work, rows, *a: sizes.append(rows) or plain(work, rows, *a))
    x, y, split = sparse_table(600, classes=2)
    x[100:400], y[100:400] = x[100], 1  # one large node of equal rows is a leaf at once
    scores(vectors(spark, x, y, split), 12, trees=5, task_bytes=12 * 40)
    assert sizes[0] and max(sizes[0].values()) <= 40


def test_jobs_of_a_forest_do_not_grow_with_its_nodes(spark):
    """Spark's forest grew nodes in groups of bounded memory, each by passes over all rows."""
    context = spark.sparkContext
    jobs = []
    for n in (80, 4000):
        x, y, split = sparse_table(n, classes=2)
        y = np.random.default_rng(1).integers(0, 2, n)
        df = vectors(spark, x, y, split).localCheckpoint()
        context.setJobGroup(f"forest-{n}", "forest")
        scores(df, 12, trees=20)
        context.setJobGroup("", "")
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{n}")))
    assert 0 < jobs[1] <= jobs[0] + 2 < 30


def test_forest_of_odd_rows(spark):
    """Repeated keys are rows of their own; rows without a vector are scored null; without a label they are no training rows."""
    x, y, split = sparse_table(300, classes=2)
    x[3] = x[250:260] = np.nan
    split[:4] = "test"
    ids = np.where(np.arange(300) < 20, 7, np.arange(300))
    labels = [None if i in (0, 30, 31) else v for i, v in enumerate(y)]
    df = vectors(spark, x, labels, split, ids)
    from pyspark.sql import functions as F

    from tidemark.operators import forest as Fo

    out = Fo.forest_scores(df, "features", "y", F.col("split") == "train", ["doc_id"], 12, trees=5).toPandas()
    assert len(out) == (split == "test").sum() and list(out.columns) == ["doc_id", "split", "y", "features", "score", "prediction"]
    assert out["prediction"].isna().sum() == out["features"].isna().sum() == sum(np.isnan(x[split == "test"]).any(axis=1))
    with pytest.raises(ValueError):
        scores(df.filter("split = 'test'"), 12)
    one = pd.DataFrame(scores(df.filter("split = 'test' OR doc_id = 40"), 12, trees=3).values())
    assert one[1].dropna().nunique() <= 1
    equal = vectors(spark, np.zeros((6, 4)), [1, 1, 0, 0, 1, 0], ["train"] * 5 + ["test"])
    (shares,) = scores(equal, 4, trees=50).values()
    assert 0.4 < shares[0][1] < 0.8 and shares[1] == 1
