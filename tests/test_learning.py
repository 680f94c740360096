"""Models over folds and texts: what is written once, and what stays equal."""

import numpy as np
import pandas as pd


def test_walk_forward_predictions_are_written_once_and_measured_per_fold(spark):
    from tidemark.operators import evaluate as E
    from tidemark.operators import models as M

    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(size=(2 * n, 2))
    pdf = pd.DataFrame({
        "series_id": ["a"] * n + ["b"] * n, "ts": list(pd.date_range("2024-01-01", periods=n, freq="h")) * 2,
        "f": x[:, 0], "g": x[:, 1], "label_direction": np.digitize(x[:, 0] + rng.normal(0, 0.5, 2 * n), [-0.4, 0.4]), "fwd_log_ret": 0.01 * x[:, 0],
    })
    pooled, metrics, pnl = M.walk_forward_eval(spark.createDataFrame(pdf), "logistic", ["f", "g"], n_folds=3, regParam=0.001)
    assert pooled.inputFiles(), "each reader would fit and predict again"
    got = pooled.toPandas()
    assert len(got) == n and sorted(got["fold"].unique()) == [0, 1, 2] and set(got["role"]) == {"test"}
    table = metrics.toPandas().sort_values(["fold", "label"])
    assert len(table) == 9 and len(pnl.toPandas()) == 2
    for k, part in got.groupby("fold"):
        alone = E.multiclass_metrics(pooled.filter(f"fold = {k}"), "label_direction", "prediction", range(3)).toPandas().sort_values("label")
        mine = table[table["fold"] == k]
        for c in alone.columns:
            assert np.allclose(alone[c], mine[c])
        assert np.isclose(mine["accuracy"].iloc[0], (part["prediction"] == part["label_direction"]).mean())


def test_long_lexicon_moves_only_words_that_are_not_looked_up(spark, monkeypatch):
    from tidemark.operators import text as X

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, 40) % 90) for _ in range(60)] + [None, "", "Never seen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string").repartition(3)
    lexicon = spark.createDataFrame([(f"w{k}", -1.0 if k % 3 else 1.0, 100 - k) for k in range(80)], "word string, weight double, n long")
    want = {r["doc_id"]: r["probs"] for r in X.lexicon_probs(df, "t", lexicon, ["doc_id"]).collect()}
    moved = []
    plain = X.term_rows
    monkeypatch.setattr(X, "term_rows", lambda *a, **b: moved.append(a) or plain(*a, **b))
    for rows in (79, 20, 0):
        monkeypatch.setattr(X, "FEW_ROWS", rows)
        got = {r["doc_id"]: r["probs"] for r in X.lexicon_probs(df, "t", lexicon, ["doc_id"]).collect()}
        assert got == want, rows
    assert not moved, "all words were counted per document and shuffled"


def test_frequent_grams_are_counted_without_building_all(spark, monkeypatch):
    from collections import Counter

    from tidemark.operators import text as X

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 50) % 400) for _ in range(40)] + ["aa aa aa aa aa aa " * 30, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    grams = Counter()
    for t in filter(None, texts):
        w = t.split()
        grams.update([a for a in w if len(a) > 1] + [f"{a} {b}" for a, b in zip(w, w[1:])])
    sizes = []
    plain = X.term_rows

    def counted(*a, **b):
        rows = plain(*a, **b)
        sizes.append(rows.count())
        return rows

    monkeypatch.setattr(X, "term_rows", counted)
    for size in (1, 25, 10_000):
        got = [tuple(r) for r in X.vocabulary(df, "t", ["doc_id"], (1, 2), size).collect()]
        assert got == sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:size]
        if size == 25:
            assert max(sizes) < sum(grams.values()), "every gram of every text was built"


def test_vectors_of_words_equal_those_of_texts(spark):
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators import text as X

    df = spark.createDataFrame([(1, "Bb aa bb, aa c"), (2, "aa cc"), (3, None), (4, "")], "doc_id long, t string")
    words = X.tokenised(df, "t", ["doc_id"])
    a, terms = X.tfidf_vectors(df, "t", max_features=4)
    b, same = X.tfidf_vectors(words, "words", max_features=4)
    assert terms == same
    rows = [sorted((r[0], *r[1]) for r in x.select("doc_id", vector_to_array("features")).collect()) for x in (a, b)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_forest_keeps_the_nodes_that_rows_have_reached(spark):
    """Same trees as with rows led down from the roots for every group of nodes, and checkpoints to cut the lineage."""
    from tidemark.operators import models as M

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({"f": x[:, 0], "g": x[:, 1], "h": x[:, 2], "y": (x[:, 0] * x[:, 1] + rng.normal(0, 0.3, 300) > 0).astype(float)}))
    assert M.classifier("random_forest", "y").getCacheNodeIds()
    kept = M.fit_classifier(df, "random_forest", ["f", "g", "h"], "y", numTrees=8)
    assert spark.sparkContext.getCheckpointDir()
    led = M.fit_classifier(df, "random_forest", ["f", "g", "h"], "y", numTrees=8, cacheNodeIds=False)
    assert kept.toDebugString.split("\n", 1)[1] == led.toDebugString.split("\n", 1)[1] and max(t.depth for t in kept.trees) > 5


def test_texts_are_placed_by_their_keys(spark, tmp_path, monkeypatch):
    """Words do not move to be split; repeated documents and labels give a row for each pair, as a join does."""
    from pyspark.sql import functions as F

    from tidemark.operators import text as X
    from tidemark.plans import learning as L

    rng = np.random.default_rng(6)
    docs = [(int(i) if i < 78 else None, " ".join(f"w{k}" for k in rng.zipf(1.5, 30) % 50)) for i in range(80)] + [(3, "again w1 w2"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' AS source", "length(text) AS n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, None if i % 10 == 9 else int(i % 7 > 0), int(i % 5 == 0)) for i in range(0, 90, 2)] + [(3, 1, 0), (3, 0, None), (9, None, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = L.V.texts(spark, str(tmp_path)).filter("quality IS NOT NULL")
    want = want.withColumn("category", F.expr("CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END"))
    plain, placed = L.splits.stratified_split, []
    want = sorted(tuple(r) for r in plain(want, "category", ["doc_id"]).select("doc_id", "category", "quality", "split").collect())
    monkeypatch.setattr(L.splits, "stratified_split", lambda df, *a: placed.append(df) or plain(df, *a))
    seen = []
    for few in (X.FEW_ROWS, 0):
        monkeypatch.setattr(X, "FEW_ROWS", few)
        rows, terms = L.text_vectors(spark, str(tmp_path))
        got = sorted(tuple(r) for r in rows.select("doc_id", "category", "quality", "split").collect())
        assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
        assert {r for r in got if r[0] != 3} == {r for r in want if r[0] != 3}  # the order of equal keys is open
        seen.append((terms, sorted(map(str, rows.collect()))))
    assert seen[0] == seen[1] and len(seen[0][0]) > 40
    assert not any(set(df.columns) & {"words", "headline", "text"} for df in placed), "texts are moved to be split"
