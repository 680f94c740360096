"""Queries that fit models; their metrics depend on the solver, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boosting as Bo
from tidemark.operators import evaluate as E
from tidemark.operators import features as X
from tidemark.operators import forest as Fo
from tidemark.operators import gram as G
from tidemark.operators import models as M
from tidemark.operators import splits
from tidemark.operators import text as Tx
from tidemark.operators.attach import attach_row
from tidemark.plans import views as V
from tidemark.plans.market import _impact
from tidemark.plans.registry import query, shown
from tidemark.session import allow_checkpoints, materialised

IMPACT = list(X.IMPACT_FEATURES)
CANDLE = list(X.CANDLE_FEATURES)


def impact_rows(spark, sf):
    return materialised(_impact(spark, sf), "impact")


def candle_parts(spark, sf):
    """Scaled candle features, first 70 and last 30 percent of every series."""
    rows = splits.chronological_split(X.ohlcv_features(V.ohlcv(spark, sf)), (0.7, 0.3), ("train", "test"), slots=False)
    rows = materialised(rows, "candles")
    return splits.standardize(rows.filter("split = 'train'"), rows.filter("split = 'test'"), cols=CANDLE)


@query("ridge_coefficients")
def ridge_coefficients(spark, sf):
    """Ridge per series for the next bar's return, on standardised features."""
    return shown(G.fit_ridge(_impact(spark, sf), IMPACT, "future_return_1", ["series_id"]))


@query("ridge_horizons")
def ridge_horizons(spark, sf):
    """Out-of-sample metrics of ridge for 1, 5 and 15 bars ahead, all in one fit."""
    rows = materialised(splits.chronological_split(_impact(spark, sf), (0.8, 0.2), ("train", "test"), ts="bin", slots=False), "impact")
    long = rows.unpivot(
        ["series_id", "bin", "split", *IMPACT], [f"future_return_{h}" for h in (1, 5, 15)], "horizon", "target"
    )
    train, test = long.filter("split = 'train'"), long.filter("split = 'test'")
    model = G.fit_ridge(train, IMPACT, "target", ["horizon"])
    scored = G.predict_ridge(test, model, IMPACT, ["horizon"])
    means = model.filter("feature = '(intercept)'").select("horizon", F.col("coefficient").alias("train_mean"))
    return shown(E.regression_metrics(scored.join(means, "horizon"), "target", "prediction", "train_mean", ["horizon"]))


@query("ridge_penalty_search")
def ridge_penalty_search(spark, sf):
    """RMSE of penalties over four time-ordered folds."""
    folds = splits.expanding_folds(_impact(spark, sf), 4, ts="bin", slots=False)
    table = G.ridge_search(folds, IMPACT, "future_return_1", (0.1, 1.0, 10.0, 100.0), ["series_id"])
    return shown(table.groupBy("series_id", "alpha").agg(F.avg("rmse").alias("rmse")))


def _direction(spark, sf, kind, **params):
    train, test = candle_parts(spark, sf)
    model = M.fit_classifier(train, kind, CANDLE, "label_next_bullish", **params)
    scored = materialised(M.predict(model, test, CANDLE), "scored")
    table = attach_row(E.binary_metrics(scored, "label_next_bullish", "prediction"), E.roc_auc(scored, "label_next_bullish", "score"))
    return table.withColumn("model", F.lit(kind))


@query("direction_logistic")
def direction_logistic(spark, sf):
    return shown(_direction(spark, sf, "logistic"))


@query("direction_boosted_trees")
def direction_boosted_trees(spark, sf):
    return shown(_direction(spark, sf, "boosted_trees"))


@query("direction_dense_net")
def direction_dense_net(spark, sf):
    return shown(_direction(spark, sf, "dense_net", maxIter=200))


@query("boosted_impact_horizons")
def boosted_impact_horizons(spark, sf):
    """Boosted trees for 1, 5 and 15 bars ahead."""
    rows = materialised(splits.chronological_split(_impact(spark, sf), (0.8, 0.2), ("train", "test"), ts="bin", slots=False), "impact")
    return shown(M.multi_horizon_eval(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "boosted_trees", IMPACT))


@query("huber_impact_horizons")
def huber_impact_horizons(spark, sf):
    rows = materialised(splits.chronological_split(_impact(spark, sf), (0.8, 0.2), ("train", "test"), ts="bin", slots=False), "impact")
    return shown(M.multi_horizon_eval(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "huber", IMPACT))


@query("impact_feature_importance")
def impact_feature_importance(spark, sf):
    rows = impact_rows(spark, sf)
    return shown(M.feature_importance(M.fit_regressor(rows, "boosted_trees", IMPACT, "future_return_1"), IMPACT, spark))


@query("walk_forward_model")
def walk_forward_model(spark, sf):
    """Three-class walk-forward evaluation and the pooled trading result."""
    rows = materialised(X.deadzone_label(X.ohlcv_features(V.ohlcv(spark, sf))), "labelled")
    _, metrics, pnl = M.walk_forward_eval(rows, "logistic", CANDLE, n_folds=5, regParam=0.001)
    fold = metrics.groupBy("fold").agg(F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1"))
    overall = pnl.agg(F.sum("n_trades").alias("n_trades"), F.sum("net_return_total").alias("net_return_total"))
    return shown(attach_row(fold, overall))


def text_vectors(spark, sf):
    """Labelled texts as sparse TF-IDF vectors, fitted on the training rows, in three classes: toxic, poor, good."""
    labels = V.table(spark, sf, "labels").filter("quality IS NOT NULL")
    category = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    docs = V.table(spark, sf, "documents").select("doc_id", "text").join(Tx.sent(labels, labels.count()), "doc_id")
    rows = docs.select("doc_id", "quality", category.alias("category"), Tx.tokens(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("_row"))
    # Rows are placed by their keys; words are not moved for it.
    rows = materialised(rows, "words")
    split = materialised(splits.stratified_split(rows.select("_row", "doc_id", "category"), "category", ["doc_id"]).select("_row", "split"), "split")
    n = split.count()
    parts = rows.join(Tx.sent(split, n), "_row").drop("_row")
    parts = parts if n <= Tx.FEW_ROWS else materialised(parts, "parts")
    vectors, terms = Tx.tfidf_vectors(parts, "words", fit_on=parts.filter("split = 'train'"))
    rows = vectors.select("doc_id", "split", F.col("quality").cast("double").alias("quality"), F.col("category").cast("double").alias("category"), "features")
    return materialised(rows, "vectors"), terms


def _text_metrics(spark, sf, kind, label="category", classes=(0, 1, 2), **params):
    rows, terms = text_vectors(spark, sf)
    train = rows.filter("split = 'train'").select("features", label)
    allow_checkpoints(spark)
    model = M.classifier(kind, label, train.count(), len(terms), len(classes), **params).fit(train)
    guessed = model.transform(rows.filter("split = 'test'")).select(label, F.col("prediction").cast("int").alias("guess"))
    scored = materialised(guessed, "guesses")  # the metrics read them several times
    return E.multiclass_metrics(scored, label, "guess", list(classes))


@query("text_quality_forest")
def text_quality_forest(spark, sf):
    """Random forest without a limit of depth on TF-IDF vectors of the labelled texts, held-out metrics."""
    rows, terms = text_vectors(spark, sf)
    rows = rows.select("doc_id", "split", F.col("quality").cast("int").alias("quality"), "features")
    guessed = Fo.forest_scores(rows, "features", "quality", F.col("split") == "train", ["doc_id"], len(terms))
    scored = materialised(guessed.select(F.col("quality").cast("double").alias("quality"), F.col("prediction").alias("guess")), "guesses")  # the metrics read them several times
    return shown(E.multiclass_metrics(scored, "quality", "guess", [0, 1]))


@query("text_category_logistic")
def text_category_logistic(spark, sf):
    """Multinomial logistic regression on sparse TF-IDF vectors, held-out metrics."""
    return shown(_text_metrics(spark, sf, "logistic"))


@query("text_category_dense_net")
def text_category_dense_net(spark, sf):
    """A dense head of 64 and 32 units on TF-IDF vectors, held-out metrics."""
    return shown(_text_metrics(spark, sf, "dense_net"))


@query("parameter_search")
def parameter_search(spark, sf):
    """Random search over boosted trees on time-ordered folds of all series: 20 candidates, 4 folds."""
    _, table = Bo.boosted_search(_impact(spark, sf), IMPACT, "future_return_1", n_iter=20, n_splits=4, ts="bin")
    return shown(table)


@query("linear_parameter_search")
def linear_parameter_search(spark, sf):
    """Random search over linear models on time-ordered folds of all series."""
    rows = impact_rows(spark, sf)
    space = {"regParam": [0.0, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0], "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0]}
    _, table = M.time_series_cv(rows, lambda s: M.regressor("linear", "future_return_1", **s), space, IMPACT, "future_return_1", n_iter=20, n_splits=4, ts="bin")
    return shown(table)
