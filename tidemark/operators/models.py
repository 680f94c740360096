"""Supervised and unsupervised models on Spark ML with the published settings."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.backtest import classification_pnl
from tidemark.operators.evaluate import adjusted_rand, multiclass_metrics, regression_metrics
from tidemark.operators.splits import assign_folds, expanding_folds, scaled, scaler_stats, standardize
from tidemark.session import allow_checkpoints, materialised


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vectors for fitting, of the rows that have every feature."""
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df.filter(complete(features)))


def complete(features: Sequence[str]) -> Column:
    """Whether all features are there and are numbers."""
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])


def transform_all(model: Model, df: DataFrame, features: Sequence[str], finish: Callable[[DataFrame], DataFrame], out: str = "features") -> DataFrame:
    """Apply a fitted model to every row; one with a missing feature gets nulls.

    ``finish`` turns the model's vectors into plain columns.
    """
    done = finish(model.transform(assemble(df, features, out)))
    return done.unionByName(df.filter(~complete(features)), allowMissingColumns=True)


def classifier(kind: str, label: str, n_rows: int | None = None, n_features: int | None = None, n_classes: int = 2, **params):
    """Estimator by name: logistic, boosted_trees, random_forest or dense_net."""
    from pyspark.ml import classification as C

    common = {"featuresCol": "features", "labelCol": label}
    if kind == "logistic":
        # An L2 penalty of C = 1 on the summed loss is 1 / n on the mean loss.
        reg = params.pop("regParam", 1.0 / n_rows if n_rows else 0.0)
        family = "multinomial" if n_classes > 2 else "auto"
        return C.LogisticRegression(regParam=reg, standardization=False, maxIter=params.pop("maxIter", 100), family=family, **common, **params)
    if kind == "boosted_trees":
        defaults = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42}
        return C.GBTClassifier(**common, **{**defaults, **params})
    if kind == "random_forest":
        # Trees without a limit: 30 is the deepest that Spark grows. Rows keep the nodes they have
        # reached, instead of being led down from the roots for every group of nodes.
        return C.RandomForestClassifier(**common, **{"numTrees": 300, "maxDepth": 30, "cacheNodeIds": True, "seed": 42, **params})
    if kind == "dense_net":
        layers = params.pop("layers", [n_features, 64, 32, n_classes])
        return C.MultilayerPerceptronClassifier(layers=layers, **common, **{"seed": 42, "maxIter": 100, **params})
    raise ValueError(f"unknown classifier {kind}")


def regressor(kind: str, label: str, **params):
    """Estimator by name: boosted_trees, linear or huber."""
    from pyspark.ml import regression as R

    common = {"featuresCol": "features", "labelCol": label}
    if kind == "boosted_trees":
        defaults = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}
        return R.GBTRegressor(**common, **{**defaults, **params})
    if kind == "linear":
        return R.LinearRegression(**common, **params)
    if kind == "huber":
        return R.LinearRegression(loss="huber", **common, **params)
    raise ValueError(f"unknown regressor {kind}")


def fit_classifier(df: DataFrame, kind: str, features: Sequence[str], label: str, n_classes: int = 2, **params) -> Model:
    rows = assemble(df, features).select("features", F.col(label).cast("double").alias(label))
    n = rows.count() if kind == "logistic" and "regParam" not in params else None
    allow_checkpoints(df.sparkSession)
    return classifier(kind, label, n, len(features), n_classes, **params).fit(rows)


def fit_regressor(df: DataFrame, kind: str, features: Sequence[str], label: str, **params) -> Model:
    return regressor(kind, label, **params).fit(assemble(df, features).select("features", F.col(label).cast("double").alias(label)))


def predict(model: Model, df: DataFrame, features: Sequence[str], score: str = "score") -> DataFrame:
    """Predictions, and for classifiers the probability of class 1 as ``score``."""

    def finish(out: DataFrame) -> DataFrame:
        if "probability" in out.columns:
            out = out.withColumn(score, vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability")

    return transform_all(model, df, features, finish)


def feature_importance(model: Model, features: Sequence[str], spark) -> DataFrame:
    """Importance per feature, largest first; linear models give absolute weights."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray())
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def multi_horizon_eval(
    train: DataFrame, test: DataFrame, kind: str, features: Sequence[str], horizons: Sequence[int] = (1, 5, 15), **params
) -> DataFrame:
    """Regression metrics of one model per forward horizon."""
    parts = []
    for h in horizons:
        target = f"future_return_{h}"
        model = fit_regressor(train, kind, features, target, **params)
        mean = train.agg(F.avg(target)).first()[0]
        table = regression_metrics(predict(model, test, features), target, "prediction", mean)
        parts.append(table.withColumn("horizon", F.lit(h)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def time_series_cv(
    df: DataFrame, make: Callable[[dict], object], space: dict[str, Sequence], features: Sequence[str], label: str,
    n_iter: int = 20, n_splits: int = 4, seed: int = 42, by: Sequence[str] = ("series_id",), ts: str = "ts", threads: int = 4,
) -> tuple[dict, DataFrame]:
    """Random search with expanding folds; returns the best settings and the RMSE table.

    ``make(settings)`` builds the estimator. Fits are Spark jobs; a few are
    submitted side by side so that small ones do not leave the cluster idle.
    """
    draw = random.Random(seed)
    tried = [{k: draw.choice(list(v)) for k, v in space.items()} for _ in range(n_iter)]
    folds = assemble(expanding_folds(df, n_splits, by, ts), features).select(
        "features", F.col(label).cast("double").alias(label), "fold", "role"
    ).persist()

    def rmse(job: tuple[int, int]) -> tuple[int, int, float]:
        candidate, fold = job
        part = folds.filter(F.col("fold") == fold)
        model = make(tried[candidate]).fit(part.filter("role = 'train'"))
        err = F.col(label) - F.col("prediction")
        return candidate, fold, model.transform(part.filter("role = 'test'")).agg(F.sqrt(F.avg(err * err))).first()[0]

    jobs = [(c, f) for c in range(n_iter) for f in range(n_splits)]
    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(rmse, jobs))
    folds.unpersist()
    table = df.sparkSession.createDataFrame(rows, "candidate int, fold int, rmse double")
    means = [sum(r[2] for r in rows if r[0] == c) / n_splits for c in range(n_iter)]
    return tried[means.index(min(means))], table


def walk_forward_eval(
    df: DataFrame, kind: str, features: Sequence[str], label: str = "label_direction", fwd: str = "fwd_log_ret", n_classes: int = 3,
    n_folds: int = 5, by: Sequence[str] = ("series_id",), ts: str = "ts", **params,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit per fold on its past, predict its test block.

    Returns the pooled predictions, the metrics per fold, and the trading
    result per series over the joined test blocks, in which positions carry
    over fold borders. Folds are placed and scaled together and written once;
    their fits are submitted side by side, and the pooled predictions are
    written for all that is read from them.
    """
    placed = materialised(assign_folds(df, n_folds, by=by, ts=ts).filter("role <> 'val'"), "folds")
    # One row for each fold.
    stats = F.broadcast(scaler_stats(placed.filter("role = 'train'"), features, ["fold"]))
    ready = materialised(scaled(placed.join(stats, "fold"), features), "scaled-folds")

    def scored(k: int) -> DataFrame:
        rows = ready.filter(F.col("fold") == k)
        model = fit_classifier(rows.filter("role = 'train'"), kind, features, label, n_classes, **params)
        out = predict(model, rows.filter("role = 'test'"), features)
        return out.withColumn("prediction", F.col("prediction").cast("int"))

    with ThreadPoolExecutor(n_folds) as pool:
        parts = list(pool.map(scored, range(n_folds)))
    pooled = materialised(reduce(lambda a, b: a.unionByName(b), parts), "pooled")
    metrics = multiclass_metrics(pooled, label, "prediction", range(n_classes), ["fold"])
    return pooled, metrics, classification_pnl(pooled, "prediction", fwd, by=by, ts=ts)


def _best_start(rows: DataFrame, make: Callable[[int], object], seeds: Sequence[int], loss: Callable[[Model], float]):
    """The fitted model with the least loss over several starts, and its silhouette."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    model = min((make(seed).fit(rows) for seed in seeds), key=loss)
    assigned = model.transform(rows)
    clusters = assigned.agg(F.count_distinct("prediction")).first()[0]
    return model, ClusteringEvaluator().evaluate(assigned) if clusters > 1 else -1.0


def select_k(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 7), seed: int = 42, starts: int = 10):
    """KMeans for every k, the best of several starts; returns (best model, best k, table).

    Spark's silhouette uses squared Euclidean distance, so its values differ
    from those of the plain distance; the ranking is what is used.
    """
    from pyspark.ml.clustering import KMeans

    rows = assemble(df, cols).persist()
    fitted = {k: _best_start(rows, lambda s, k=k: KMeans(k=k, seed=s, maxIter=50), range(seed, seed + starts), lambda m: m.summary.trainingCost) for k in ks}
    rows.unpersist()
    best = max(fitted, key=lambda k: fitted[k][1])
    table = df.sparkSession.createDataFrame([(k, float(score)) for k, (_, score) in fitted.items()], "k int, silhouette double")
    return fitted[best][0], best, table


def fit_gmm(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, starts: int = 5) -> tuple[Model, float]:
    """Gaussian mixture, the best of several starts, and the silhouette of its assignment."""
    from pyspark.ml.clustering import GaussianMixture

    rows = assemble(df, cols).persist()
    model, score = _best_start(rows, lambda s: GaussianMixture(k=k, seed=s), range(seed, seed + starts), lambda m: -m.summary.logLikelihood)
    rows.unpersist()
    return model, score


def detect_regimes(features: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 7), seed: int = 42) -> tuple[DataFrame, str]:
    """Cluster scaled features; the better silhouette of KMeans and mixture wins."""
    names = [f"_s_{c}" for c in cols]
    (scaled,) = standardize(features.withColumns({f"_s_{c}": F.col(c) for c in cols}), cols=names)
    kmeans, k, table = select_k(scaled, names, ks, seed)
    best = table.agg(F.max("silhouette")).first()[0]
    mixture, mixture_score = fit_gmm(scaled, names, k, seed)
    model, name = (mixture, "GMM") if mixture_score > best else (kmeans, "KMeans")
    assigned = transform_all(model, scaled, names, lambda d: d.drop("features", "probability")).withColumn("cluster", F.col("prediction"))
    return assigned.drop("prediction", *names), name


def pca_2d(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """First two component scores of the scaled columns, with the variance shares."""
    from pyspark.ml.feature import PCA

    names = [f"_s_{c}" for c in cols]
    (scaled,) = standardize(df.withColumns({f"_s_{c}": F.col(c).cast("double") for c in cols}), cols=names)
    rows = assemble(scaled, names, "_x")
    model = PCA(k=2, inputCol="_x", outputCol="_z").fit(rows)
    z = vector_to_array("_z")
    placed = transform_all(model, scaled, names, lambda d: d.withColumns({"pc1": z[0], "pc2": z[1]}).drop("_x", "_z"), "_x")
    return placed.select(*keys, "pc1", "pc2"), model.explainedVariance.toArray().tolist()


__all__ = [
    "adjusted_rand", "assemble", "classifier", "detect_regimes", "feature_importance", "fit_classifier", "fit_gmm", "fit_regressor",
    "multi_horizon_eval", "pca_2d", "predict", "regressor", "select_k", "time_series_cv", "walk_forward_eval",
]
