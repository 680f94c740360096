"""Isolation forest and reconstruction error, in batch and walk-forward."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.series import SERIES
from tidemark.operators.evaluate import binary_measures
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.splits import assign_refit_windows, standardize
from tidemark.session import fan_out, materialised
from tidemark.sources.writers import append_run

TREES = 200
SUBSAMPLE = 256
CONTAMINATION = 0.02
EULER = 0.5772156649015329

NODE_FIELDS = "node int, feature int, threshold double, left int, right int, depth_cost double"


def path_correction(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits of at most 256 rows; a leaf stores its depth plus the correction for its size."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, depth + float(path_correction(len(rows)))])
        if parent >= 0:
            nodes[parent][3 + side] = me
        if depth >= limit or len(rows) < 2:
            continue
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_to = np.flatnonzero(hi > lo)
        if not len(open_to):
            continue
        f = int(rng.choice(open_to))
        cut = float(rng.uniform(lo[f], hi[f]))
        goes_left = x[rows, f] <= cut
        nodes[me][1], nodes[me][2] = f, cut
        todo.append((rows[~goes_left], depth + 1, me, 1))
        todo.append((rows[goes_left], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


def _as_arrays(nodes: Sequence[tuple]) -> tuple[np.ndarray, ...]:
    cols = list(zip(*nodes))
    return (np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]), np.array(cols[5]))


def forest_score(x: np.ndarray, forest: Sequence[tuple[np.ndarray, ...]], sample: int) -> np.ndarray:
    """``2 ** (-mean path / c(sample))``; all rows go down a tree together."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, cost in forest:
        at = np.zeros(len(x), dtype=int)
        for _ in range(64):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes_left = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        total += cost[at]
    scale = float(path_correction(sample)) or 1.0
    return np.power(2.0, -(total / max(len(forest), 1)) / scale)


def tree_samples(df: DataFrame, cols: Sequence[str], keys: Sequence[str], trees: int, sample: int, seed: int) -> tuple[DataFrame, int]:
    """Every tree's own random rows, drawn by hashes of the row key.

    A row's hash places it on a line, and each tree takes the ``sample`` rows
    that follow its own point there, going round at the end. Rows near a point
    are found by a share of the line that holds a few times as many rows as
    wanted; a tree that still lacks rows has its share doubled. The rule is one
    for all sizes, and no more than that share is copied for a tree.
    """
    n = df.count()
    size = min(sample, n)
    place = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 12) / float(2**52)
    points = np.random.default_rng(seed).random(trees)
    rows = df.select(*keys, *cols).withColumn("_at", place)
    share = min(1.0, (2.0 * size + 64.0) / max(n, 1))
    while True:
        # A row belongs to the trees whose point lies at most ``share`` before it.
        behind = F.filter(
            F.transform(F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(float(p)).alias("p")) for t, p in enumerate(points)]),
                        lambda t: F.struct(t["tree"].alias("tree"), F.pmod(F.col("_at") - t["p"], F.lit(1.0)).alias("u"))),
            lambda t: t["u"] <= share,
        )
        draws = rows.withColumn("_draw", F.explode(behind)).withColumn("tree", F.col("_draw.tree"))
        least = draws.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.count(F.lit(1))).first()
        if share >= 1.0 or (least[1] == trees and least[0] >= size):
            break
        share = min(1.0, 2.0 * share)
    ranked = draws.withColumn("_rank", F.row_number().over(Window.partitionBy("tree").orderBy("_draw.u", *keys)))
    return ranked.filter(F.col("_rank") <= size).select("tree", F.array(*[F.col(c).cast("double") for c in cols]).alias("x")), size


def fit_forest(df: DataFrame, cols: Sequence[str], keys: Sequence[str], trees: int = TREES, sample: int = SUBSAMPLE, seed: int = 42):
    """Trees grown in parallel from their samples.

    Returns the forest as arrays and the sample size. Its size is fixed by
    ``trees`` and ``sample`` (at most ``trees * (2 * sample - 1)`` nodes), which
    is what makes sending it to every task safe.
    """
    samples, size = tree_samples(df, cols, keys, trees, sample, seed)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = grow_tree(np.stack(pdf["x"].to_numpy()), rng)
        return pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "depth_cost"]).assign(tree=int(key[0]))

    grown = fan_out(samples, "tree").groupBy("tree").applyInPandas(grow, f"tree int, {NODE_FIELDS}").toPandas()
    forest = [
        _as_arrays(list(part.sort_values("node")[["node", "feature", "threshold", "left", "right", "depth_cost"]].itertuples(index=False, name=None)))
        for _, part in grown.groupby("tree")
    ]
    return forest, size


def forest_table(spark: SparkSession, forest: Sequence[tuple[np.ndarray, ...]], sample: int) -> DataFrame:
    """A forest as rows: (tree, node, feature, threshold, left, right, depth_cost, sample).

    ``feature`` counts the columns from 0 and is -1 at leaves; a row goes left if
    its value is at most the threshold. Any engine can score with it.
    """
    parts = []
    for t, (feature, threshold, left, right, cost) in enumerate(forest):
        parts.append(pd.DataFrame({"tree": t, "node": np.arange(len(feature)), "feature": feature, "threshold": threshold, "left": left, "right": right, "depth_cost": cost, "sample": sample}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True), f"tree int, {NODE_FIELDS}, sample int")


def store_forest(spark: SparkSession, forest: Sequence[tuple[np.ndarray, ...]], sample: int, table: str) -> int:
    """Add a forest to a table of versions; returns its version, which no other writer gets."""
    return append_run(forest_table(spark, forest, sample), table)


def read_forest(spark: SparkSession, table: str, version: int | None = None) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """A stored forest and its sample size; the newest one by default. Its size is bounded by its settings."""
    rows = spark.read.parquet(table)
    version = rows.agg(F.max("run_id")).first()[0] if version is None else version
    nodes = rows.filter(F.col("run_id") == version).orderBy("tree", "node").toPandas()
    forest = [_as_arrays(list(part[["node", "feature", "threshold", "left", "right", "depth_cost"]].itertuples(index=False, name=None))) for _, part in nodes.groupby("tree")]
    return forest, int(nodes["sample"].iloc[0])


def score_with_forest(df: DataFrame, cols: Sequence[str], forest, sample: int, out: str = "anomaly_score") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(forest_score(np.stack(rows.to_numpy()), shared.value, sample)) if len(rows) else pd.Series([], dtype=float)

    return df.withColumn(out, score(F.array(*[F.col(c).cast("double") for c in cols])))


def isolation_forest(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], trees: int = TREES, sample: int = SUBSAMPLE,
    contamination: float | None = CONTAMINATION, seed: int = 42, by_scaled: bool = True,
) -> DataFrame:
    """Anomaly score per row; with ``contamination`` the top share is flagged.

    Random axis splits ignore the scale of a column, so features need no
    scaling; ``by_scaled=False`` skips the pass that would do it.
    """
    scaled = df
    names = list(cols)
    if by_scaled:
        names = [f"_s_{c}" for c in cols]
        (scaled,) = standardize(df.withColumns({f"_s_{c}": F.col(c).cast("double") for c in cols}), cols=names)
    forest, size = fit_forest(scaled, names, keys, trees, sample, seed)
    scored = score_with_forest(scaled, names, forest, size)
    if by_scaled:
        scored = scored.drop(*names)
    # Stored, so that finding the threshold does not score every row again.
    scored = materialised(scored, "forest-scores")
    if contamination is None:
        return scored
    cut = exact_quantiles(scored, "anomaly_score", [1.0 - contamination])[0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") >= F.lit(cut))


def walk_forward_scores(
    df: DataFrame, cols: Sequence[str], initial: int = 1000, refit: int = 250, rolling: int = 1500,
    trees: int = TREES, sample: int = SUBSAMPLE, seed: int = 42, by: Sequence[str] = SERIES, ts: str = "snapshot_id",
) -> DataFrame:
    """Scores from a forest refit on trailing rows only; null during warm-up.

    All refits of all series run in one job. A group is one refit: at most
    ``rolling`` training rows and ``refit`` rows to score.
    """
    by = list(by)
    placed = assign_refit_windows(df, initial, refit, rolling, by, ts)
    scored = refit_scores(placed, cols, trees, sample, seed, by, ts)
    names = {"anomaly_score": "streaming_score", "model_id": "streaming_model_id"}
    out = df.join(scored.drop("alert").withColumnsRenamed(names), [*by, ts], "left")
    return out.withColumn("streaming_model_id", F.coalesce("streaming_model_id", F.lit(-1)))


def refit_scores(
    placed: DataFrame, cols: Sequence[str], trees: int, sample: int, seed: int, by: Sequence[str], ts: str, budget: float = CONTAMINATION,
) -> DataFrame:
    """Scores of the rows with role ``score`` by the forest of their model's training rows.

    ``alert`` marks scores that reach the budget's quantile among the training rows.
    """
    rows = placed.select(*by, ts, "model_id", "role", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in [*by, ts])

    def fit_and_score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        train = np.stack(pdf.loc[pdf["role"] == "train", "x"].to_numpy())
        chunk = pdf[pdf["role"] == "score"]
        std = train.std(axis=0)
        mean, std = train.mean(axis=0), np.where(std > 0, std, 1.0)
        train = (train - mean) / std
        size = min(sample, len(train))
        forest = []
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            forest.append(_as_arrays(grow_tree(train[rng.choice(len(train), size, replace=False)], rng)))
        score = forest_score((np.stack(chunk["x"].to_numpy()) - mean) / std, forest, size)
        cut = np.quantile(forest_score(train, forest, size), 1.0 - budget)
        return chunk[[*by, ts]].assign(anomaly_score=score, alert=score >= cut, model_id=int(key[-1]))

    return fan_out(rows, *by, "model_id").groupBy(*by, "model_id").applyInPandas(
        fit_and_score, f"{kinds}, anomaly_score double, alert boolean, model_id long"
    )


def pca_reconstruction_score(df: DataFrame, cols: Sequence[str], k: int = 3, out: str = "reconstruction_error") -> DataFrame:
    """Mean squared error of rebuilding each scaled row from its first ``k`` components."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [f"_s_{c}" for c in cols]
    (scaled,) = standardize(df.withColumns({f"_s_{c}": F.col(c).cast("double") for c in cols}), cols=names)
    rows = VectorAssembler(inputCols=names, outputCol="_x").transform(scaled)
    model = PCA(k=k, inputCol="_x", outputCol="_z").fit(rows)
    load = model.pc.toArray()
    rows = model.transform(rows).withColumn("_z", vector_to_array("_z"))
    errors = []
    for i, c in enumerate(names):
        back = reduce(lambda a, b: a + b, [F.col("_z")[j] * float(load[i, j]) for j in range(k)])
        errors.append((F.col(c) - back) * (F.col(c) - back))
    return rows.withColumn(out, reduce(lambda a, b: a + b, errors) / len(cols)).drop("_x", "_z", *names)


def flag_top(df: DataFrame, score: str, share: float = CONTAMINATION, out: str = "is_anomaly") -> DataFrame:
    """Flag rows at or above the exact (1 - share) quantile of the score."""
    cut = exact_quantiles(df, score, [1.0 - share])[0]
    return df.withColumn(out, F.col(score) >= F.lit(cut))


def ablation(df: DataFrame, feature_sets: dict[str, Sequence[str]], truth: str, keys: Sequence[str], **kw) -> DataFrame:
    """Precision, recall and F1 of the forest for every named feature set."""
    parts = []
    for name, cols in feature_sets.items():
        scored = isolation_forest(df, cols, keys, **kw)
        measures = binary_measures(F.col(truth).cast("boolean"), F.col("is_anomaly"))
        picks = [measures[m].alias(m) for m in ("precision", "recall", "f1")]
        parts.append(scored.agg(F.lit(name).alias("feature_set"), F.lit(len(cols)).alias("n_features"), *picks))
    return reduce(lambda a, b: a.unionByName(b), parts)
