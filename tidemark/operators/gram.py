"""Cross-product matrices per group and the small solves that follow them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_size(width: int) -> int:
    return width * (width + 1) // 2


def unpack(flat: Sequence[float], width: int) -> np.ndarray:
    """Upper triangle, row by row, back to a symmetric matrix."""
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = np.asarray(flat, dtype=float)
    return out + np.triu(out, 1).T


def grouped_gram(df: DataFrame, row: str, width: int, by: Sequence[str]) -> DataFrame:
    """``sum(row * row')`` per group as the flat upper triangle ``gram``, with ``n_rows``.

    Every Arrow batch is reduced to one matrix per group that occurs in it, so
    what is shuffled is matrices, not rows, and a hot group is shared by all
    tasks that read it.
    """
    by = list(by)
    size = gram_size(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            keys = batch.select(list(range(len(by))))
            group = keys.to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            first = np.unique(group, return_index=True)[1]
            parts = [rows[group == g] for g in range(len(first))]
            grams = [(m.T @ m)[upper] for m in parts]
            kept = keys.take(pa.array(first))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([len(m) for m in parts], pa.int64()), pa.array(grams, pa.list_(pa.float64()))],
                names=[*by, "n_rows", "gram"],
            )

    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    parts = df.select(*by, row).mapInArrow(partial, f"{keys}, n_rows long, gram array<double>")
    cells = parts.select(*by, F.posexplode(F.concat(F.array(F.col("n_rows").cast("double")), "gram")).alias("_pos", "_x"))
    summed = cells.groupBy(*by, "_pos").agg(F.sum("_x").alias("_x"))
    packed = summed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_cells"))
    flat = packed.select(*by, F.transform("_cells", lambda c: c["_x"]).alias("_flat"))
    return flat.select(*by, F.col("_flat")[0].cast("long").alias("n_rows"), F.slice("_flat", 2, size).alias("gram"))


def _from_origin(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Design rows (1, x, y) counted from each group's minima, and the minima.

    Cross products of values far from zero lose the digits their deviations
    need; from an origin near the values they keep them.
    """
    cols = [*features, label]
    full = df.na.drop(subset=cols)
    origins = full.groupBy(*by).agg(F.array(*[F.min(F.col(c).cast("double")) for c in cols]).alias("_origin"))
    shifted = [F.col(c).cast("double") - F.col("_origin")[i] for i, c in enumerate(cols)]
    return full.join(origins, list(by)).select(*by, *keep, F.array(F.lit(1.0), *shifted).alias("_row")), origins


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Ridge on standardised features per group, solved from one pass of cross products.

    One row per group and feature with its coefficient (per training standard
    deviation), mean and deviation; feature ``(intercept)`` holds the label
    mean.
    """
    by, features = list(by), list(features)
    width = len(features) + 2
    design, origins = _from_origin(df, features, label, by)
    grams = grouped_gram(design, "_row", width, by).join(origins.withColumnRenamed("_origin", "origin"), by)
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = tuple(getattr(r, b) for b in by)
                w, mean, std, level = ridge_weights(unpack(r.gram, width), alpha)
                origin = np.asarray(r.origin, dtype=float)
                mean, level = mean + origin[:-1], level + origin[-1]
                out.append((*key, "(intercept)", level, 0.0, 1.0))
                out += [(*key, f, *vals) for f, *vals in zip(features, w.tolist(), mean.tolist(), std.tolist())]
            yield pd.DataFrame(out, columns=[*by, "feature", "coefficient", "mean", "std"])

    return grams.mapInPandas(solve, f"{keys}, feature string, coefficient double, mean double, std double")


def ridge_weights(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights on standardised features from the cross products of (1, x, y)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 0.0))
    std[std == 0] = 1.0
    a = cov[:-1, :-1] / np.outer(std, std)
    b = cov[:-1, -1] / std
    w = np.linalg.solve(a + alpha * np.eye(len(std)), b)
    return w, mean[:-1], std, float(mean[-1])


def predict_ridge(df: DataFrame, model: DataFrame, features: Sequence[str], by: Sequence[str], out: str = "prediction") -> DataFrame:
    """Score rows with ``fit_ridge`` coefficients, which are pivoted to one row per group."""
    named = {"(intercept)": "_w0", **{f: f"_w{i}" for i, f in enumerate(features, 1)}}
    picks = []
    for f, w in named.items():
        own = F.col("feature") == f
        picks.append(F.max(F.when(own, F.col("coefficient") / F.col("std"))).alias(w))
        picks.append(F.max(F.when(own, F.col("mean"))).alias(f"{w}_mean"))
    wide = model.groupBy(*by).agg(*picks)
    total = F.col("_w0")
    for f in features:
        total = total + F.col(named[f]) * (F.col(f) - F.col(f"{named[f]}_mean"))
    extra = [c for w in named.values() for c in (w, f"{w}_mean")]
    return df.join(wide, list(by)).withColumn(out, total).drop(*extra)


def ridge_search(folds: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Validation RMSE of every penalty on every time-ordered fold, from one pass.

    ``folds`` has ``fold`` and ``role`` (train or test). Training and test
    errors both follow from cross products, so candidates cost no extra scan.
    """
    by, features = list(by), list(features)
    width = len(features) + 2
    design, _ = _from_origin(folds, features, label, by, ["fold", "role"])
    grams = grouped_gram(design, "_row", width, [*by, "fold", "role"])
    sides = [grams.filter(F.col("role") == r).select(*by, "fold", F.col("gram").alias(r)) for r in ("train", "test")]
    both = sides[0].join(sides[1], [*by, "fold"])
    keys = ", ".join(f"{b} {folds.schema[b].dataType.simpleString()}" for b in by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = tuple(getattr(r, b) for b in by)
                train, test = unpack(r.train, width), unpack(r.test, width)
                for alpha in alphas:
                    w, mean, std, level = ridge_weights(train, alpha)
                    raw = w / std
                    coef = np.concatenate([[level - raw @ mean], raw, [-1.0]])
                    rmse = float(np.sqrt(max(coef @ test @ coef, 0.0) / test[0, 0]))
                    out.append((*key, int(r.fold), float(alpha), rmse))
            yield pd.DataFrame(out, columns=[*by, "fold", "alpha", "rmse"])

    return both.mapInPandas(solve, f"{keys}, fold int, alpha double, rmse double")
