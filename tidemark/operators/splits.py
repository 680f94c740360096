"""Time-safe splits, fold assignment and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import SERIES
from tidemark.operators.ordering import key_digest, row_index
from tidemark.operators.attach import attach_row


def chronological_split(
    df: DataFrame, fractions: Sequence[float] = (0.7, 0.15, 0.15), names: Sequence[str] = ("train", "val", "test"),
    by: Sequence[str] = SERIES, ts: str = "ts", out: str = "split", slots: bool = True,
) -> DataFrame:
    """Name the part of its series each row falls into, earliest part first.

    Borders are ``int(n * fraction)``; the last part takes the rest. Bars can
    be numbered in one window with ``slots=False``.
    """
    numbered = row_index(df, by, ts, name="_idx", total="_len", slots=slots)
    label: Column | None = None
    end: Column = F.lit(0)
    for share, name in zip(fractions[:-1], names):
        end = end + F.floor(F.col("_len") * share)
        label = F.when(F.col("_idx") < end, name) if label is None else label.when(F.col("_idx") < end, name)
    label = F.lit(names[-1]) if label is None else label.otherwise(names[-1])
    return numbered.withColumn(out, label).drop("_idx", "_len")


def fold_table(n_folds: int = 5, min_train: float = 0.5, val: float = 0.15, length: str = "_len") -> Column:
    """Array of expanding walk-forward folds, as expressions of the series length."""
    n = F.col(length)
    first = F.floor(n * min_train)
    block = F.floor((n - first) / n_folds)
    folds = []
    for k in range(n_folds):
        start = first + k * block
        end = n if k == n_folds - 1 else start + block
        folds.append(
            F.struct(
                F.lit(k).alias("fold"), F.floor(start * (1 - val)).alias("val_start"),
                start.alias("test_start"), end.cast("long").alias("test_end"),
            )
        )
    return F.array(*folds)


def assign_folds(
    df: DataFrame, n_folds: int = 5, min_train: float = 0.5, val: float = 0.15,
    by: Sequence[str] = SERIES, ts: str = "ts", slots: bool = True,
) -> DataFrame:
    """One row per (row, fold it takes part in) with its role: train, val or test.

    The fold borders are computed from the exact series length on each row, so
    no fold table has to be joined.
    """
    numbered = row_index(df, by, ts, name="row_idx", total="_len", slots=slots)
    spread = numbered.withColumn("_f", F.explode(fold_table(n_folds, min_train, val)))
    i = F.col("row_idx")
    role = (
        F.when(i < F.col("_f.val_start"), "train")
        .when(i < F.col("_f.test_start"), "val")
        .when(i < F.col("_f.test_end"), "test")
    )
    return (
        spread.withColumn("fold", F.col("_f.fold")).withColumn("role", role).filter(F.col("role").isNotNull())
        .drop("_f", "_len")
    )




def expanding_folds(df: DataFrame, n_splits: int = 4, by: Sequence[str] = SERIES, ts: str = "ts", slots: bool = True) -> DataFrame:
    """Time-series cross-validation: each fold tests the block after its training rows."""
    numbered = row_index(df, by, ts, name="row_idx", total="_len", slots=slots)
    size = F.floor(F.col("_len") / (n_splits + 1))
    starts = F.array(*[F.struct(F.lit(k).alias("fold"), (F.col("_len") - (n_splits - k) * size).alias("start")) for k in range(n_splits)])
    spread = numbered.withColumn("_size", size).withColumn("_f", F.explode(starts))
    i = F.col("row_idx")
    role = F.when(i < F.col("_f.start"), "train").when(i < F.col("_f.start") + F.col("_size"), "test")
    return (
        spread.withColumn("fold", F.col("_f.fold")).withColumn("role", role).filter(F.col("role").isNotNull())
        .drop("_f", "_len", "_size")
    )


def assign_refit_windows(
    df: DataFrame, initial: int = 1000, refit: int = 250, rolling: int = 1500,
    by: Sequence[str] = SERIES, ts: str = "ts", slots: bool = True,
) -> DataFrame:
    """One row per (row, refit model): training rows and the chunk the model scores.

    Model m is fit on the ``rolling`` rows before row ``initial + m * refit``
    and scores the ``refit`` rows from there. The models of a row follow from
    its index, so rows are copied at most ``rolling / refit + 1`` times.
    """
    return refit_roles(row_index(df, by, ts, name="row_idx", total="_len", slots=slots), initial, refit, rolling).drop("_len")


def refit_roles(numbered: DataFrame, initial: int, refit: int, rolling: int) -> DataFrame:
    """Models and roles of rows that know their index and their series' length."""
    i = F.col("row_idx")
    first = F.greatest(F.lit(0), F.floor((i - initial) / refit))
    last_model = F.floor((F.col("_len") - initial - 1) / refit)
    last = F.least(F.floor((i + rolling - initial) / refit), last_model)
    models = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    spread = numbered.withColumn("model_id", F.explode(models))
    end = initial + F.col("model_id") * refit
    role = F.when((i < end) & (i >= end - rolling), "train").when((i >= end) & (i < end + refit), "score")
    return spread.withColumn("role", role).filter(F.col("role").isNotNull())


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test: float = 0.25, seed: int = 42, out: str = "split") -> DataFrame:
    """Seeded split with the same test share in every class.

    Rows are ordered by a hash of their key inside (class, hash slice), and the
    slices' sizes give the exact position in the class, so a class that holds
    most rows is still spread over tasks.
    """
    # 60 bits of a digest, as a number that has its order
    hashed = df.withColumn("_h", F.conv(F.substring(key_digest(keys, seed), 1, 15), 16, 10).cast("long"))
    placed = row_index(
        hashed, by=[label], ts="_h", ties=list(keys), slot_width=1 << 44, name="_idx", total="_len"
    )
    n_test = F.ceil(F.col("_len") * test - 1e-9)
    return placed.withColumn(out, F.when(F.col("_idx") < n_test, "test").otherwise("train")).drop("_h", "_idx", "_len")


def scaler_stats(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return train.groupBy(*by).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_std_{c}") for c in cols]
    )


def standardize(train: DataFrame, *others: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> list[DataFrame]:
    """Scale by the training rows' mean and population deviation (0 counts as 1)."""
    stats = scaler_stats(train, cols, by)
    return [scaled(df.join(stats, list(by)) if by else attach_row(df, stats), cols) for df in (train, *others)]


def scaled(joined: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that carry their ``scaler_stats``, scaled by them."""
    values = {
        c: (F.col(c) - F.col(f"_mean_{c}"))
        / F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(1.0)
        for c in cols
    }
    return joined.withColumns(values).drop(*[f"_{k}_{c}" for k in ("mean", "std") for c in cols])


def zscore_flag(df: DataFrame, col: str, threshold: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Whole-sample z-score and the rows beyond the threshold."""
    (scaled,) = standardize(df.withColumn("zscore", F.col(col).cast("double")), cols=["zscore"], by=by)
    return scaled.withColumn("is_anomaly", F.abs("zscore") >= threshold)


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_rows"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(whole))
