"""Model and alert evaluation; every table comes from one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shapes import huber
from tidemark.operators.quantiles import exact_quantiles, ordered_totals
from tidemark.operators.attach import attach_row

# Alert budgets as fractions of the scored rows.
BUDGETS = (0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05)


def _ratio(a: Column, b: Column) -> Column:
    """``a / b`` with 0 for an empty denominator."""
    return F.when(b != 0, a / b).otherwise(0.0)


def binary_measures(truth: Column, pred: Column) -> dict[str, Column]:
    tp = F.count(F.when(truth & pred, 1))
    fp = F.count(F.when(~truth & pred, 1))
    fn = F.count(F.when(truth & ~pred, 1))
    tn = F.count(F.when(~truth & ~pred, 1))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn,
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * precision * recall, precision + recall),
    }


def binary_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth).cast("boolean"), F.col(pred).cast("boolean")
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in binary_measures(t, p).items()])


def confusion(df: DataFrame, truth: str, pred: str, labels: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts for every pair of labels, empty cells included, with row shares."""
    by = list(by)
    counted = df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n_rows"))
    if labels is not None:
        spark, kind = df.sparkSession, df.schema[truth].dataType
        cell = F.array(*[F.lit(v).cast(kind) for v in labels])
        groups = counted.select(*by).distinct() if by else spark.range(1)
        grid = groups.select(*by, F.explode(cell).alias("truth")).withColumn("pred", F.explode(cell))
        counted = grid.join(counted, [*by, "truth", "pred"], "left").fillna({"n_rows": 0})
    per_row = counted.groupBy(*by, "truth").agg(F.sum("n_rows").alias("_total"))
    return counted.join(per_row, [*by, "truth"]).select(*by, "truth", "pred", "n_rows", _ratio(F.col("n_rows"), F.col("_total")).alias("row_share"))


def multiclass_metrics(df: DataFrame, truth: str, pred: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision, recall, F1 and support, with accuracy and macro F1 on each row."""
    by = list(by)
    cells = confusion(df, truth, pred, labels, by)
    hits = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n_rows")).otherwise(0))
    by_truth = cells.groupBy(*by, F.col("truth").alias("label")).agg(F.sum("n_rows").alias("support"), hits.alias("_hit"))
    by_pred = cells.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n_rows").alias("_predicted"))
    rows = by_truth.join(by_pred, [*by, "label"]).select(
        *by, "label", "support", "_hit",
        _ratio(F.col("_hit"), F.col("_predicted")).alias("precision"),
        _ratio(F.col("_hit"), F.col("support")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    rows = rows.withColumn("f1", _ratio(2 * p * r, p + r))
    overall = rows.groupBy(*by).agg(
        _ratio(F.sum("_hit"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )
    rows = rows.drop("_hit")
    return rows.join(overall, by) if by else attach_row(rows, overall)


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """True and false positive rates at every distinct score, ties together."""
    t = F.col(truth).cast("boolean")
    cum = ordered_totals(
        df.filter(F.col(score).isNotNull()), score,
        {"pos": F.count(F.when(t, 1)), "neg": F.count(F.when(~t, 1))},
    )
    return cum.select(
        F.col(score).alias("threshold"), "pos", "neg", "cum_pos", "cum_neg", "all_pos", "all_neg",
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
        _ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
    )


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area under the curve: trapezoids over the steps between distinct scores."""
    steps = roc_curve(df, truth, score)
    before = F.col("cum_pos") - F.col("pos")
    area = F.sum(F.col("neg") * (before + F.col("cum_pos")) / 2)
    cells = F.max("all_pos") * F.max("all_neg")
    return steps.agg(F.when(cells > 0, area / cells).alias("roc_auc"))


def regression_measures(truth: str, pred: str, train_mean: Column) -> dict[str, Column]:
    y, err = F.col(truth), F.col(truth) - F.col(pred)
    sse, n = F.sum(err * err), F.count(err)
    base = y - train_mean
    rmse, baseline = F.sqrt(F.avg(err * err)), F.sqrt(F.avg(base * base))
    return {
        "rmse": rmse,
        "mae": F.avg(F.abs(err)),
        "r2": 1 - sse / F.nullif(F.var_pop(y) * n, F.lit(0.0)),
        "baseline_rmse": baseline,
        "reduction_pct": (1 - rmse / F.nullif(baseline, F.lit(0.0))) * 100,
        "n_test": n,
    }


def regression_metrics(df: DataFrame, truth: str, pred: str, train_mean: float | str, by: Sequence[str] = ()) -> DataFrame:
    """``train_mean`` is a number, or a column that holds it."""
    mean = F.col(train_mean) if isinstance(train_mean, str) else F.lit(float(train_mean))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in regression_measures(truth, pred, mean).items()])


def huber_metric(df: DataFrame, truth: str, pred: str, delta: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(huber(F.col(truth) - F.col(pred), delta)).alias("huber"))


def precision_at_budget(df: DataFrame, score: str, truth: str, budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """One row per alert budget: threshold, alerts, precision, recall and F1.

    The exact thresholds are plain numbers, so all budgets share one aggregate
    pass and no row is multiplied.
    """
    scored = df.filter(F.col(score).isNotNull())
    cuts = exact_quantiles(scored, score, [1.0 - b for b in budgets])
    t = F.col(truth).cast("boolean")
    rows = []
    for budget, cut in zip(budgets, cuts):
        m = binary_measures(t, F.col(score) >= F.lit(cut))
        rows.append(
            F.struct(
                F.lit(budget * 100).alias("budget_pct"), F.lit(cut).cast("double").alias("threshold"),
                (m["tp"] + m["fp"]).alias("n_flagged"), m["precision"].alias("precision"),
                m["recall"].alias("recall"), m["f1"].alias("f1"),
            )
        )
    return scored.agg(F.array(*rows).alias("m")).select(F.inline("m"))


def join_sweeps(batch: DataFrame, walk_forward: DataFrame) -> DataFrame:
    """Batch and walk-forward sweeps side by side per budget."""
    left = batch.select("budget_pct", *[F.col(c).alias(f"{c}_batch") for c in batch.columns if c != "budget_pct"])
    right = walk_forward.select("budget_pct", *[F.col(c).alias(f"{c}_walk") for c in walk_forward.columns if c != "budget_pct"])
    return left.join(right, "budget_pct")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency counts of two labelings."""
    cells = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_n"))

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    both = cells.agg(F.sum(pairs(F.col("_n"))).alias("both"), F.sum("_n").alias("n"))
    rows = cells.groupBy("_a").agg(F.sum("_n").alias("_n")).agg(F.sum(pairs(F.col("_n"))).alias("rows"))
    cols = cells.groupBy("_b").agg(F.sum("_n").alias("_n")).agg(F.sum(pairs(F.col("_n"))).alias("cols"))
    one = attach_row(attach_row(both, rows), cols)
    expected = F.col("rows") * F.col("cols") / F.nullif(pairs(F.col("n")), F.lit(0.0))
    top, span = F.col("both") - expected, (F.col("rows") + F.col("cols")) / 2 - expected
    return one.select(F.when(span == 0, 1.0).otherwise(top / span).alias("adjusted_rand"))


def ranked(df: DataFrame, by_metric: str, ties: Sequence[str], out: str = "rank") -> DataFrame:
    """Rows of a result table with their place by a metric, greatest first, missing ones last; equal ones by ``ties``.

    Meant for tables of results, of pairs, budgets or models; one task numbers them.
    """
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.col(by_metric).desc_nulls_last(), *ties)))


def leaderboard(*metrics: DataFrame) -> DataFrame:
    """Metric tables of several approaches under each other; absent columns are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), metrics)


def choose_variant(metrics: DataFrame, variant: str, by_metric: str, by: Sequence[str] = ()) -> DataFrame:
    """The variant with the best validation metric; equal ones go to the first name."""
    best = F.min_by(variant, F.struct(-F.col(by_metric), F.col(variant)))
    return metrics.groupBy(*by).agg(best.alias(variant), F.max(by_metric).alias(by_metric))
