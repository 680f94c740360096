"""Row-wise expressions: candle shapes, book ratios, probability maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.series import TINY, ratio


def body_ratio() -> Column:
    return (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + TINY)


def upper_wick_ratio() -> Column:
    return (F.col("high") - F.greatest("open", "close")) / (F.col("high") - F.col("low") + TINY)


def lower_wick_ratio() -> Column:
    return (F.least("open", "close") - F.col("low")) / (F.col("high") - F.col("low") + TINY)


def imbalance(bid: Column, ask: Column) -> Column:
    """``(bid - ask) / (bid + ask)``; null when the book side sum is 0."""
    return ratio(bid - ask, bid + ask)


def cancel_ratio(canceled: Column, executed: Column) -> Column:
    return canceled / (executed + 1)


def horizontal_mean(*cols: str) -> Column:
    """Mean of the values that are there, null if none is."""
    known = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda total, v: total + v) / F.size(known))


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    out = x
    if lower is not None:
        out = F.when(out.isNotNull(), F.greatest(out, F.lit(lower)))
    if upper is not None:
        out = F.when(out.isNotNull(), F.least(out, F.lit(upper)))
    return out


def lower_keys(probs: Column) -> Column:
    return F.transform_keys(probs, lambda k, _: F.lower(k))


def top_label(probs: Column) -> Column:
    """Label with the highest probability; equal ones go to the first name."""
    pairs = F.transform(
        F.map_entries(lower_keys(probs)),
        lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("label")),
    )
    return F.array_min(pairs)["label"]


def polarity(probs: Column) -> Column:
    """P(positive) - P(negative); a label that is missing counts as 0."""
    keyed = lower_keys(probs)
    positive = F.coalesce(F.try_element_at(keyed, F.lit("positive")), F.lit(0.0))
    negative = F.coalesce(F.try_element_at(keyed, F.lit("negative")), F.lit(0.0))
    return positive - negative


def huber(error: Column, delta: float = 1.0) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))


def alert_outcome(truth: Column, flagged: Column) -> Column:
    """Name of a row's outcome under an alert policy."""
    return (
        F.when(truth & flagged, "true_positive")
        .when(~truth & flagged, "false_alarm")
        .when(truth & ~flagged, "missed")
        .otherwise("true_negative")
    )
