"""Second moments of all pairs of series without emitting pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_moments(rows: DataFrame, value: str = "ret", by: Sequence[str] = (), ts: str = "date", series: str = "series_id") -> DataFrame:
    """Counts, sums and products, from an origin near the values, of every pair of series over their common dates.

    One row per ``by`` and pair ``i < j``, plus ``i = j``. Every date is first
    gathered as one array with a value per series. A task turns a batch of
    dates into a dates-by-series matrix and reduces it to one row per pair by
    matrix products, so neither the shuffle nor the task ever holds a row per
    pair and date. Dates on which one of the two is missing do not count.

    Values are taken from their series' minimum before they are multiplied, so
    that a level far above the deviations costs no digits; covariance and
    correlation are the same from any origin.
    """
    by = list(by)
    known = rows.filter(F.col(value).isNotNull())
    origin = known.groupBy(series).agg(F.min(F.col(value).cast("double")).alias("_origin"))
    known = known.join(origin, series).withColumn(value, F.col(value).cast("double") - F.col("_origin"))
    dates = known.groupBy(*by, ts).agg(F.collect_list(F.struct(F.col(series).alias("s"), F.col(value).cast("double").alias("v"))).alias("c"))
    packed = dates.select(*by, F.col("c.s").alias("ids"), F.col("c.v").alias("vals"))
    keys = "".join(f"{b} {rows.schema[b].dataType.simpleString()}, " for b in by)

    def reduce_batch(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sizes = part["ids"].map(len).to_numpy()
        names, column = np.unique(np.concatenate(part["ids"].to_numpy()), return_inverse=True)
        x = np.zeros((len(part), len(names)))
        seen = np.zeros_like(x)
        row = np.repeat(np.arange(len(part)), sizes)
        x[row, column] = np.concatenate(part["vals"].to_numpy())
        seen[row, column] = 1.0
        i, j = np.triu_indices(len(names))
        n, s, q, xy = seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x
        out = pd.DataFrame({"i": names[i], "j": names[j], "n": n[i, j], "sx": s[i, j], "sy": s[j, i], "sxx": q[i, j], "syy": q[j, i], "sxy": xy[i, j]})
        for name, k in zip(by, key):
            out.insert(0, name, k)
        return out[out["n"] > 0]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            yield pd.concat([reduce_batch(key, part) for key, part in groups])[[*by, "i", "j", *SUMS]]

    fields = ", ".join(f"{c} double" for c in SUMS)
    parts = packed.mapInPandas(partial, f"{keys}i string, j string, {fields}")
    return parts.groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def covariance() -> Column:
    """Sample covariance (n - 1) from the sums; null below two common dates."""
    return F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1))


def correlation() -> Column:
    """Pearson correlation from the sums; null when a side does not vary."""
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))


def both_ways(upper: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Long symmetric matrix from rows with ``i <= j``."""
    lower = upper.filter(F.col("i") != F.col("j")).select(*by, F.col("j").alias("i"), F.col("i").alias("j"), value)
    return upper.select(*by, "i", "j", value).unionByName(lower)
