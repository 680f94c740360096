"""All pairs of series from tiles: matrices of dates by a few series, two of them in a task.

What is computed for a pair needs both histories side by side, but no row for
every date and pair. A tile is a few series; each pair of tiles is one group,
in which the dates become the rows of two matrices. The panel is copied once for
each tile, not once for each series. A group's size follows from how long a
series is, which the calendar bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a tile, and its most series.
TILE_VALUES = 1 << 21
TILE_SERIES = 64
#: Groups wanted for each parallel task, so that none of them is waited for.
GROUPS_A_TASK = 3


def tile_width(n_series: int, longest: int, tasks: int) -> int:
    """Series of a tile: as many as fit, but no more than leave enough groups for the tasks."""
    tiles = math.ceil((math.sqrt(1 + 8 * GROUPS_A_TASK * max(tasks, 1)) - 1) / 2)
    return max(1, min(TILE_SERIES, TILE_VALUES // max(longest, 1), math.ceil(n_series / tiles)))


def per_tile_pair(
    rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame | None], schema: str,
    value: str = "price", series: str = "series_id", ts: str = "date",
) -> DataFrame:
    """Rows that ``work(names, others, dates, y, x)`` returns for every pair of tiles.

    ``y`` and ``x`` have a row for each date and a column for each of ``names``
    and ``others``, NaN where a series has no value. Every name of ``names`` is
    to be paired with those of ``others`` that come after it. A series with
    several rows on a date keeps the greatest value.
    """
    known = rows.filter(F.col(value).isNotNull()).groupBy(F.col(series).alias("s"), F.col(ts).alias("t")).agg(F.max(F.col(value).cast("double")).alias("v"))
    names = known.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    size = names.agg(F.count(F.lit(1)).alias("series"), F.max("n").alias("longest")).first()
    tasks = int(rows.sparkSession.sparkContext.defaultParallelism)
    width = tile_width(size["series"], size["longest"] or 1, tasks)
    tiles = math.ceil(size["series"] / width) or 1
    # One row for each series, so one task numbers them.
    numbered = names.select("s", F.floor((F.row_number().over(Window.orderBy("s")) - 1) / width).alias("tile"))
    placed = known.join(numbered, "s").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    placed = placed.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "s", "t", "v")

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dates, row = np.unique(pdf["t"].to_numpy(), return_inverse=True)

        def matrix(tile: int) -> tuple[np.ndarray, np.ndarray]:
            mine = (pdf["tile"] == tile).to_numpy()
            ids, column = np.unique(pdf["s"].to_numpy()[mine], return_inverse=True)
            out = np.full((len(dates), len(ids)), np.nan)
            out[row[mine], column] = pdf["v"].to_numpy()[mine]
            return ids, out

        (ids, y), (others, x) = matrix(key[0]), matrix(key[1])
        out = work(ids, others, dates, y, x)
        return out if out is not None else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])

    groups = tiles * (tiles + 1) // 2
    return placed.repartition(max(1, min(groups, 4 * GROUPS_A_TASK * tasks)), "a", "b").groupBy("a", "b").applyInPandas(group, schema)


def same_gaps(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows with values, columns) for each set of columns that lack the same dates."""
    there = ~np.isnan(values)
    _, kind = np.unique(there, axis=1, return_inverse=True)
    return [(there[:, kind.ravel() == k][:, 0], np.flatnonzero(kind.ravel() == k)) for k in range(kind.max() + 1)] if values.shape[1] else []


def rolling_correlations(y: np.ndarray, x: np.ndarray, n: int, chunk: int = 256) -> np.ndarray:
    """(dates, columns of y, columns of x): correlation over the last ``n`` dates; NaN before, or if a side does not vary."""
    out = np.full((len(y), y.shape[1], x.shape[1]), np.nan)
    for start in range(0, max(0, len(y) - n + 1), chunk):
        last = min(start + chunk, len(y) - n + 1)
        windows = []
        for side in (y, x):
            # (windows, columns, dates of the window), from each window's mean
            w = np.lib.stride_tricks.sliding_window_view(side[start : last + n - 1], n, axis=0)
            w = w - w.mean(axis=2, keepdims=True)
            w = np.where((side_range(side[start : last + n - 1], n) > 0)[:, :, None], w, 0.0)
            windows.append((w, np.sqrt((w * w).sum(axis=2))))
        (a, da), (b, db) = windows
        scale = da[:, :, None] * db[:, None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[start + n - 1 : last + n - 1] = np.where(scale > 0, np.einsum("win,wjn->wij", a, b, optimize=True) / scale, np.nan)
    return out


def side_range(side: np.ndarray, n: int) -> np.ndarray:
    """Largest less smallest value of each window: zero exactly where nothing varies."""
    w = np.lib.stride_tricks.sliding_window_view(side, n, axis=0)
    return w.max(axis=2) - w.min(axis=2)


def mean_rolling_correlation(returns: DataFrame, n: int, value: str = "ret", ts: str = "date", series: str = "series_id", out: str = "avg_pairwise_corr") -> DataFrame:
    """Mean over all pairs of series of their correlation over their last ``n`` common dates, per date.

    A pair counts on its common dates from the ``n``-th on, if both sides vary;
    a date without such a pair has no row.
    """

    def work(names, others, dates, y, x):
        same = names[0] == others[0]
        total, count = np.zeros(len(dates)), np.zeros(len(dates), dtype=np.int64)
        for has_y, cols_y in same_gaps(y):
            for has_x, cols_x in same_gaps(x):
                both = np.flatnonzero(has_y & has_x)
                corr = rolling_correlations(y[np.ix_(both, cols_y)], x[np.ix_(both, cols_x)], n)
                if same:
                    corr[:, cols_y[:, None] >= cols_x[None, :]] = np.nan
                found = ~np.isnan(corr)
                total[both] += np.where(found, corr, 0.0).sum(axis=(1, 2))
                count[both] += found.sum(axis=(1, 2))
        seen = count > 0
        return pd.DataFrame({ts: dates[seen], "total": total[seen], "pairs": count[seen]})

    kind = returns.schema[ts].dataType.simpleString()
    sums = per_tile_pair(returns, work, f"{ts} {kind}, total double, pairs long", value, series, ts)
    return sums.groupBy(ts).agg((F.sum("total") / F.sum("pairs")).alias(out))
