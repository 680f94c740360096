"""Windowed column expressions over ordered series.

``by`` lists the partition keys and ``ts`` the ordering column. All rolling
statistics are null until the frame holds ``min_samples`` non-null values
(default: a full frame); Spark alone would emit partial frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("series_id",)
TINY = 1e-12


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``, null when ``b`` is 0 (Spark would raise an error)."""
    return _col(a) / F.nullif(_col(b), F.lit(0.0))


def ordered(by: Sequence[str] = SERIES, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(ts)


def trailing(n: int, by: Sequence[str] = SERIES, ts: str = "ts") -> WindowSpec:
    return ordered(by, ts).rowsBetween(-(n - 1), 0)


def up_to_now(by: Sequence[str] = SERIES, ts: str = "ts") -> WindowSpec:
    return ordered(by, ts).rowsBetween(Window.unboundedPreceding, 0)


def log_return(x: Column | str, k: int = 1, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    x = _col(x)
    return F.log(x) - F.log(F.lag(x, k).over(ordered(by, ts)))


def simple_return(x: Column | str, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    x = _col(x)
    return ratio(x, F.lag(x, 1).over(ordered(by, ts))) - 1


def forward_return(x: Column | str, h: int = 1, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    x = _col(x)
    return F.log(F.lead(x, h).over(ordered(by, ts))) - F.log(x)


_ROLLING = {
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
}


def rolling(
    x: Column | str,
    fn: str,
    n: int,
    min_samples: int | None = None,
    by: Sequence[str] = SERIES,
    ts: str = "ts",
) -> Column:
    x = _col(x)
    frame = trailing(n, by, ts)
    needed = n if min_samples is None else min_samples
    return F.when(F.count(x).over(frame) >= needed, _ROLLING[fn](x).over(frame))


def rolling_corr(
    x: Column | str, y: Column | str, n: int, by: Sequence[str] = SERIES, ts: str = "ts"
) -> Column:
    x, y = _col(x), _col(y)
    frame = trailing(n, by, ts)
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    return F.when(F.count(both).over(frame) >= n, F.corr(x, y).over(frame))


def rolling_zscore(x: Column | str, n: int = 30, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    x = _col(x)
    std = rolling(x, "std", n, by=by, ts=ts)
    return ratio(x - rolling(x, "mean", n, by=by, ts=ts), std)


def sma_ratio(x: Column | str, n: int, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    x = _col(x)
    return ratio(x, rolling(x, "mean", n, by=by, ts=ts)) - 1


def volume_zscore(x: Column | str, n: int = 20, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    x = _col(x)
    return (x - rolling(x, "mean", n, by=by, ts=ts)) / (rolling(x, "std", n, by=by, ts=ts) + TINY)


def gain(x: Column | str) -> Column:
    x = _col(x)
    return F.when(x > 0, x).otherwise(0.0)


def loss(x: Column | str) -> Column:
    x = _col(x)
    return F.when(x < 0, -x).otherwise(0.0)


def rsi_sma(ret: Column | str, n: int = 14, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    """Relative strength on plain rolling means of gains and losses."""
    up = rolling(gain(ret), "mean", n, by=by, ts=ts)
    down = rolling(loss(ret), "mean", n, by=by, ts=ts)
    return 100 - 100 / (1 + up / (down + TINY))


def streak(ret: Column | str, n: int = 5, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    """Sum of the signs of the last ``n`` returns; a missing return counts as 0."""
    return rolling(F.coalesce(F.signum(_col(ret)), F.lit(0.0)), "sum", n, by=by, ts=ts)


def turnover(position: Column | str, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    """Absolute position change; the first row pays for its own position."""
    position = _col(position)
    return F.abs(position - F.lag(position, 1, 0).over(ordered(by, ts)))


def rebase(x: Column | str, base: float = 100.0, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    x = _col(x)
    return ratio(F.lit(base) * x, F.first(x).over(up_to_now(by, ts)))
