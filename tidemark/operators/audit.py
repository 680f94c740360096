"""Look-ahead audit: does cutting off the future change the past?"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def audit_lookahead(
    transform: Callable[[DataFrame], DataFrame], df: DataFrame, cutoff, keys: Sequence[str] = ("series_id", "ts"), ts: str = "ts",
    cols: Sequence[str] | None = None, tol: float = 1e-9,
) -> DataFrame:
    """Rows up to ``cutoff`` whose values change when later input is removed.

    The transform runs on the full and on the truncated input; both results are
    matched by key. An empty result means that no value at or before the cutoff
    used later rows. Only rows that differ come back.
    """
    keys = list(keys)
    limit = cutoff if not isinstance(cutoff, (int, float, str)) else F.lit(cutoff)
    full = transform(df).filter(F.col(ts) <= limit)
    cut = transform(df.filter(F.col(ts) <= limit))
    names = list(cols) if cols is not None else [c for c in full.columns if c not in keys]
    left = full.select(*keys, *[F.col(c).alias(f"{c}_full") for c in names])
    right = cut.select(*keys, *[F.col(c).alias(f"{c}_cut") for c in names])
    same = F.lit(True)
    for c in names:
        a, b = F.col(f"{c}_full"), F.col(f"{c}_cut")
        if isinstance(full.schema[c].dataType, (T.DoubleType, T.FloatType)):
            scale = F.greatest(F.lit(1.0), F.abs(a))
            near = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tol * scale, F.lit(False))
        else:
            near = a.eqNullSafe(b)
        same = same & near
    marked = left.withColumn("_in_full", F.lit(True)).join(right.withColumn("_in_cut", F.lit(True)), keys, "full_outer")
    both = F.col("_in_full").isNotNull() & F.col("_in_cut").isNotNull()
    return marked.filter(~(both & same)).drop("_in_full", "_in_cut")
