"""Global order without a global sort in one task: ranges, positions and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialised


def in_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written, with its range as ``range_no``.

    Ranges are written before they are numbered for good: a lost executor then
    costs a re-read, and no row can change its range.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("range_no", F.spark_partition_id())
    return materialised(ranged, name)


def with_prefix_sums(ranged: DataFrame, order: list[str], amounts: dict[str, Column], by: str | None = None) -> DataFrame:
    """Add, by name, the sums of amounts over all rows before this one, in order.

    Sums restart for each value of ``by``, which leads the order. Each range is
    summed alone; what lies before it comes from the ranges' totals, of which
    there is one for each range and value of ``by`` in it.
    """
    keys = ([by] if by else []) + ["range_no"]
    before = Window.partitionBy("start_of").orderBy("start_range") if by else Window.orderBy("start_range")
    names = (["start_of"] if by else []) + ["start_range"]
    totals = ranged.groupBy(*keys).agg(*[F.sum(a).alias(f"{n}_in") for n, a in amounts.items()])
    totals = totals.toDF(*names, *[f"{n}_in" for n in amounts])
    starts = totals.select(*names, *[(F.sum(f"{n}_in").over(before) - F.col(f"{n}_in")).alias(f"{n}_start") for n in amounts])
    match = F.col("range_no") == F.col("start_range")
    if by:
        match = F.col(by).eqNullSafe(F.col("start_of")) & match
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(starts, match)
    sums = {n: F.col(f"{n}_start") + F.sum(a).over(within) - a for n, a in amounts.items()}
    return joined.withColumns(sums).drop(*names, *[f"{n}_start" for n in amounts])
