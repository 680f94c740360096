"""Exact quantiles and exact orderings that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach_row
from tidemark.session import checkpointed, materialised

#: Quantiles (groups times columns times probabilities) up to which their brackets are sent to all tasks.
FEW_TARGETS = 100_000


#: Size of the sketches; a rank read from one is off by about 0.13 percent of the rows.
SKETCH = 4096
#: How far around its rank a quantile is looked for, by the number of values from which that is enough.
MARGINS = ((4000, 0.004), (400, 0.03), (40, 0.25), (0, 1.0))


def quantile_table(df: DataFrame, wanted: dict[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, prob, value): exact linearly interpolated quantiles of several columns, per group or over all rows.

    Mergeable sketches give each quantile a bracket. One more pass counts the
    values below it and keeps, counted, those inside, less than a percent of the
    rows; they are ranked along range partitions. Should a bracket miss, which
    the counts tell, all of them are widened. Nulls do not count; infinite values
    are values; NaN is the greatest, as in Spark's order. A column without values
    has null quantiles; an empty table has none unless it has no groups.
    """
    by = list(by)
    keys = [f"_by{i}" for i in range(len(by))]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in wanted])
    long = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.explode(pairs).alias("_p")).select(*keys, "_p.column", "_p.v")
    number = F.col("v").isNotNull() & ~F.isnan("v")
    sketches = long.groupBy(*keys, "column").agg(
        F.count(F.when(number, 1)).alias("n"), F.count(F.when(F.isnan("v"), 1)).alias("n_nan"), F.kll_sketch_agg_double(F.when(number, F.col("v")), SKETCH).alias("sketch")
    )
    sketches = materialised(sketches, "sketches")
    for level in range(len(MARGINS)):
        targets = materialised(_brackets(sketches, wanted, level), "brackets")
        found = _inside(long, targets, keys)
        missed = found.filter("below > low_rank OR high_rank >= below + inside").limit(1).count()
        if not missed:
            break
    out = found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "column", "prob", "value")
    return out


def _brackets(sketches: DataFrame, wanted: dict[str, Sequence[float]], level: int) -> DataFrame:
    """Ranks that each quantile lies between, and the values that should hold them."""
    targets = []
    for column, probs in wanted.items():
        for p in sorted(set(probs)):
            low, high = F.lit(float("-inf")), F.lit(float("inf"))
            for least, margin in reversed(MARGINS[level:-1]):
                enough = F.col("n") >= least
                if p - margin > 0:
                    low = F.when(enough, F.kll_sketch_get_quantile_double("sketch", F.lit(p - margin))).otherwise(low)
                if p + margin < 1:
                    high = F.when(enough, F.kll_sketch_get_quantile_double("sketch", F.lit(p + margin))).otherwise(high)
            targets.append(F.struct(F.lit(column).alias("c"), F.lit(float(p)).alias("prob"), low.alias("low"), high.alias("high")))
    rows = sketches.withColumn("_t", F.explode(F.filter(F.array(*targets), lambda t: t["c"] == F.col("column"))))
    last = F.col("n") + F.col("n_nan") - 1
    at = F.col("_t.prob") * last
    low_rank = F.floor(at)
    return rows.select(
        *[c for c in sketches.columns if c.startswith("_by")], "column", "n", "n_nan", F.col("_t.prob").alias("prob"), F.col("_t.low").alias("low"), F.col("_t.high").alias("high"),
        at.alias("at"), F.greatest(low_rank, F.lit(0)).alias("low_rank"), F.greatest(F.least(low_rank + 1, last), F.lit(0)).alias("high_rank"),
    )


def _inside(long: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with the counts of values below and inside their brackets, and the value found."""
    few = targets.filter("n > 0")
    spans = few.select(*[F.col(k).alias(f"t{k}") for k in keys], F.col("column").alias("t_column"), "prob", "low", "high")
    send = F.broadcast if targets.count() <= FEW_TARGETS else (lambda side: side)
    spans = send(spans)
    same = F.col("column") == F.col("t_column")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"t{k}"))
    met = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).join(spans, same & (F.col("v") <= F.col("high")))
    held = met.select(*keys, "column", "prob", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v"))
    held = materialised(held.groupBy(*keys, "column", "prob", "v").agg(F.count(F.lit(1)).alias("n_equal")), "bracketed")
    order = F.struct(*keys, "column", "prob", "v").alias("at")
    ranked = ordered_totals(held.filter("v IS NOT NULL").select(order, "n_equal"), "at", {"n": F.sum("n_equal")}, descending=False)
    ranked = ranked.select("at.*", "n", "cum_n")
    group = [*keys, "column", "prob"]
    sizes = held.groupBy(*group).agg(
        F.sum(F.when(F.col("v").isNull(), F.col("n_equal")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v").isNotNull(), F.col("n_equal")).otherwise(0)).alias("inside")
    )
    first = ranked.groupBy(*group).agg(F.min(F.col("cum_n") - F.col("n")).alias("base"))
    null_safe = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group])
    placed = targets.alias("t").join(sizes.alias("s"), null_safe("t", "s"), "left").join(first.alias("f"), null_safe("t", "f"), "left")
    placed = placed.select("t.*", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("inside", F.lit(0)).alias("inside"), (F.col("base") - F.coalesce("below", F.lit(0))).alias("base"))
    covers = lambda rank: (rank < F.col("r.cum_n")) & (rank >= F.col("r.cum_n") - F.col("r.n"))
    low, high = F.col("p.base") + F.col("p.low_rank"), F.col("p.base") + F.col("p.high_rank")
    ends = ranked.alias("r").join(send(placed).alias("p"), null_safe("p", "r") & (covers(low) | covers(high)))
    ends = ends.groupBy(*[F.col(f"p.{c}").alias(c) for c in group]).agg(F.max(F.when(covers(low), F.col("r.v"))).alias("a"), F.max(F.when(covers(high), F.col("r.v"))).alias("b"))
    hits = placed.alias("p").join(ends.alias("e"), null_safe("p", "e"), "left").select("p.*", "a", "b")
    nan, n = F.lit(float("nan")), F.col("n")
    a = F.when(F.col("low_rank") >= n, nan).otherwise(F.col("a"))
    b = F.when(F.col("high_rank") >= n, nan).otherwise(F.col("b"))
    value = F.when((a == b) | (F.col("at") == F.col("low_rank")), a).otherwise(a + (F.col("at") - F.col("low_rank")) * (b - a))
    # Ranks of NaN are not looked for.
    rank = lambda c: F.least(F.col(c), F.greatest(n - 1, F.lit(0))).alias(c)
    return hits.select(*group, F.when(n + F.col("n_nan") > 0, value).alias("value"), "below", F.when(n > 0, F.col("inside")).otherwise(1).alias("inside"), rank("low_rank"), rank("high_rank"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """``quantile_table`` of one column over all rows, as plain numbers like ``approxQuantile``; none for an empty table."""
    found = {r["prob"]: r["value"] for r in quantile_table(df, {col: probs}).collect()}
    return [found.get(float(p)) for p in probs]


def score_threshold(df: DataFrame, score: str, budget: float) -> float:
    """Threshold that flags the top ``budget`` share of rows."""
    return exact_quantiles(df, score, [1.0 - budget])[0]


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width counts from minimum to maximum; the last bin is closed."""
    ends = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    binned = attach_row(df.filter(F.col(col).isNotNull()), ends).withColumn("bin", slot.cast("long"))
    counted = binned.groupBy("bin", "_lo", width.alias("_width")).agg(F.count(F.lit(1)).alias("n_rows"))
    left = F.col("_lo") + F.col("bin") * F.col("_width")
    return counted.select("bin", left.alias("left_edge"), (left + F.col("_width")).alias("right_edge"), "n_rows")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per column, quartiles of all columns together."""
    found = {(r["column"], r["prob"]): r["value"] for r in quantile_table(df, {c: [0.25, 0.5, 0.75] for c in cols}).collect()}
    measures = []
    for c in cols:
        q = [F.lit(found.get((c, p))).cast("double") for p in (0.25, 0.5, 0.75)]
        measures.append(
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"),
                F.max(c).cast("double").alias("max"),
            )
        )
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def ordered_totals(df: DataFrame, value: str, totals: dict[str, Column], descending: bool = True) -> DataFrame:
    """Running totals over all rows in the order of ``value``, ties taken together.

    Rows with equal values are summed first. The distinct values are then range
    partitioned and written to a checkpoint with their partition number, so
    that each partition's totals and the rows see the same partitions; the
    carry table has one row per partition.
    """
    collapsed = df.groupBy(value).agg(*[x.alias(n) for n, x in totals.items()])
    key = F.col(value).desc() if descending else F.col(value).asc()
    parts = checkpointed(
        collapsed.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    )
    ends = parts.groupBy("_part").agg(*[F.sum(n).alias(f"_end_{n}") for n in totals])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    carry = ends.select(
        "_part",
        *[F.coalesce(F.sum(f"_end_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in totals],
        *[F.sum(f"_end_{n}").over(everything).alias(f"all_{n}") for n in totals],
    )
    local = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({f"_here_{n}": F.sum(n).over(local) for n in totals}).join(carry, "_part")
    return out.select(
        value, *totals,
        *[(F.col(f"_carry_{n}") + F.col(f"_here_{n}")).alias(f"cum_{n}") for n in totals],
        *[f"all_{n}" for n in totals],
    )
