"""Order within series, without ever needing one task for one series.

Windows partitioned by series are fine for bars, whose number per series is
bounded by the calendar. For longer series (ticks, snapshots) the functions
here split a series: an exact row index is built from time slots, rows are cut
into equal blocks with a halo of neighbours, and running totals are carried
from block to block. The results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.series import SERIES, ordered, ratio, up_to_now
from tidemark.session import materialised

# An hour of even a very dense series sorts within one task; wider slots only
# save rows in the small table of slot counts.
SLOT_SECONDS = 3_600
SLOT_UNITS = 100_000
BLOCK_ROWS = 50_000


def _slot(df: DataFrame, ts: str, width: int | None) -> Column:
    """Coarse, order-preserving slot of the ordering column."""
    kind = df.schema[ts].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        seconds = F.col(ts).cast("timestamp").cast("double")
        return F.floor(seconds / (width or SLOT_SECONDS))
    return F.floor(F.col(ts) / (width or SLOT_UNITS))


def row_index(
    df: DataFrame,
    by: Sequence[str] = SERIES,
    ts: str = "ts",
    ties: Sequence[str] = (),
    slot_width: int | None = None,
    name: str = "row_idx",
    total: str | None = None,
    slots: bool = True,
) -> DataFrame:
    """Exact 0-based position of each row in its series.

    Rows are numbered inside (series, time slot) and shifted by the number of
    rows in earlier slots. Both the numbering and the join that brings the
    shift use the same (series, slot) partitioning, so the rows move once, and
    a hot series is spread over its slots. The slot counts are a map-side
    combined aggregate with one row per slot. ``total`` also returns the length
    of the series. ``slots=False`` numbers bars, whose series are short, in one
    window and one pass.
    """
    by = list(by)
    if not slots:
        numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(ts, *ties)) - 1)
        return numbered.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*by))) if total else numbered
    slotted = df.withColumn("_slot", _slot(df, ts, slot_width))
    counts = slotted.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_in_slot"))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    shift = [F.coalesce(F.sum("_in_slot").over(before), F.lit(0)).alias("_shift")]
    if total:
        shift.append(F.sum("_in_slot").over(Window.partitionBy(*by)).alias(total))
    offsets = counts.select(*by, "_slot", *shift)
    inside = Window.partitionBy(*by, "_slot").orderBy(ts, *ties)
    joined = slotted.withColumn("_pos", F.row_number().over(inside)).join(offsets, [*by, "_slot"])
    return joined.withColumn(name, F.col("_pos") - 1 + F.col("_shift")).drop("_slot", "_pos", "_shift")


def in_blocks(
    df: DataFrame,
    transform: Callable[[DataFrame, list[str]], DataFrame],
    lookback: int = 0,
    lookahead: int = 0,
    by: Sequence[str] = SERIES,
    ts: str = "ts",
    block_rows: int = BLOCK_ROWS,
    slot_width: int | None = None,
) -> DataFrame:
    """Run a bounded-frame ``transform(df, by)`` on blocks of a series.

    A row is copied to every block that needs it as a neighbour: at most
    ``lookback`` rows before and ``lookahead`` after the block. The transform
    gets the keys extended by the block, so windows that were per series become
    per block; halo rows are dropped afterwards.
    """
    by = list(by)
    b = F.lit(block_rows)
    first = F.greatest(F.lit(0), F.floor((F.col("_idx") - lookahead) / b))
    last = F.floor((F.col("_idx") + lookback) / b)
    placed = (
        row_index(df, by, ts, slot_width=slot_width, name="_idx")
        .withColumn("_block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("_core", F.floor(F.col("_idx") / b) == F.col("_block"))
        .drop("_idx")
    )
    return transform(placed, [*by, "_block"]).filter("_core").drop("_block", "_core")


_SCANS = {
    "sum": (F.sum, lambda carry, here: F.coalesce(carry, F.lit(0.0)) + here),
    "product": (F.product, lambda carry, here: F.coalesce(carry, F.lit(1.0)) * here),
    "max": (F.max, lambda carry, here: F.greatest(carry, here)),
    "min": (F.min, lambda carry, here: F.least(carry, here)),
}


def split_blocks(
    df: DataFrame, by: Sequence[str] = SERIES, ts: str = "ts", block_rows: int = BLOCK_ROWS, slot_width: int | None = None,
) -> DataFrame:
    """Number rows and cut every series in blocks of ``block_rows`` rows.

    The numbered rows are written once; scans over blocks read them several
    times. Later scans on the same frame reuse its blocks.
    """
    numbered = row_index(df, by, ts, slot_width=slot_width, name="_scan_idx")
    return materialised(numbered.withColumn("_scan_block", F.floor(F.col("_scan_idx") / block_rows)), "blocks")


def drop_blocks(df: DataFrame) -> DataFrame:
    return df.drop("_scan_idx", "_scan_block")


def cumulative(
    df: DataFrame,
    outputs: dict[str, tuple[str, Column | str]],
    by: Sequence[str] = SERIES,
    ts: str = "ts",
    block_rows: int | None = None,
    slot_width: int | None = None,
) -> DataFrame:
    """Running sum, product, max or min: ``{"equity": ("product", expr)}``.

    With ``block_rows`` the scan is done per block of a series and the totals
    of earlier blocks are carried in; the carry table has one row per block. A
    frame from ``split_blocks`` is scanned by its own blocks and keeps them.
    """
    by = list(by)
    values = {
        out: (fn, F.col(x) if isinstance(x, str) else x) for out, (fn, x) in outputs.items()
    }
    ready = "_scan_block" in df.columns
    if block_rows is None and not ready:
        running = up_to_now(by, ts)
        return df.withColumns({out: _SCANS[fn][0](x).over(running) for out, (fn, x) in values.items()})
    blocked = df if ready else split_blocks(df, by, ts, block_rows, slot_width)
    keys = [*by, "_scan_block"]
    totals = blocked.groupBy(*keys).agg(
        *[_SCANS[fn][0](x).alias(f"_end_{out}") for out, (fn, x) in values.items()]
    )
    earlier = Window.partitionBy(*by).orderBy("_scan_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys,
        *[_SCANS[fn][0](f"_end_{out}").over(earlier).alias(f"_carry_{out}") for out, (fn, _) in values.items()],
    )
    local = up_to_now(keys, ts)
    out = blocked.withColumns({f"_here_{o}": _SCANS[fn][0](x).over(local) for o, (fn, x) in values.items()})
    out = out.join(carries, keys)
    out = out.withColumns(
        {o: _SCANS[fn][1](F.col(f"_carry_{o}"), F.col(f"_here_{o}")) for o, (fn, _) in values.items()}
    )
    extra = [f"_{kind}_{o}" for o in values for kind in ("here", "carry")]
    out = out.drop(*extra)
    return out if ready else drop_blocks(out)


def drawdown(
    df: DataFrame,
    equity: str,
    out: str = "drawdown",
    by: Sequence[str] = SERIES,
    ts: str = "ts",
    block_rows: int | None = None,
) -> DataFrame:
    """Distance of an equity curve from its running maximum."""
    peaked = cumulative(df, {"_peak": ("max", equity)}, by, ts, block_rows)
    return peaked.withColumn(out, ratio(equity, "_peak") - 1).drop("_peak")


def ewm_mean(
    df: DataFrame,
    col: str,
    out: str,
    span: float | None = None,
    alpha: float | None = None,
    adjust: bool = True,
    min_periods: int = 0,
    by: Sequence[str] = SERIES,
    ts: str = "ts",
) -> DataFrame:
    """Exponentially weighted mean, started at the first non-null value.

    The weights ``(1-a)^-j`` are kept finite by restarting ``j`` every
    ``step`` rows; ``step`` is chosen so that ``(1-a)^step`` is below double
    precision, hence only the end of the previous step has to be carried. A null
    repeats the mean so far and ages it by a row. For a hot series call it
    inside ``in_blocks`` with ``lookback=ewm_memory(alpha)``.
    """
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    if not adjust:
        return _recursive_mean(df, col, out, a, min_periods, list(by), ts)
    keep = 1.0 - a
    step = ewm_memory(a)
    by = list(by)
    running = up_to_now(by, ts)
    x = F.col(col)
    df = df.withColumn("_seen", F.count(x).over(running)).withColumn(
        "_age", F.sum(F.when(F.col("_seen") > 0, 1).otherwise(0)).over(running) - 1
    )
    df = df.withColumn("_step", F.floor(F.col("_age") / step)).withColumn("_j", F.col("_age") % step)
    grow = F.pow(F.lit(keep), -F.col("_j"))
    weight = F.when(x.isNotNull(), grow)
    inside = up_to_now([*by, "_step"], ts)
    fade = F.pow(F.lit(keep), F.col("_j"))
    df = df.withColumns(
        {
            "_num": F.coalesce(F.sum(x * weight).over(inside), F.lit(0.0)) * fade,
            "_den": F.coalesce(F.sum(weight).over(inside), F.lit(0.0)) * fade,
        }
    )
    past = ordered(by, ts).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("_j") == step - 1, F.struct("_num", "_den"))
    df = df.withColumn("_prev", F.last(ends, ignorenulls=True).over(past))
    carried = F.pow(F.lit(keep), F.col("_j") + 1)
    num = F.col("_num") + F.coalesce(F.col("_prev._num"), F.lit(0.0)) * carried
    den = F.col("_den") + F.coalesce(F.col("_prev._den"), F.lit(0.0)) * carried
    value = F.last(F.when(x.isNotNull(), ratio(num, den)), ignorenulls=True).over(running)
    enough = (F.col("_seen") > 0) & (F.col("_seen") >= min_periods)
    return df.withColumn(out, F.when(enough, value)).drop(
        "_seen", "_age", "_step", "_j", "_num", "_den", "_prev"
    )


def _recursive_mean(df: DataFrame, col: str, out: str, a: float, min_periods: int, by: list[str], ts: str) -> DataFrame:
    """Mean that moves towards each value by a share of the way.

    The share is ``a`` after a value in the row before. Over a gap of g rows the
    old mean has faded to ``(1-a)^g`` against a weight of ``a`` for the value, so
    it keeps ``(1-a)^g / ((1-a)^g + a)``. Fading is summed as a logarithm and
    restarted whenever it has come to double precision.
    """
    x, running, order = F.col(col), up_to_now(by, ts), ordered(by, ts)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_row", F.row_number().over(order)).withColumn("_seen", F.count(x).over(running))
    df = df.withColumn("_gap", F.col("_row") - F.last(F.when(x.isNotNull(), F.col("_row")), ignorenulls=True).over(past))
    old = F.pow(F.lit(1.0 - a), F.col("_gap"))
    held = F.when(x.isNotNull() & F.col("_gap").isNotNull(), old / (old + a))
    df = df.withColumn("_fade", F.when(held.isNull(), 0.0).when(held == 0, 60.0).otherwise(F.least(-F.log(held), F.lit(60.0))))
    df = df.withColumn("_move", F.when(x.isNotNull(), F.when(F.col("_seen") == 1, 1.0).otherwise(1.0 - F.exp(-F.col("_fade")))))
    df = df.withColumn("_step", F.floor(F.sum("_fade").over(running) / 45.0))
    inside = up_to_now([*by, "_step"], ts)
    df = df.withColumn("_faded", F.sum("_fade").over(inside))
    df = df.withColumn("_own", F.coalesce(F.sum(x * F.col("_move") * F.exp(F.col("_faded"))).over(inside), F.lit(0.0)) * F.exp(-F.col("_faded")))
    ends = F.when(F.lead("_step").over(order) > F.col("_step"), F.col("_own"))
    df = df.withColumn("_end", ends).withColumn("_prev", F.coalesce(F.last("_end", ignorenulls=True).over(past), F.lit(0.0)))
    value = F.col("_own") + F.col("_prev") * F.exp(-F.col("_faded"))
    enough = (F.col("_seen") > 0) & (F.col("_seen") >= min_periods)
    return df.withColumn(out, F.when(enough, value)).drop("_row", "_seen", "_gap", "_fade", "_move", "_step", "_faded", "_own", "_end", "_prev")


def ewm_memory(alpha: float) -> int:
    """Rows after which a value's weight is below double precision."""
    import math

    return int(math.ceil(45.0 / -math.log1p(-alpha)))


def hysteresis(
    df: DataFrame,
    z: str,
    entry: float = 2.0,
    exit: float = 0.5,
    out: str = "position",
    by: Sequence[str] = SERIES,
    ts: str = "ts",
    block_rows: int | None = None,
) -> DataFrame:
    """Band position: enter against ``z`` beyond ``entry``, leave inside ``exit``.

    Exits cut a series into islands; inside an island the first entry sets the
    position until the next exit, which is the band machine without a loop.
    A row without ``z`` holds 0 but does not end the island. With
    ``block_rows`` the islands are cut per block and an open position is
    carried over block borders.
    """
    if not exit < entry:
        raise ValueError("exit must be below entry")
    by = list(by)
    zc = F.col(z)
    leaves = F.coalesce((F.abs(zc) < exit).cast("int"), F.lit(0))
    side = F.when(zc > entry, -1).when(zc < -entry, 1)
    if block_rows is None:
        keys, marked = by, df
    else:
        keys = [*by, "_scan_block"]
        marked = split_blocks(df, by, ts, block_rows)
    marked = marked.withColumn("_island", F.sum(leaves).over(up_to_now(keys, ts))).withColumn("_side", side)
    local = F.first("_side", ignorenulls=True).over(up_to_now([*keys, "_island"], ts))
    marked = marked.withColumn("_open", local)
    if block_rows is not None:
        ends = marked.groupBy(*keys).agg(
            F.max("_island").alias("_exits"), F.max_by("_open", F.col(ts)).alias("_last")
        )
        # Blocks after one with an exit start a new island of blocks; inside it
        # the first open position found is the one still held.
        ends = ends.withColumn(
            "_group", F.sum((F.col("_exits") > 0).cast("int")).over(up_to_now(by, "_scan_block"))
        ).withColumn("_held", F.first("_last", ignorenulls=True).over(up_to_now([*by, "_group"], "_scan_block")))
        carry = ends.select(*keys, F.lag("_held").over(ordered(by, "_scan_block")).alias("_carry"))
        marked = marked.join(carry, keys).withColumn(
            "_open", F.when(F.col("_island") == 0, F.coalesce("_carry", "_open")).otherwise(F.col("_open"))
        )
    held = F.when(zc.isNull(), 0).otherwise(F.coalesce("_open", F.lit(0)))
    return drop_blocks(marked.withColumn(out, held.cast("int")).drop("_island", "_side", "_open", "_carry"))


def runs(df: DataFrame, col: str, by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Contiguous stretches of equal values: run number, first and last time, length."""
    by = list(by)
    changed = F.coalesce((F.col(col) != F.lag(col).over(ordered(by, ts))).cast("int"), F.lit(0))
    marked = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(up_to_now(by, ts)))
    return marked.groupBy(*by, "run", col).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n_rows")
    )


def sequences(
    df: DataFrame, cols: Sequence[str], n: int = 24, out: str = "sequence",
    by: Sequence[str] = SERIES, ts: str = "ts",
) -> DataFrame:
    """Trailing windows of ``n`` feature rows as nested arrays; shorter ones are left out."""
    frame = ordered(by, ts).rowsBetween(-(n - 1), 0)
    packed = F.collect_list(F.array(*cols)).over(frame)
    return df.withColumn(out, packed).filter(F.size(out) == n)


def window_drawdown(ret: Column, n: int, by: Sequence[str] = SERIES, ts: str = "ts") -> Column:
    """Deepest drawdown of the equity curve restarted inside each trailing window."""
    frame = ordered(by, ts).rowsBetween(-(n - 1), 0)
    start = F.struct(F.lit(1.0).alias("level"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, r: Column) -> Column:
        level = s["level"] * (1 + r)
        peak = F.greatest(s["peak"], level)
        return F.struct(
            level.alias("level"), peak.alias("peak"), F.least(s["worst"], ratio(level, peak) - 1).alias("worst")
        )

    worst = F.aggregate(F.collect_list(ret).over(frame), start, step, lambda s: s["worst"])
    return F.when(F.count(ret).over(frame) >= n, worst)


def tail(df: DataFrame, n: int, by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Last ``n`` rows of every series."""
    newest = Window.partitionBy(*by).orderBy(F.col(ts).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def every_kth(df: DataFrame, k: int, by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    return row_index(df, by, ts, name="_idx").filter(F.col("_idx") % k == 0).drop("_idx")


def evenly_spaced(df: DataFrame, n: int, by: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """At most ``n`` rows per series, at rounded-down even steps from first to last."""
    by = list(by)
    numbered = row_index(df, by, ts, name="_idx", total="_len")
    if n < 2:
        return numbered.filter(F.col("_idx") == 0).drop("_idx", "_len")
    # Row i is picked when some step j has floor(j*(len-1)/(m-1)) == i.
    m = F.least(F.lit(n), F.col("_len"))
    j = F.ceil(F.col("_idx") * (m - 1) / F.greatest(F.col("_len") - 1, F.lit(1)))
    hit = F.floor(j * (F.col("_len") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("_idx")
    return numbered.filter(hit).drop("_idx", "_len")


def top_k(df: DataFrame, col: str, k: int, ascending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows by ``col``; Spark keeps k rows per task and merges them."""
    key = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return df.orderBy(key, *ties).limit(k)


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows: those with the smallest key hashes, MD5 so that any engine can draw them."""
    return df.orderBy(key_digest(keys, seed), *keys).limit(n)


def key_digest(keys: Sequence[str], seed: int) -> Column:
    """MD5 of the seed and a row's keys as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
