"""Mixing sources to target weights.

Every document gets a hash-random key and is range-sorted by source and key.
Distributed prefix sums of word counts place it in its source's order; the mix
goes through that order, repeating it as epochs, and is cut at the source's exact
budget. Only ids, sources and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import with_small
from tidemark.llm.ordered import in_ranges, with_prefix_sums
from tidemark.session import materialised

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target) from the columns source and size.

    Sources in code point order, null last, have the given weights in turn. They
    share ``share`` times all sizes; a target stops at ``epochs`` times its
    source's size, and the excess is shared out again by weight. That is one
    water level: sources fill up in the order of their limit by weight, and the
    level is the first at which the next source stays below its limit. Works on
    one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("cap", float(epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = float(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``.

    ``size`` counts words, 0 for a null text; a null source is a source. The
    order within a source is by md5 of the seed and doc_id, then doc_id (null
    first), then size. ``taken`` counts the words that the mix takes of the row: as often
    its whole size as its source's budget, the rounded target, holds whole
    epochs, and its part of the rest, which ends inside one document. Repeated
    rows are rows of their own. Extra columns are left out; an empty table gives
    an empty result.
    """
    return _taken(docs, weights, share, epochs, seed)


def _taken(docs: DataFrame, weights: tuple, share: float, epochs: int, seed: str, *carry: str) -> DataFrame:
    """What ``mix`` gives, with the columns ``carry``, which part ties."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), *carry)
    rows = rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    order = ["source", "draw", "doc_id", "size", *carry]
    ranged = in_ranges(rows, order, "mix")
    targets = materialised(source_targets(ranged, weights, share, epochs), "targets").withColumnRenamed("source", "target_of")
    placed = with_prefix_sums(ranged, order, {"before": F.col("size")}, by="source")
    marked = placed.join(targets, F.col("source").eqNullSafe(F.col("target_of")))
    budget = F.least(F.floor(F.col("target") + 0.5), epochs * F.col("source_size"))
    rest = budget - F.floor(budget / F.greatest("source_size", F.lit(1))) * F.col("source_size")
    times = F.floor(budget / F.greatest("source_size", F.lit(1)))
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return marked.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size") + part).cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix as rows of ``docs``: each as often as the mix takes its words.

    A row that the cut runs through is in if at least half of it is. Rows
    without words stay once: they cost nothing. Every row is taken for itself,
    whatever other rows have its doc_id, or none.
    """
    names = docs.columns
    row, copies, turn = (f"mix_{c}_{len(names)}" for c in ("row", "copies", "turn"))
    # Written, so that a row keeps its number for good.
    docs = materialised(docs.withColumn(row, F.monotonically_increasing_id()), "mix_rows")
    taken = _taken(docs, weights, share, epochs, seed, row)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    taken = materialised(taken.select(row, times.alias(copies)).filter(F.col(copies) > 0), "copies")
    out = with_small(docs, taken, [row], "inner").withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*[F.col(f"`{c}`") for c in names])
