"""Audit of how quality filters interact: what each removes, alone and after others.

A filter's flags are bits of a mask. How many documents carry which mask is an
additive count, from which every order of the filters, what a filter removes in
it, and its Shapley value follow without looking at a document again.

The filter on repeated texts needs other rows. A counting Bloom sketch over text
hashes, built in slices by the tasks and merged with saturating counters, clears
the texts that are certainly unique. Only the others meet, by their full text.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialised

#: Cells of a slice of the sketch: an offset has 16 bits.
SLICE_CELLS = 1 << 16
#: Cells that a text falls into, all of one slice.
HASHES = 3
#: Cells for every row; rounded up to a power of two.
CELLS_A_ROW = 8
#: Cells of the largest sketch (one bit each where it is looked up: 128 MB). With
#: more rows than that serves, fewer unique texts are cleared; the result is the same.
MOST_CELLS = 1 << 30
#: Hashes that a task counts at once.
ROWS_AT_ONCE = 1 << 19


def quality_checks() -> dict[str, Column]:
    """When a text fails: few words, few different words, capitals, symbols.

    The expressions read ``text`` (never null) and ``words``, its words.
    """
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * capitals > 3 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def _cells(hashes: np.ndarray, slices: int) -> np.ndarray:
    """Cell numbers, one row for each hash: the slice from its high bits, offsets from the others."""
    h = hashes.view(np.uint64)
    start = (h >> np.uint64(48)) & np.uint64(slices - 1)
    return np.stack([(start << np.uint64(16)) | ((h >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(HASHES)], axis=1).astype(np.int64)


def _partial_sketch(slices: int):
    """Counters of a task's rows, as offsets of the cells met once and more than once."""

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(_cells(np.concatenate(parts), slices).ravel(), return_counts=True)
        starts = np.flatnonzero(np.diff(cells >> 16, prepend=-1))
        rows = []
        for a, b in itertools.pairwise([*starts, len(cells)]):
            low, often = (cells[a:b] & 0xFFFF).astype(np.uint16), counts[a:b] > 1
            rows.append((int(cells[a] >> 16), low[~often].tobytes(), low[often].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["slice", "once", "often"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield emit(parts)
                parts, n = [], 0
        if n:
            yield emit(parts)

    return sketch


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of whole slices from partial ones that come sorted; cells of at least two stay, as bits."""

    def done(slice_no: int, counters: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slice_no], pa.int64()), pa.array([np.packbits(counters > 1).tobytes()], pa.binary())], ["slice", "bits"])

    now, counters = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["slice"] != now:
                if now is not None:
                    yield done(now, counters)
                now, counters = row["slice"], np.zeros(SLICE_CELLS, dtype=np.uint8)
            once = np.frombuffer(row["once"], dtype=np.uint16)
            counters[once] = np.minimum(counters[once] + 1, 2)
            counters[np.frombuffer(row["often"], dtype=np.uint16)] = 2
    if now is not None:
        yield done(now, counters)


def repeat_sketch(hashes: DataFrame, rows: int) -> tuple[int, Broadcast]:
    """(slices, bits of the cells that at least two rows fell into) of one column of 64-bit hashes."""
    spark = hashes.sparkSession
    wanted = max(1, math.ceil(min(rows * CELLS_A_ROW, MOST_CELLS) / SLICE_CELLS))
    slices = 1 << (wanted - 1).bit_length()
    partial = hashes.mapInArrow(_partial_sketch(slices), "slice long, once binary, often binary")
    merged = partial.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice long, bits binary")
    bits = np.zeros(slices * SLICE_CELLS // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():
        bits[row["slice"] * SLICE_CELLS // 8 : (row["slice"] + 1) * SLICE_CELLS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return slices, spark.sparkContext.broadcast(bits)


def _clear_unique(slices: int, bits: Broadcast):
    """Null texts whose cells another row did not fall into."""

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _cells(batch.column("hash").to_numpy(zero_copy_only=False), slices)
            unique = ~((table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1)
            text = pc.if_else(pa.array(unique), pa.scalar(None, batch.column("text").type), batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("mask"), text], ["doc_id", "part", "mask", "text"])

    return clear


def failure_masks(docs: DataFrame, checks: dict[str, Column], part: str = "lang", repeats: bool = True) -> DataFrame:
    """(doc_id, part, mask): bit i is set if check i fails, the next one if a smaller doc_id has the same text.

    A null text is empty, a null part the empty string. A row without a doc_id
    repeats nothing and is repeated by nothing; rows of one doc_id with one text
    do not repeat each other. Very long texts are held one at a time, other
    columns of any name are left out, an empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = rows.select(F.xxhash64("text").alias("hash"))
    words = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks.values())), F.lit(0)).cast("int")
    if not repeats:
        return words.select("doc_id", "part", mask.alias("mask"))
    slices, bits = repeat_sketch(hashed, docs.count())
    flagged = words.select("doc_id", "part", mask.alias("mask"), "text", F.xxhash64("text").alias("hash"))
    kind = flagged.schema["doc_id"].dataType.simpleString()
    flagged = materialised(flagged.mapInArrow(_clear_unique(slices, bits), f"doc_id {kind}, part string, mask int, text string"), "flags")
    key = F.sha2("text", 256)
    firsts = flagged.filter("text IS NOT NULL AND doc_id IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select("doc_id", key.alias("key"), F.lit(True).alias("first"))
    clear = flagged.filter("text IS NULL OR doc_id IS NULL").select("doc_id", "part", "mask")
    others = flagged.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "part", "mask", key.alias("key"))
    others = others.join(firsts, ["doc_id", "key"], "left")
    return clear.unionByName(others.select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << len(checks))).alias("mask")))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled of good quality or toxic.

    A document without a label, or with a null one, is neither; with several
    rows of labels it is what any of them says.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    none = F.lit(None).cast("int")
    joined = masks.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").select("part", "mask", "good", "toxic")
    joined = joined.unionByName(masks.filter("doc_id IS NULL").select("part", "mask", none.alias("good"), none.alias("toxic")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of masks."""
    steps = []
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(letters[j] for j in order), "step": step, "own": 1 << i, "before": before})
            before |= 1 << i
    kind = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(F.from_json(F.lit(json.dumps(steps)), kind)).alias("s")).select("part", "cells", "s.*")
    own, before = F.col("own"), F.col("before")

    def total(test, what="n"):
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(c["mask"]), c[what] if isinstance(what, str) else what(c)).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    orders = F.lit(math.factorial(len(letters)))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), total(here).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"), total(lambda m: m == own).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (orders / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, checks: dict[str, Column] | None = None, repeats: str | None = "E", part: str = "lang") -> DataFrame:
    """What each filter keeps, removes, repeats and alone catches, in every order, for each part.

    ``checks`` names failure conditions by one letter; ``repeats`` is the letter of
    the filter on texts that a smaller doc_id has too, table-wide. All orders of n
    filters are n! rows of n steps for each part: meant for up to six filters.
    ``shapley`` sums what the step's filter removes over all orders. Nulls, empty
    texts, ties, repeated rows and empty tables: see ``failure_masks`` and
    ``mask_counts``; a part without documents has no rows.
    """
    checks = quality_checks() if checks is None else checks
    masks = failure_masks(docs, checks, part, repeats is not None)
    counts = materialised(mask_counts(masks, labels), "mask_counts")
    return interactions(counts, "".join(checks) + (repeats or ""))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step::INT AS step,
    coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step"""
