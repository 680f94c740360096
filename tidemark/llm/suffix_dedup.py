"""Substring dedup on bytes by two-stage suffix sorting.

Each window of ``window`` bytes picks its least-hashed gram; windows that pick
the same gram occurrence form one segment. Equal windows pick equal grams, so
only segments that share a gram can hold a repeat. Segments with equal bytes
are settled by counting. The different ones of a gram are suffix-sorted
together: suffixes smaller than their successors are sorted directly, all others
are induced by scanning the buckets of first symbols, and common prefixes of
neighbours in the suffix array show the repeated windows.

A gram with very many different segments (a template, a passage at the start of
a million texts) is split: its segments are cut again by the least gram under
another hash, equal parts are settled by counting, and parts that are still too
many go on to the next hash. After a few of these, what is left are parts of a
few windows, which are counted by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import U64, Powers, random_values, scramble, signed, text_slices
from tidemark.llm.frames import with_small
from tidemark.session import materialised

GRAM = 40
#: Text bytes whose windows are hashed at once (or one longer text): arrays of eight bytes for each stay in the cache.
SLICE = 1 << 17
#: Different segments of one gram that are suffix-sorted in one task.
SORTED_SEGMENTS = 256
SORT_BYTES = 1 << 20
#: How often segments of too frequent grams are cut again.
CUTS = 4
#: Window starts looked at together in a very long text.
PIECE = 1 << 21


def _values(data: np.ndarray, seed: int = 41) -> np.ndarray:
    return random_values(256, seed)[data]


def segments(data: np.ndarray, offsets: np.ndarray, window: int, powers: Powers, seed: int = 0):
    """Segments of all windows: (gram hash, segment hash, first byte, windows, text).

    Another ``seed`` ranks grams in another order.
    """
    gram = min(GRAM, window)
    parts = []
    for piece in range(0, max(1, len(data) - window + 1), PIECE):
        a, b = piece, min(len(data), piece + PIECE + window - 1)
        n = b - a
        if n < window:
            break
        sums = powers.sums(_values(data[a:b]))
        starts = np.arange(n - gram + 1)
        hashes = powers.raw(sums, slice(0, n - gram + 1), slice(gram, n + 1))
        hashes ^= hashes >> U64(31)
        hashes *= U64(0x9FB21C651E98DF25)
        if seed:
            hashes = scramble(hashes ^ U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        low = (hashes & ~U64((1 << 22) - 1)) | starts.astype(U64)
        width, reach = window - gram + 1, 1
        while 2 * reach <= width:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        text = np.searchsorted(offsets, np.arange(a, a + len(low)), "right") - 1
        at = np.flatnonzero(offsets[text + 1] - np.arange(a, a + len(low)) >= window)
        if not len(at):
            continue
        picked = (low[at] & U64((1 << 22) - 1)).astype(np.int64)
        owner = text[at]
        head = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
        wins = np.diff(np.concatenate([head, [len(at)]]))
        first, chosen = at[head], picked[head]
        whole = powers.spans(sums, first, first + wins - 1 + window)
        whole = scramble(whole ^ scramble((chosen - first).astype(U64) + U64(1)))
        parts.append((hashes[chosen], whole, first + a, wins, owner[head]))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none.astype(U64), none, none, none
    return tuple(np.concatenate(column) for column in zip(*parts))


def _segments(window: int):
    """Map: texts to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            anchor, whole, first, wins, owner = segments(data, offsets, window, powers)
            if len(anchor):
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [signed(anchor), signed(whole), rows.column("doc_id").take(own), rows.column("text_key").take(own),
                     pa.array((first - offsets[owner]).astype(np.int32)), pa.array(wins.astype(np.int32))],
                    ["anchor", "segment", "doc_id", "text_key", "at", "wins"],
                )

    return run


def _segment_bytes(window: int):
    """Map: texts with a list of segments to the segments' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            lengths = pc.fill_null(rows.column("segments").value_lengths(), 0).to_numpy()
            items = rows.column("segments").flatten()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            first = offsets[owner] + items.field("at").to_numpy()
            last = first + items.field("wins").to_numpy() - 1 + window
            raw = data.tobytes()
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [items.field("anchor"), items.field("hot"), rows.column("doc_id").take(own), rows.column("text_key").take(own), items.field("at"),
                 items.field("wins"), items.field("single"), pa.array([raw[a:b] for a, b in zip(first.tolist(), last.tolist())], pa.binary())],
                ["anchor", "hot", "doc_id", "text_key", "at", "wins", "single", "bytes"],
            )

    return run


def _cut_again(window: int, seed: int):
    """Map: segments with bytes to their parts under another order of grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, data, offsets in text_slices(batches, "bytes", SLICE):
            anchor, whole, first, wins, owner = segments(data, offsets, window, powers, seed)
            raw = data.tobytes()
            own = pa.array(owner)
            before = rows.column("anchor").to_numpy().view(U64)[owner]
            at = rows.column("at").to_numpy()[owner] + first - offsets[owner]
            last = first + wins - 1 + window
            yield pa.RecordBatch.from_arrays(
                [signed(scramble(anchor ^ scramble(before + U64(seed)))), signed(whole), rows.column("doc_id").take(own), rows.column("text_key").take(own),
                 pa.array(at.astype(np.int32)), pa.array(wins.astype(np.int32)), rows.column("single").take(own),
                 pa.array([raw[a:b] for a, b in zip(first.tolist(), last.tolist())], pa.binary())],
                ["anchor", "segment", "doc_id", "text_key", "at", "wins", "single", "bytes"],
            )

    return run


def _window_hashes(window: int):
    """Map: segments with bytes to two hashes of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows, data, offsets in text_slices(batches, "bytes", SLICE):
            wins = rows.column("wins").to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(wins)), wins)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(wins) - wins, wins)
            at = offsets[owner] + inside
            one, two = (signed(powers.spans(powers.sums(_values(data, seed)), at, at + window)) for seed in (41, 43))
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [one, two, rows.column("doc_id").take(own), rows.column("text_key").take(own),
                 pa.array((rows.column("at").to_numpy()[owner] + inside).astype(np.int32)), rows.column("single").take(own)],
                ["one", "two", "doc_id", "text_key", "at", "single"],
            )

    return run


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each position on, as one number that sorts like them."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(U64)
    out = np.zeros(len(text), dtype=U64)
    for j in range(8):
        out = (out << U64(8)) | padded[j : j + len(text)]
    return out


def _sort_directly(at: np.ndarray, eight: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` by their first ``depth`` symbols; equal ones in any order.

    ``whole`` hashes so many symbols; a group in which it is the same is done.
    """
    out = at.copy()
    slot, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    last = len(eight) - 1
    for step in range(0, depth, 8):
        here = out[slot]
        order = np.lexsort((eight[np.minimum(here + step, last)], group))
        here, group = here[order], group[order]
        key = eight[np.minimum(here + step, last)]
        out[slot] = here
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        number = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate([head, [len(here)]]))
        value = whole[here]
        alike = (np.minimum.reduceat(value, head) == np.maximum.reduceat(value, head)) if len(head) else np.zeros(0, dtype=bool)
        stay = ((size > 1) & ~alike)[number]
        slot, group = slot[stay], number[stay]
        if not len(slot):
            break
    return out


def suffix_array(text: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` to a depth of ``depth`` symbols, in two stages.

    The text ends with its least symbol. Stage one sorts the suffixes that are
    smaller than their successors; stage two scans the buckets of first symbols
    upwards and puts each larger predecessor behind what its bucket holds.
    """
    n = len(text)
    rises = np.zeros(n, dtype=np.int64)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    rises[-1] = 1
    known = np.flatnonzero(rises)
    rises = rises[known[np.searchsorted(known, np.arange(n))]]
    small = rises > 0
    direct = _sort_directly(np.flatnonzero(small), _eight(text), whole, depth)

    sizes = np.bincount(text, minlength=256)
    begin = np.cumsum(sizes) - sizes
    induced = np.bincount(text[~small], minlength=256)
    out = np.full(n, -1, dtype=np.int64)
    first = text[direct].astype(np.int64)
    firsts = np.searchsorted(first, np.arange(257))
    out[(begin + induced)[first] + np.arange(len(direct)) - firsts[first]] = direct
    free = begin.copy()

    def put(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~small[before]]
        bucket = text[before].astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        before, bucket = before[order], bucket[order]
        own = np.arange(len(before)) - np.searchsorted(bucket, bucket)
        out[free[bucket] + own] = before
        np.add.at(free, bucket, 1)

    for symbol in np.flatnonzero(sizes).tolist():
        done = begin[symbol]
        while done < free[symbol]:
            upto = free[symbol]
            put(out[done:upto])
            done = upto
        put(out[begin[symbol] + induced[symbol] : begin[symbol] + sizes[symbol]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares ``depth`` symbols with the next one in the array."""
    eight = _eight(text)
    same = np.arange(len(order) - 1)
    last = len(text) - 1
    for step in list(range(0, depth - 7, 8)) + [depth - 8]:
        a, b = order[same] + step, order[same + 1] + step
        keep = (a <= last) & (b <= last)
        keep &= eight[np.minimum(a, last)] == eight[np.minimum(b, last)]
        same = same[keep]
    out = np.zeros(len(order), dtype=bool)
    out[same] = True
    return out


def repeated_starts(pieces: list[bytes], wins: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """Which windows of the pieces (the first ``wins`` starts of each) occur twice."""
    # UTF-8 leaves the highest byte values free, so a shift by one frees the least.
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8) + np.uint8(1)
    lengths = np.array([len(p) + 1 for p in pieces])
    first = np.cumsum(lengths) - lengths
    sums = powers.sums(_values(text))
    ends = np.minimum(np.arange(len(text)) + window, len(text))
    whole = powers.spans(sums, np.arange(len(text)), ends)
    order = suffix_array(text, whole, window)
    same = common_prefixes(text, order, window)
    twice = np.zeros(len(text), dtype=bool)
    twice[order[same]] = True
    twice[order[np.flatnonzero(same) + 1]] = True
    owner = np.repeat(np.arange(len(pieces)), wins)
    return twice[first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(wins) - wins, wins)]


def _sorted_repeats(window: int):
    """Map over segments sorted by gram: suffix-sort whole grams together."""
    names = ["doc_id", "text_key", "at", "wins"]

    def solve(rows: pa.Table, powers: Powers) -> pa.RecordBatch:
        wins = rows.column("wins").to_numpy().astype(np.int64)
        twice = repeated_starts(rows.column("bytes").to_pylist(), wins, window, powers)
        owner = np.repeat(np.arange(len(wins)), wins)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(wins) - wins, wins)
        at = np.flatnonzero(twice & rows.column("single").to_numpy()[owner])
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])) if len(at) else at
        runs = np.diff(np.concatenate([head, [len(at)]]))
        own = owner[at[head]]
        where = rows.column("at").to_numpy()[own] + inside[at[head]]
        take = pa.array(own)
        columns = [rows.column("doc_id").combine_chunks().take(take), rows.column("text_key").combine_chunks().take(take)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(where.astype(np.int32)), pa.array(runs.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            bounds = np.flatnonzero(np.concatenate([[anchors[0] != last], anchors[1:] != anchors[:-1]]))
            lengths = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())])
            start = 0
            for cut in bounds.tolist():
                if size + lengths[cut] - lengths[start] >= SORT_BYTES:
                    if cut > start:
                        held.append(batch.slice(start, cut - start))
                    yield solve(pa.Table.from_batches(held), powers)
                    held, start, size = [], cut, 0
            held.append(batch.slice(start))
            size, last = size + lengths[-1] - lengths[start], anchors[-1]
        if held:
            yield solve(pa.Table.from_batches(held), powers)

    return run


def _cut(window: int):
    """Map: texts with their repeated windows to byte counts and the bytes kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(batch.column("spans").value_lengths(), 0).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            items = batch.column("spans").flatten()
            first, wins = items.field("at").to_numpy(), items.field("wins").to_numpy()
            sizes, removed, runs, kept = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(raw))
                a, b = bounds[i], bounds[i + 1]
                spans = 0
                if a < b:
                    order = np.argsort(first[a:b], kind="stable")
                    at = first[a:b][order].astype(np.int64)
                    end = np.maximum.accumulate(at + wins[a:b][order] - 1 + window)
                    head = np.flatnonzero(np.concatenate([[True], at[1:] > end[:-1]]))
                    tail = np.concatenate([head[1:], [len(at)]]) - 1
                    spans, pieces, place = len(head), [], 0
                    for x, y in zip(at[head].tolist(), end[tail].tolist()):
                        pieces.append(raw[place:x])
                        place = y
                    raw = b"".join([*pieces, raw[place:]])
                removed.append(sizes[-1] - len(raw))
                runs.append(spans)
                kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, text_key, spans): runs of windows that also start anywhere else.

    ``docs`` has doc_id (not null), text and text_key. ``spans`` lists (at, wins):
    ``wins`` windows from byte ``at`` on.
    """
    schema = "anchor long, segment long, doc_id long, text_key long, at int, wins int"
    found = materialised(docs.mapInArrow(_segments(window), schema), "byte_segments")
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("segment").alias("a"), F.max("segment").alias("b")).filter("n > 1")
    # Written, so that the join sees two plain shuffles and can split a frequent gram.
    often = materialised(often.select("anchor", (F.col("a") != F.col("b")).alias("differ")), "shared_grams")
    shared = materialised(found.join(often, "anchor"), "shared_bytes")
    alike = shared.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "at", "wins", "differ")).alias("one"))
    alike = materialised(alike.select("anchor", "segment", "n", "one.*"), "distinct_bytes")
    whole = shared.join(alike.filter("n > 1").select("anchor", "segment"), ["anchor", "segment"]).select("doc_id", "text_key", "at", "wins")

    kinds = alike.filter("differ").groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    kinds = kinds.filter("least = 1").select("anchor", (F.col("kinds") > SORTED_SEGMENTS).alias("hot"))
    left = alike.join(kinds, "anchor").groupBy("doc_id", "text_key")
    left = materialised(left.agg(F.collect_list(F.struct("anchor", "hot", "at", "wins", (F.col("n") == 1).alias("single"))).alias("segments")), "open_bytes")
    texts = with_small(docs, left.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi")
    texts = with_small(texts, left, ["doc_id", "text_key"], "inner", "segments").select("doc_id", "text_key", "text", "segments")
    schema = "anchor long, hot boolean, doc_id long, text_key long, at int, wins int, single boolean, bytes binary"
    pieces = materialised(texts.mapInArrow(_segment_bytes(window), schema), "segment_bytes")

    out = "doc_id long, text_key long, at int, wins int"
    found_spans, hot = [whole], pieces.filter("hot")
    cold = [pieces.filter("NOT hot")]
    for turn in range(1, CUTS + 1):
        if hot.isEmpty():
            break
        parts = "anchor long, segment long, doc_id long, text_key long, at int, wins int, single boolean, bytes binary"
        parts = materialised(hot.drop("hot").mapInArrow(_cut_again(window, turn), parts), "cut_bytes")
        alike = parts.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "at")).alias("one"))
        alike = materialised(alike, "cut_segments")
        kinds = alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        kinds = materialised(kinds.filter("kinds > 1 AND least = 1").select("anchor", (F.col("kinds") > SORTED_SEGMENTS).alias("hot")), "cut_grams")
        found_spans.append(parts.filter("single").join(alike.filter("n > 1").select("anchor", "segment"), ["anchor", "segment"]).select("doc_id", "text_key", "at", "wins"))
        # One part stands for all equal ones; where there are several, it needs no answer of its own.
        several = alike.select("anchor", "segment", (F.col("n") == 1).alias("alone"), "one.*")
        left = parts.join(several, ["anchor", "segment", "doc_id", "text_key", "at"]).join(kinds, "anchor")
        left = materialised(left.withColumn("single", F.col("single") & F.col("alone")).select(pieces.columns), "open_parts")
        cold.append(left.filter("NOT hot"))
        hot = left.filter("hot")
    ready = reduce(DataFrame.unionByName, cold)
    found_spans.append(ready.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_repeats(window), out))
    each = materialised(hot.mapInArrow(_window_hashes(window), "one long, two long, doc_id long, text_key long, at int, single boolean"), "hot_windows")
    twice = materialised(each.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two"), "repeated_windows")
    found_spans.append(each.filter("single").join(twice, ["one", "two"]).select("doc_id", "text_key", "at", F.lit(1).alias("wins")))
    union = reduce(DataFrame.unionByName, found_spans)
    spans = union.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "wins")).alias("spans"))
    return materialised(spans, "byte_spans")


def remove_repeats(docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``.

    A byte of the UTF-8 text goes if it is covered by a string of ``window``
    bytes that also starts anywhere else, in any row or at another place of the
    same text; all are judged on the input. ``n_spans`` counts maximal removed
    runs; ``kept`` has the remaining bytes, which may cut a character.

    A null text is empty. Rows repeated under one doc_id, or without one, count
    as places of their own. Extra columns are left out; an empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    named = docs.withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    spans = repeated_windows(named.select("doc_id", "text", "text_key"), window)
    marked = with_small(named, spans, ["doc_id", "text_key"], "left", "spans").select(F.col("own_id").alias("doc_id"), "text", "spans")
    return marked.mapInArrow(_cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
