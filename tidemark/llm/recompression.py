"""Substring dedup by recompression.

Rounds rename the words of every text: first runs of equal symbols, then pairs of
neighbours of which a round's coin puts one on the left and one on the right
side. A name is a 64-bit hash of what it stands for, so equal runs and pairs get
equal names in every task, without a dictionary to look up. Each symbol carries
the words its parse depends on; a symbol whose context lies inside a repeated
passage has the same name wherever the passage stands.

Every window of ``window`` words picks the longest symbol whose context it
holds (a window without one names itself). Windows that pick the same symbol
occurrence form one segment. Symbols seen in one document only end there. Where
several have it, equal segments are settled at once, and only windows of
different segments are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import U64, Powers, Words, random_values, scramble, signed, text_slices, white_space
from tidemark.llm.frames import with_small
from tidemark.session import materialised

ROUNDS = 4


def compress(names: np.ndarray, text: np.ndarray, rounds: int = ROUNDS):
    """Symbols after so many rounds: (name, start, end, left, right).

    ``text`` numbers the text of each word. A symbol spans words start to end
    and depends on words left to right, ends not included. A symbol that depends
    on its text's border reaches one word beyond it, where no window reaches.
    """
    n = len(names)
    start = np.arange(n, dtype=np.int64)
    end = start + 1
    left, right = start, end
    coins = random_values(2 * rounds, 37)
    for turn in range(rounds):
        if not len(names):
            break
        # Runs: equal neighbours become one symbol, named by what is repeated and how often.
        new_text = np.concatenate([[True], text[1:] != text[:-1]])
        head = np.flatnonzero(new_text | np.concatenate([[True], names[1:] != names[:-1]]))
        tail = np.concatenate([head[1:], [len(names)]]) - 1
        times = tail - head + 1
        name = names[head]
        many = times > 1
        name[many] = scramble(name[many] ^ scramble(times[many].astype(U64) + coins[2 * turn]))
        opens = new_text[head]
        closes = np.concatenate([opens[1:], [True]])
        before = np.where(opens, start[head] - 1, left[np.maximum(head - 1, 0)])
        behind = np.where(closes, end[tail] + 1, right[np.minimum(tail + 1, len(names) - 1)])
        names, text, start, end, left, right = name, text[head], start[head], end[tail], before, behind
        # Pairs: a symbol on the left side joins a following one on the right side.
        side = (scramble(names ^ coins[2 * turn + 1]) & U64(1)).astype(bool)
        fresh = np.concatenate([[True], text[1:] != text[:-1]])
        ends_text = np.concatenate([fresh[1:], [True]])
        next_side = np.concatenate([side[1:], [True]])
        joins = side & ~next_side & ~ends_text
        joined = np.concatenate([[False], joins[:-1]])
        keep = np.flatnonzero(~joined)
        pair = joins[keep]
        name = names[keep]
        other = np.minimum(keep + 1, len(names) - 1)
        name[pair] = scramble(name[pair] * U64(0xD6E8FEB86659FD93) + scramble(names[other[pair]] ^ coins[2 * turn]))
        alone_left = ~pair & side[keep]
        alone_right = ~pair & ~side[keep]
        low = left[keep].copy()
        low[alone_right] = np.where(fresh[keep], start[keep] - 1, left[np.maximum(keep - 1, 0)])[alone_right]
        high = np.where(pair, right[other], right[keep])
        high[alone_left] = np.where(ends_text[keep], end[keep] + 1, right[other])[alone_left]
        names, text, start, end, left, right = name, text[keep], start[keep], np.where(pair, end[other], end[keep]), low, high
    return names, start, end, left, right


def _least_in(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the first least key in each range low to high, all of them not empty."""
    levels = [np.arange(len(keys))]
    width = int((high - low).max()) if len(low) else 1
    while (1 << len(levels)) <= width:
        a = levels[-1]
        step = 1 << (len(levels) - 1)
        b = a[np.minimum(np.arange(len(keys)) + step, len(keys) - 1)]
        levels.append(np.where(keys[a] <= keys[b], a, b))
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    table = np.stack(levels)
    a, b = table[level, low], table[level, high - (1 << level)]
    return np.where(keys[a] <= keys[b], a, b)


def segments(words: Words, window: int, powers: Powers, sums: np.ndarray):
    """Segments of all windows: (anchor name, segment hash, first window, windows, text)."""
    count = words.count
    text = np.repeat(np.arange(len(count)), count)
    n = len(words.hash)
    names, start, end, left, right = compress(words.hash, text)
    at = np.arange(n)
    at = at[at + window <= np.repeat(words.first[1:], count)]
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none.astype(U64), none, none, none
    low = np.searchsorted(left, at, "left")
    high = np.searchsorted(right, at + window, "right")
    covered = low < high
    picked = np.full(len(at), -1)
    keys = (U64(255) - np.minimum(end - start, 255).astype(U64)) << U64(56) | names >> U64(8)
    picked[covered] = _least_in(keys, low[covered], high[covered])
    owner = text[at]
    new = np.concatenate([[True], (picked[1:] != picked[:-1]) | (picked[1:] < 0) | (owner[1:] != owner[:-1])])
    head = np.flatnonzero(new)
    wins = np.diff(np.concatenate([head, [len(at)]]))
    first, chosen = at[head], picked[head]
    whole = powers.spans(sums, first, first + wins - 1 + window)
    inner = np.where(chosen >= 0, start[np.maximum(chosen, 0)] - first, 0)
    whole = scramble(whole ^ scramble(inner.astype(U64) + U64(1)))
    anchor = np.where(chosen >= 0, names[np.maximum(chosen, 0)], whole)
    return anchor, whole, first, wins, owner[head]


def _segments(window: int):
    """Map: texts to segments. Rows without a doc_id and short texts have none."""
    fields = ["anchor", "segment", "doc_id", "text_key", "at", "wins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, parts = Powers(), white_space()
        for rows, data, offsets in text_slices(batches):
            words = Words(data, offsets, parts)
            anchor, whole, first, wins, owner = segments(words, window, powers, powers.sums(words.hash))
            if len(anchor):
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [signed(anchor), signed(whole), rows.column("doc_id").take(own), rows.column("text_key").take(own),
                     pa.array((first - words.first[owner]).astype(np.int32)), pa.array(wins.astype(np.int32))], fields,
                )

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from zero and the values of a list column; null lists are empty."""
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy().astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten()


def _windows(window: int):
    """Map: texts with a list of segments to the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, parts = Powers(), white_space()
        for rows, data, offsets in text_slices(batches):
            words = Words(data, offsets, parts)
            bounds, items = _lists(rows.column("segments"))
            first, wins = items.field("at").to_numpy(), items.field("wins").to_numpy()
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            inside = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
            at = np.repeat(words.first[owner] + first, wins) + inside
            hashes = powers.spans(powers.sums(words.hash), at, at + window)
            own = np.repeat(owner, wins)
            yield pa.RecordBatch.from_arrays(
                [items.field("anchor").take(pa.array(np.repeat(np.arange(len(items)), wins))), signed(hashes), rows.column("doc_id").take(pa.array(own)),
                 rows.column("text_key").take(pa.array(own)), pa.array((at - words.first[own]).astype(np.int32))], ["anchor", "hash", "doc_id", "text_key", "at"],
            )

    return run


def _cut(window: int):
    """Map: texts with their removed windows to word counts and the words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, items = _lists(batch.column("spans"))
            first, wins = items.field("at").to_numpy(), items.field("wins").to_numpy()
            counts, removed, kept = [], [], []
            for i, text in enumerate(batch.column("text")):
                words = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                words = words.split()
                a, b = bounds[i], bounds[i + 1]
                counts.append(len(words))
                if a < b:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edges, first[a:b], 1)
                    np.add.at(edges, first[a:b] + wins[a:b] - 1 + window, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, spans): runs of windows that also start in a lesser doc_id.

    ``docs`` has doc_id, text and text_key. ``spans`` lists (at, wins): ``wins``
    windows from word ``at`` on.
    """
    schema = "anchor long, segment long, doc_id long, text_key long, at int, wins int"
    found = materialised(docs.filter("doc_id IS NOT NULL").mapInArrow(_segments(window), schema), "segments")
    spread = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("segment").alias("a"), F.max("segment").alias("b"))
    # Written, so that the join sees two plain shuffles and can split a frequent symbol.
    spread = materialised(spread.filter("low < high").select("anchor", (F.col("a") != F.col("b")).alias("differ")), "shared_symbols")
    shared = materialised(found.join(spread, "anchor"), "shared_segments")
    firsts = materialised(shared.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first")), "first_segments")
    marked = materialised(shared.join(firsts, ["anchor", "segment"]), "marked_segments")
    whole = marked.filter("first < doc_id").select("doc_id", "text_key", "at", "wins")
    left = marked.filter("first = doc_id AND differ").groupBy("doc_id", "text_key")
    left = materialised(left.agg(F.collect_list(F.struct("anchor", "at", "wins")).alias("segments")), "open_segments")
    texts = with_small(docs, left.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi")
    texts = with_small(texts, left, ["doc_id", "text_key"], "inner", "segments").select("doc_id", "text_key", "text", "segments")
    windows = materialised(texts.mapInArrow(_windows(window), "anchor long, hash long, doc_id long, text_key long, at int"), "windows")
    earliest = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    earliest = materialised(earliest.select("anchor", "hash", "first"), "first_windows")
    single = windows.join(earliest, ["anchor", "hash"]).filter("first < doc_id").select("doc_id", "text_key", "at", F.lit(1).alias("wins"))
    spans = whole.unionByName(single).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "wins")).alias("spans"))
    return materialised(spans, "repeat_spans")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs``.

    Words are parted at ASCII white space and otherwise unchanged. A word goes if
    it is covered by a window of consecutive words that also starts in a document
    with a lesser doc_id, judged on the input. ``kept_text`` joins the rest by
    single spaces.

    A null text has no words. Rows with a null doc_id have no order among the
    documents: they lose nothing and count nowhere. Rows repeated under one
    doc_id are the same document and remove nothing from each other. Extra
    columns are left out; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    spans = repeated_windows(docs, window)
    marked = with_small(docs, spans, ["doc_id", "text_key"], "left", "spans").select("doc_id", "text", "spans")
    return marked.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
