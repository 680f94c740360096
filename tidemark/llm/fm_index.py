"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a few megabytes of whole texts in one task. Its words are numbered by
the test phrases' vocabulary; a word outside of it, or a text's border, breaks
the sequence, and unbroken runs shorter than the shortest phrase are left out,
as no phrase fits in. The rest is suffix-sorted into a Burrows-Wheeler
transform, kept as a wavelet matrix of rank counts. All phrases are searched
backwards at once; their occurrences are located by walking to sampled suffix
positions, and overlapping spans of a text are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import Words, lower_table, separators, text_slices
from tidemark.llm.frames import with_small
from tidemark.session import materialised

SHARD_BYTES = 1 << 19
#: Bytes of test texts that are searched, and sent to every task, at once.
BLOCK_BYTES = 1 << 22
SAMPLE_EVERY = 16


def word_parts() -> np.ndarray:
    """Words are of digits, lower-case letters and bytes beyond ASCII."""
    return separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class WaveletMatrix:
    """Rank over a sequence of small numbers, one bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros: list[int] = []
        self.ranks: list[np.ndarray] = []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level) & 1
            rank = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(ones == 0, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(int(rank[-1]))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i entries that equal ``symbol`` end in its own order."""
        for level, (rank, zero) in enumerate(zip(self.ranks, self.zeros)):
            low = rank[i]
            i = np.where((symbol >> (self.bits - 1 - level)) & 1, zero + i - low, low)
        return i

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        out = np.zeros(len(i), dtype=np.int64)
        for rank, zero in zip(self.ranks, self.zeros):
            low = rank[i]
            one = rank[i + 1] == low
            out = 2 * out + one
            i = np.where(one, zero + i - low, low)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling. Zeros are breaks, each of them different from all others."""
    n = len(symbols)
    breaks = symbols == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
    step = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location of phrases in runs of numbers above zero.

    ``symbols`` is made of runs, each followed by one zero.
    """

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.before = np.cumsum(np.bincount(symbols, minlength=largest + 2)) - np.bincount(symbols, minlength=largest + 2)
        self.wavelet = WaveletMatrix(symbols[order - 1], max(1, int(largest).bit_length()))
        breaks = np.flatnonzero(symbols == 0)
        run = np.searchsorted(breaks, np.arange(self.n), "left")
        offset = np.arange(self.n) - np.concatenate([[0], breaks + 1])[run]
        sampled = (offset % SAMPLE_EVERY == 0)[order]
        self.sampled = sampled
        self.rank = np.cumsum(sampled) - 1
        self.position = order[sampled]

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.place(symbol, i) - self.wavelet.place(symbol, np.zeros_like(i))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of equally long phrases, one in each row."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            low[alive], high[alive] = self._step(symbol, low[alive]), self._step(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one, count the steps."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        rows, steps = rows.copy(), 0
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            out[hit] = self.position[self.rank[rows[hit]]] + steps
            open_ = open_[~done]
            here = rows[open_]
            rows[open_] = self._step(self.wavelet.at(here), here)
            steps += 1
        return out


class Phrases:
    """The windows of a block of test texts, grouped by length, with their items."""

    def __init__(self, items: list[tuple], size: int) -> None:
        parts, lower = word_parts(), lower_table()
        texts = [(i, np.frombuffer((t or "").encode(), dtype=np.uint8)) for i, t in items]
        hashes = [(i, Words(lower[t], np.array([0, len(t)]), parts).hash) for i, t in texts]
        self.words = np.unique(np.concatenate([h for _, h in hashes] or [np.zeros(0, dtype=np.uint64)]))
        owners: dict[tuple, set] = {}
        for i, h in hashes:
            numbers = (np.searchsorted(self.words, h) + 1).tolist()
            for a in range(max(1, len(numbers) - size + 1) if numbers else 0):
                owners.setdefault(tuple(numbers[a : a + size]), set()).update([] if i is None else [str(i)])
        self.lengths = sorted({len(p) for p in owners})
        grouped = [[p for p in owners if len(p) == n] for n in self.lengths]
        self.tables = [np.array(g, dtype=np.int64) for g in grouped]
        self.items = [[sorted(owners[p]) for p in g] for g in grouped]


def merged(at: np.ndarray, end: np.ndarray, owner: np.ndarray):
    """Disjoint spans per owner: overlapping or touching spans become one."""
    if not len(at):
        return at, end, owner
    order = np.lexsort((end, at, owner))
    at, end, owner = at[order], end[order], owner[order]
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    base = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base) - base
    new[1:] |= at[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return at[head], reach[np.concatenate([head[1:], [len(at)]]) - 1], owner[head]


def _hits(words: Words, phrases: Phrases):
    """(text, first word, end word, items) of all occurrences in a shard."""
    none = np.zeros(0, dtype=np.int64)
    if not phrases.lengths or not len(words.hash):
        return none, none, none, []
    number = np.minimum(np.searchsorted(phrases.words, words.hash), len(phrases.words) - 1)
    symbol = np.where(phrases.words[number] == words.hash, number + 1, 0)
    text = np.repeat(np.arange(len(words.count)), words.count)
    known = symbol > 0
    opens = known & np.concatenate([[True], ~known[:-1] | (text[1:] != text[:-1])])
    head = np.flatnonzero(opens)
    if not len(head):
        return none, none, none, []
    run = np.cumsum(opens) - 1
    size = np.bincount(run[known], minlength=len(head))
    keep = np.flatnonzero(known & (size[np.maximum(run, 0)] >= phrases.lengths[0]))
    if not len(keep):
        return none, none, none, []
    # One break behind every run that is kept.
    ends = np.concatenate([run[keep][1:] != run[keep][:-1], [True]])
    place = np.arange(len(keep)) + np.cumsum(ends) - ends
    sequence = np.zeros(len(keep) + int(ends.sum()), dtype=np.int64)
    sequence[place] = symbol[keep]
    origin = np.zeros(len(sequence), dtype=np.int64)
    origin[place] = keep
    index = FMIndex(sequence, len(phrases.words))
    texts, firsts, lasts, items = [], [], [], []
    for length, table, owners in zip(phrases.lengths, phrases.tables, phrases.items):
        low, high = index.search(table)
        found = np.flatnonzero(low < high)
        each = (high - low)[found]
        rows = np.repeat(low[found], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        first = origin[index.locate(rows)]
        texts.append(text[first])
        firsts.append(first)
        lasts.append(first + length)
        items += [owners[i] for i in np.repeat(found, each).tolist()]
    return np.concatenate(texts), np.concatenate(firsts), np.concatenate(lasts), items


_FOUND = "doc_id long, text_key long, n_words long, spans array<struct<at:int,words:int>>, items array<string>"


def _search(phrases: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lower = word_parts(), lower_table()
        for rows, data, offsets in text_slices(batches, limit=SHARD_BYTES):
            words = Words(lower[data], offsets, parts)
            text, first, last, items = _hits(words, phrases)
            n = len(words.count)
            own: list[set] = [set() for _ in range(n)]
            for t, names in zip(text.tolist(), items):
                own[t].update(names)
            at, end, owner = merged(first, last, text)
            bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array((at - words.first[owner]).astype(np.int32)), pa.array((end - at).astype(np.int32))], ["at", "words"]
            )
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), spans),
                 pa.array([sorted(s) for s in own], pa.list_(pa.string()))], ["doc_id", "text_key", "n_words", "spans", "items"],
            )

    return run


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans that several blocks of test texts gave one text."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            at = np.array([s["at"] for s in row["spans"]])
            end = at + np.array([s["words"] for s in row["spans"]])
            at, end, _ = merged(at, end, np.zeros(len(at), dtype=np.int64))
            row["spans"] = [{"at": a, "words": b - a} for a, b in zip(at.tolist(), end.tolist())]
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _least(doc_id: str) -> Column:
    """A doc_id as a key that joins: the least long for null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).withColumn("text_key", F.xxhash64("text"))


def _blocks(benchmark: DataFrame, size: int) -> list[Phrases]:
    """The test texts in blocks of bounded bytes; each is read and searched alone."""
    texts = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(count, 1)))
    return [Phrases([(r["item_id"], r["text"]) for r in texts.filter(block == b).collect()], size) for b in range(count)]


def find_passages(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items) for the rows of ``docs``.

    Words are runs of bytes other than ASCII that is no digit or letter, A-Z
    lower-cased. A window is ``size`` consecutive words of a test text; a shorter
    text, unless without words, is one window. ``spans`` are the merged runs of
    document words inside any occurrence, ``items`` the sorted ids (as strings)
    of the test texts with an occurring window. Null texts have no words; a null
    item_id marks spans but names no item. Repeated rows give equal results, an
    empty table of either kind none or no spans. Extra columns are left out.
    """
    docs = _keyed(docs.select("doc_id", "text"))
    blocks = _blocks(benchmark, size) or [Phrases([], size)]
    found = [docs.mapInArrow(_search(b), _FOUND) for b in blocks]
    if len(found) == 1:
        return found[0]
    # Every row has its words counted; what blocks found is joined to the rows by doc_id and text.
    hits = None
    for own in found:
        own = materialised(own.filter(F.size("spans") > 0).withColumn("doc_id", _least("doc_id")).dropDuplicates(["doc_id", "text_key"]), "passages")
        hits = own if hits is None else hits.unionByName(own)
    groups = hits.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    groups = materialised(groups.mapInArrow(_merge_blocks, _FOUND), "passages")
    hits = groups.select(F.col("doc_id").alias("own_id"), "text_key", "spans", "items")
    rows = docs.mapInArrow(_search(Phrases([], size)), _FOUND).select("doc_id", "text_key", "n_words", _least("doc_id").alias("own_id"))
    rows = with_small(rows, hits, ["own_id", "text_key"], "left", "spans", "items")
    return rows.select("doc_id", "text_key", "n_words", *[F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items")])


def _remove(spans_name: str):
    """Map: take the spans out of the texts, with what stands between their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lower = word_parts(), lower_table()
        for rows, data, offsets in text_slices(batches, limit=SHARD_BYTES):
            spans = rows.column(spans_name)
            names = [n for n in rows.schema.names if n != spans_name]
            if spans.null_count == len(spans):
                yield rows.select(names)
                continue
            words = Words(lower[data], offsets, parts)
            texts = rows.column("text").to_pylist()
            counts = rows.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, own in enumerate(spans.to_pylist()):
                if not own:
                    continue
                pieces, place = [], int(offsets[i])
                for span in own:
                    a = words.first[i] + span["at"]
                    pieces.append(data[place : words.start[a]].tobytes())
                    place = int(words.end[a + span["words"] - 1])
                pieces.append(data[place : offsets[i + 1]].tobytes())
                texts[i] = b"".join(pieces).decode()
                if counts is not None:
                    counts[i] = len(texts[i])
            rows = rows.select(names)
            rows = rows.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
            if counts is not None:
                rows = rows.set_column(names.index("n_chars"), "n_chars", pa.array(counts, rows.schema.field("n_chars").type))
            yield rows

    return run


def remove_passages(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with the words of benchmark passages taken out of ``text``.

    All rows and columns stay; ``n_chars``, where there is one, is counted again
    for changed texts. Rows are told apart by doc_id and text.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    doc, key, spans = (f"passage_{c}_{len(names)}" for c in ("doc", "key", "spans"))
    found = find_passages(docs, benchmark, size).filter(F.size("spans") > 0).select(_least("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(spans))
    found = materialised(found.dropDuplicates([doc, key]), "passages")
    marked = with_small(docs.withColumn(doc, _least("doc_id")).withColumn(key, F.xxhash64("text")), found, [doc, key], "left", spans)
    return marked.select(*[F.col(f"`{c}`") for c in names], spans).mapInArrow(_remove(spans), docs.schema)
