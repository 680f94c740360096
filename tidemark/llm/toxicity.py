"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of a text, the first letters of its words, and a few marks
of shouting, hashed into a fixed number of buckets. The machine learns a weight
and a short factor for each term that a few texts have, however the classes
share it; products of factors stand for pairs of terms. It is fitted by rounds of local AdaGrad on a
fixed number of shards, of which the driver only averages the parameters.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import U64, Words, give_back, lower_table, random_values, scramble, separators, text_slices
from tidemark.llm.frames import small_batches, with_small
from tidemark.session import materialised

BUCKETS = 1 << 18
FACTORS = 6
PREFIXES = (3, 4, 5, 6, 7, 9)
#: Labelled rows the machine is fitted on, at most; beyond, a share drawn by key hash.
TRAIN_ROWS = 30_000
#: Training rows that must have a term; the only screen, so that terms which matter only together stay.
LEAST_ROWS = 3
SHARDS = 8
ROUNDS = 8
EPOCHS = 6
THRESHOLD = 0.3
#: Text bytes whose terms are looked up at once (or one longer text); a word makes up to seven terms.
TERM_BYTES = 1 << 17
#: Cells of texts and terms up to which pairs are marked in a table; beyond, they are sorted.
CELLS = 1 << 22


def _letters() -> np.ndarray:
    return separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class Terms:
    """Distinct hashed terms of the texts of a slice, as (text, bucket) pairs, or (text, slot) of the buckets that have one.

    Terms are looked up once for each different word of the slice, whatever the
    number of texts it stands in.
    """

    def __init__(self, slot: np.ndarray | None = None) -> None:
        self.parts, self.lower, self.slot = _letters(), lower_table(), slot

    def _placed(self, buckets: np.ndarray) -> np.ndarray:
        return buckets if self.slot is None else np.where(buckets >= 0, self.slot[buckets], -1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = Words(self.lower[data], offsets, self.parts)
        n, texts = len(words.count), np.arange(len(words.count))
        order = np.argsort(words.hash)
        fresh = np.diff(words.hash[order], prepend=~words.hash[order[:1]]) != 0
        kind = np.empty(len(order), dtype=np.int64)
        kind[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        kinds, size, at = words.hash[first], (words.end - words.start)[first], words.at[first]
        table = np.full((len(kinds), 1 + len(PREFIXES)), -1, dtype=np.int64)
        table[:, 0] = (kinds >> U64(46)).astype(np.int64)
        for j, letters in enumerate(PREFIXES, 1):
            longer = np.flatnonzero(size > letters)
            begin = at[longer]
            hashes = scramble(words.sums[begin + letters] - words.sums[begin] + U64(letters * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            table[longer, j] = (hashes >> U64(46)).astype(np.int64)
        # Shouting: how much of the text is upper case, and exclamation marks, in four steps each.
        length, steps = np.maximum(np.diff(offsets), 1), []
        for seed, marked in ((17, (data >= 65) & (data <= 90)), (19, data == 33)):
            total = np.concatenate([[0], np.cumsum(marked)])
            step = np.minimum(3, np.diff(total[offsets]) * 8 // length)
            steps.append(self._placed((random_values(4, seed) >> U64(46)).astype(np.int64))[step])
        table = self._placed(table)
        # Terms of the slice are numbered, so that a text's distinct ones are few cells.
        here = np.zeros(BUCKETS, dtype=bool)
        for some in (table, *steps):
            here[some[some >= 0]] = True
        found = np.flatnonzero(here)
        place = np.zeros(BUCKETS, dtype=np.int64)
        place[found] = np.arange(len(found))
        text, kind = distinct(np.repeat(texts, words.count), kind, n, len(kinds))
        table = np.where(table >= 0, place[table], -1)[kind]
        text = np.concatenate([np.repeat(text, 1 + len(PREFIXES)), texts, texts])
        term = np.concatenate([table.ravel(), *[np.where(step >= 0, place[step], -1) for step in steps]])
        real = term >= 0
        text, term = distinct(text[real], term[real], n, len(found))
        return text, found[term]


def distinct(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a row and a column, sorted; cells of a table where it is small enough."""
    keys = row * columns + column
    if rows * columns <= CELLS:
        cells = np.zeros(rows * columns, dtype=bool)
        cells[keys] = True
        keys = np.flatnonzero(cells)
    else:
        keys = np.sort(keys)
        keys = keys[np.diff(keys, prepend=-1) != 0]
    row = np.searchsorted(keys, np.arange(rows + 1) * columns)
    row = np.repeat(np.arange(rows), np.diff(row))
    return row, keys - row * columns


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for rows, data, offsets in text_slices(batches, limit=TERM_BYTES):
        text, bucket = terms(data, offsets)
        bounds = np.searchsorted(text, np.arange(rows.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column("shard"), rows.column("toxic"), lists], ["shard", "toxic", "terms"])


class Machine:
    """Parameters over the chosen terms; ``slot`` maps a bucket to its row, or to -1."""

    def __init__(self, chosen: np.ndarray, prior: float) -> None:
        self.slot = np.full(BUCKETS, -1, dtype=np.int32)
        self.slot[chosen] = np.arange(len(chosen))
        self.bias = float(np.log(prior / (1 - prior)))
        self.weight = np.zeros(len(chosen), dtype=np.float32)
        noise = random_values(len(chosen) * FACTORS, 29).astype(np.float64) / 2.0**64
        self.factor = ((noise.reshape(-1, FACTORS) - 0.5) * 0.05).astype(np.float32)

    def raw(self, doc: np.ndarray, term: np.ndarray, n: int):
        """Scores before the logistic of sorted (text, term) pairs, and the texts' factor sums."""
        # Weight, square and factors of a term lie side by side, so that a text's are summed in one pass.
        begin = np.searchsorted(doc, np.arange(n + 1))
        full = np.flatnonzero(np.diff(begin))
        sums = np.zeros((n, 2 + FACTORS))
        if len(doc):
            factor = np.take(self.factor, term, axis=0)
            sums[full] = np.add.reduceat(np.column_stack([np.take(self.weight, term), np.einsum("tf,tf->t", factor, factor), factor]), begin[full], axis=0, dtype=np.float64)
        linear, squares, sums = sums[:, 0], sums[:, 1], sums[:, 2:]
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int, rate: float = 0.1, shrink: float = 1e-4) -> None:
        """AdaGrad over 64 documents at a time, each with distinct terms."""
        terms, sizes = np.concatenate([*docs, np.zeros(0, dtype=np.int32)]), np.array([len(d) for d in docs], dtype=np.int64)
        g_bias, g_weight, g_factor = 1e-2, np.full(len(self.weight), 1e-2, dtype=np.float32), np.full(self.factor.shape, 1e-2, dtype=np.float32)
        place, seen = np.zeros(len(self.weight), dtype=np.int64), np.zeros(len(self.weight), dtype=bool)
        starts = np.cumsum(sizes) - sizes
        for epoch in range(epochs):
            order = np.argsort(random_values(len(sizes), seed * 131 + epoch))
            for part in np.array_split(order, max(1, len(order) // 64)):
                full = np.flatnonzero(sizes[part])
                begin = np.cumsum(sizes[part]) - sizes[part]
                doc = np.repeat(np.arange(len(part)), sizes[part])
                term = np.take(terms, np.arange(len(doc)) + np.repeat(starts[part] - begin, sizes[part]))
                seen[term] = True
                touched = np.flatnonzero(seen)
                seen[touched] = False
                place[touched] = np.arange(len(touched))
                local = np.take(place, term)
                # Weight, square and factors of a term lie side by side, so that a text's are summed in one pass.
                weight, factor = np.take(self.weight, touched), np.take(self.factor, touched, axis=0)
                own = np.column_stack([weight, np.einsum("tf,tf->t", factor, factor), factor])
                sums = np.zeros((len(part), own.shape[1]), dtype=np.float32)
                if len(term):
                    sums[full] = np.add.reduceat(np.take(own, local, axis=0), begin[full], axis=0)
                linear, squares, sums = sums[:, 0], sums[:, 1], sums[:, 2:]
                score = self.bias + linear + 0.5 * ((sums.astype(np.float64) ** 2).sum(axis=1) - squares)
                error = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[part]) / len(part)).astype(np.float32)
                self.bias -= rate * float(error.sum()) / (g_bias := g_bias + float(error.sum()) ** 2) ** 0.5
                if not len(term):
                    continue
                pull = np.vstack([error, error * sums.T]).astype(np.float64)
                each, *pull = (np.bincount(local, np.take(one, doc), len(touched)).astype(np.float32) for one in pull)
                grad = each + shrink * weight
                total = np.take(g_weight, touched) + grad**2
                np.put(g_weight, touched, total)
                np.put(self.weight, touched, weight - rate * grad / np.sqrt(total))
                grad = np.stack(pull, axis=1) - each[:, None] * factor + shrink * factor
                g_factor[touched] = total = np.take(g_factor, touched, axis=0) + grad**2
                self.factor[touched] = factor - rate * grad / np.sqrt(total)

    def pack(self) -> bytes:
        return np.concatenate([[self.bias], self.weight, self.factor.ravel()]).astype(np.float32).tobytes()

    def unpack(self, values: np.ndarray) -> None:
        n = len(self.weight)
        self.bias, self.weight, self.factor = float(values[0]), values[1 : n + 1].astype(np.float32), values[n + 1 :].reshape(-1, FACTORS).astype(np.float32)


_SHARD = "shard int, toxic binary, sizes binary, terms binary"


def _packed(machine: Machine):
    """Map over whole shards: one row for each, its terms as rows of the machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for shard, toxic, terms in zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist(), batch.column("terms")):
                slots = machine.slot[terms.values.to_numpy()]
                found.setdefault(shard, []).append((toxic, slots[slots >= 0]))
        for shard, rows in sorted(found.items()):
            # A shard's rows come in any order; the fit has its own.
            rows.sort(key=lambda r: (r[0], r[1].tobytes()))
            packed = [np.array([t for t, _ in rows], dtype=np.int32), np.array([len(s) for _, s in rows], dtype=np.int32), np.concatenate([s for _, s in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], ["shard", "toxic", "sizes", "terms"])
        found.clear()
        give_back()

    return run


def _fit_shards(machine: Machine, turn: int):
    """Map over shards: fit a copy on each, return its parameters and rows."""
    machine = copy.copy(machine)
    machine.slot = None  # not sent: shards have rows of the machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                labels, sizes, terms = (np.frombuffer(row[c], dtype=np.int32) for c in ("toxic", "sizes", "terms"))
                own = copy.deepcopy(machine)
                own.fit(np.split(terms, np.cumsum(sizes)[:-1]), labels.astype(np.float64), EPOCHS, turn * SHARDS + row["shard"])
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([len(labels)], pa.int64()), pa.array([own.pack()], pa.binary())], ["shard", "rows", "parameters"])
                del own, labels, sizes, terms, row
        give_back()

    return run


def _remainder(doc_id):
    """crc32 of the doc_id as text, modulo 4; rows with remainder 2 are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine fitted on the labelled texts that are not held out.

    At most about ``TRAIN_ROWS`` rows are used, drawn by a hash of their doc_id.
    Rows without a text or a label of 0 or 1 are left out. None if a class is
    missing.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(_remainder("doc_id") != 2)
    total = known.count()
    share = min(1.0, TRAIN_ROWS / max(total, 1))
    known = materialised(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)), "toxic_labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    rows = with_small(texts, known, ["doc_id"], "inner").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(SHARDS)).cast("int"))
    rows = materialised(rows.select("shard", "toxic", "text").mapInArrow(_extract, "shard int, toxic int, terms array<int>"), "toxic_terms")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    # One number for each bucket at most, whatever the input's size.
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LEAST_ROWS)
    chosen = np.sort(counts.select("term").toArrow().column(0).to_numpy().astype(np.int64))
    machine = Machine(chosen, size[1] / (size[1] + size[0]))
    # One row for each shard, dealt out once: a share of TRAIN_ROWS is a few megabytes.
    shards = rows.repartition(SHARDS, "shard").mapInArrow(_packed(machine), _SHARD)
    shards = materialised(shards, "toxic_rows")
    for turn in range(ROUNDS):
        # As Arrow: the driver then holds the shards' parameters about once.
        parts = shards.mapInArrow(_fit_shards(machine, turn), "shard int, rows long, parameters binary").toArrow()
        weights, values = parts.column("rows").to_numpy(), parts.column("parameters")
        total = np.zeros(1 + len(machine.weight) * (1 + FACTORS))
        for i in np.argsort(parts.column("shard").to_numpy()):
            total += weights[i] * np.frombuffer(values[int(i)].as_buffer(), dtype=np.float32)
        machine.unpack(total / weights.sum())
    return machine


def _score(machine: Machine | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.slot if machine is not None else None)
        for rows, data, offsets in text_slices(batches, limit=TERM_BYTES):
            n = rows.num_rows
            score = np.zeros(n)
            if machine is not None:
                raw, _ = machine.raw(*terms(data, offsets), n)
                score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            rows = rows.append_column("score", pa.array(score))
            yield rows.select([c for c in rows.schema.names if c != "text"])

    return run


def score_toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) for each row: the machine's probability of label 1.

    Scores come from the whole text alone. Null and empty texts are scored as
    texts without words, and all rows get 0 where no machine could be fitted.
    Repeated rows get equal scores; extra columns are left out.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(machine), "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row was kept from the fit by its doc_id; false without one."""
    return F.coalesce(_remainder(doc_id) == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    machine = fit_toxicity(docs, labels)
    if machine is None:
        return docs
    # Only texts move to Python and only scores back; the rows stay where they are.
    return docs.filter(_text_score(machine)(F.col("text").cast("string")) < threshold)


def _text_score(machine: Machine):
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _score(machine)
        for one in texts:
            parts = run(iter([pa.RecordBatch.from_arrays([one], ["text"])]))
            yield pa.concat_arrays([pa.array([], pa.float64()), *[part.column("score") for part in parts]])

    return score
