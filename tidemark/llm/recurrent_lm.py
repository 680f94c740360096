"""A gated recurrent language model: log-likelihoods of whole documents.

Words are counted over all training texts. The commonest ones have an output of
their own in the network, in classes of about equal mass: first the class is
predicted from the state, then the word within it. Every other word is predicted
as one of the rare, and then has its share of their counts, which a join brings.

The network is fitted in rounds. In each, tasks run truncated backpropagation
over their own share of the training texts, every one of which is read once, and
their weights are averaged by words read. Texts run side by side in lanes; a
lane's state goes on from window to window until its text ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import Words, keeping_memory, lower_table, signed, text_slices, white_space
from tidemark.session import materialised

#: Words with an output of their own.
HEAD = 4096
#: Commonest words whose counts every task has at hand; others are joined.
TABLE = 1 << 18
CLASSES = 48
HIDDEN = 16
#: Steps that an error is carried back over.
WINDOW = 16
#: Texts that run side by side, at most; fewer where a task's share would else be gone in a few updates.
LANES = 1024
UPDATES = 100
#: Words held by a task at once (or one longer text).
WORDS_AT_ONCE = 1 << 22
ROUNDS = 4
RATE = 0.15
#: Largest score whose exponential is safe in single precision without a shift.
SAFE = 60.0
#: Tasks' weights are first added in so many groups.
GROUPS = 32

END = np.uint64(0x5D0E_17EC_93A4_2B61)
LN10 = float(np.log(10.0))


def held_out() -> Column:
    """Documents that the model does not learn from; a null doc_id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice with an END behind each text, and the texts' bounds."""
    words = Words(lower_table()[data], offsets, white_space())
    bounds = words.first + np.arange(len(words.first))
    out = np.full(bounds[-1], END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = words.hash
    return out, bounds


@keeping_memory
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in text_slices(batches):
        terms, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(terms), pa.array(n.astype(np.int64))], ["term", "n"])


@dataclass
class Vocabulary:
    """Totals of all training words, and the commonest of them by rank, END first."""

    total: int
    different: int
    terms: np.ndarray
    counts: np.ndarray
    head: int
    bounds: np.ndarray = field(init=False)
    by_term: np.ndarray = field(init=False)
    sorted_terms: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)
    begins: np.ndarray = field(init=False)
    most: int = field(init=False)

    def __post_init__(self) -> None:
        self.by_term = np.argsort(self.terms)
        self.sorted_terms = self.terms[self.by_term]
        bits = max(1, len(self.terms)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(self.sorted_terms >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begins, append=len(self.terms)).max())
        share = np.cumsum(self.counts[: self.head]) - self.counts[: self.head]
        of_class = share * CLASSES // max(1, int(self.counts[: self.head].sum()))
        self.bounds = np.append(np.flatnonzero(np.diff(of_class, prepend=-1)), self.head)

    @property
    def classes(self) -> int:
        """Classes of words, with the rare as the last one."""
        return len(self.bounds)

    def of_class(self) -> np.ndarray:
        """The class of each word of the head, and of the rare."""
        return np.append(np.repeat(np.arange(self.classes - 1), np.diff(self.bounds)), self.classes - 1)

    def rare(self) -> tuple[int, int]:
        """Words and different words beyond the head."""
        return self.total - int(self.counts[: self.head].sum()), self.different - self.head

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Ranks of terms, -1 for what the table does not hold."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        # Terms are hashes, so their first bits lead to the few that can be equal.
        at = np.take(self.begins, terms >> self.shift)
        rank = np.full(len(terms), -1)
        left = np.arange(len(terms))
        for _ in range(self.most):
            held = np.minimum(at, len(self.terms) - 1)
            equal = np.take(self.sorted_terms, held) == terms[left]
            rank[left[equal]] = np.take(self.by_term, held[equal])
            left, at = left[~equal], at[~equal] + 1
        return rank


def smoothed(count, total: int, different: int):
    """log10 of the share of words with a count, where all unseen words together have half a one."""
    return np.log10((count + 0.5) / (total + 0.5 * (different + 1)))


def read_vocabulary(counts: DataFrame, head: int = HEAD, table: int = TABLE) -> Vocabulary:
    """Totals and the ``table`` commonest words of a written table (term, n)."""
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different")).first()
    end = int(END.view(np.int64))
    top = counts.filter(F.col("term") != end).orderBy(F.desc("n"), "term").limit(table).toArrow()
    ends = counts.filter(F.col("term") == end).agg(F.sum("n")).first()[0]
    terms, n = top.column("term").to_numpy().view(np.uint64), top.column("n").to_numpy()
    if ends is not None:
        terms, n = np.concatenate([[END], terms]), np.concatenate([[ends], n])
    return Vocabulary(whole["total"] or 0, whole["different"], terms, n, min(head, len(terms)))


ENCODED = "row long, doc_id {}, held_out boolean, n_tokens long, n_known long, base double, rare double, ids binary, terms array<long>, times array<int>"


def _encode(vocabulary: Vocabulary) -> Callable:
    """Texts as ranks, with sums over the words of the table and the other words with their number."""
    head, (rare, rare_kinds) = vocabulary.head, vocabulary.rare()
    base_of = smoothed(vocabulary.counts, vocabulary.total, vocabulary.different)
    rare_of = smoothed(vocabulary.counts, rare, rare_kinds)
    rare_of[:head] = 0.0

    @keeping_memory
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch, data, offsets in text_slices(batches):
            tokens, bounds = _tokens(data, offsets)
            n, texts = np.diff(bounds), np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            ranks = vocabulary.ranks(tokens)
            inside = ranks >= 0
            sums = [np.bincount(texts[inside], of[ranks[inside]], batch.num_rows).astype(np.float64) for of in (base_of, rare_of)]
            ids = np.where(inside & (ranks < head), ranks, head).astype(np.uint16)
            known = np.bincount(texts[inside], minlength=batch.num_rows)
            other, of_text = tokens[~inside], texts[~inside]
            order = np.lexsort((other, of_text))
            other, of_text = other[order], of_text[order]
            fresh = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (of_text[1:] != of_text[:-1])])) if len(other) else np.zeros(0, dtype=np.int64)
            times = np.diff(fresh, append=len(other)).astype(np.int32)
            at = pa.array(np.searchsorted(of_text[fresh], np.arange(batch.num_rows + 1)).astype(np.int32))
            cut = pa.array((2 * bounds).astype(np.int64))
            columns = [
                pa.array(row + np.arange(batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                *[pa.array(s, pa.float64()) for s in sums], pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, cut.buffers()[1], pa.py_buffer(ids.tobytes())]).cast(pa.binary()),
                pa.ListArray.from_arrays(at, signed(other[fresh])), pa.ListArray.from_arrays(at, pa.array(times)),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "ids", "terms", "times"])

    return encode


class Network:
    """Weights in one flat vector: inputs, recurrence, classes, words, and what Adagrad has summed."""

    def __init__(self, bounds: np.ndarray, of_class: np.ndarray, hidden: int, values: np.ndarray | None = None) -> None:
        self.bounds, self.of_class, self.hidden = bounds, of_class, hidden
        words, classes = len(of_class), len(bounds)
        shapes = {
            "x": (words, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (classes, hidden), "bc": (classes,), "wo": (words, hidden), "bo": (words,),
            "gx": (words, 1), "gu": (hidden, 3 * hidden), "gwc": (classes, hidden), "gbc": (classes,), "gwo": (words, 1), "gbo": (words,),
        }
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.values = np.zeros(sum(sizes), dtype=np.float32) if values is None else values
        for (name, shape), part in zip(shapes.items(), np.split(self.values, np.cumsum(sizes)[:-1])):
            setattr(self, name, part.reshape(shape))

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 1) -> Network:
        """A network that predicts the smoothed shares of words whatever its state."""
        out, draw = cls(vocabulary.bounds, vocabulary.of_class(), hidden), np.random.default_rng(seed)
        out.x[:] = draw.normal(0, 0.6, out.x.shape)
        out.u[:] = draw.normal(0, hidden**-0.5, out.u.shape)
        counts = np.append(vocabulary.counts[: vocabulary.head], vocabulary.rare()[0]) + 0.5
        of_class = np.bincount(out.of_class, counts)
        out.bo[:] = np.log(counts / (of_class / np.bincount(out.of_class))[out.of_class])
        out.bc[:] = np.log(of_class / of_class.sum())
        return out

    def run(self, ids: np.ndarray, keep: np.ndarray, state: np.ndarray, memory: list | None = None) -> np.ndarray:
        """States before each step of a window (steps, lanes); ``state`` goes on, ``keep`` is 0 where a text begins.

        Inside, lanes come last, so that each gate is one run of memory.
        """
        h, (steps, lanes) = self.hidden, ids.shape
        before = np.empty((steps, h, lanes), dtype=np.float32)
        inputs, u, after = np.ascontiguousarray(np.take(self.x, ids, axis=0, mode="clip").transpose(0, 2, 1)), np.ascontiguousarray(self.u.T), np.ascontiguousarray(state.T)
        for t in range(steps):
            now = np.multiply(after, keep[t], out=before[t])
            pulled = u @ now
            gates = inputs[t, : 2 * h] + pulled[: 2 * h]
            np.exp(np.negative(gates, out=gates), out=gates)
            gates += 1.0
            np.reciprocal(gates, out=gates)
            new = gates[h:] * pulled[2 * h :]
            new += inputs[t, 2 * h :]
            np.tanh(new, out=new)
            after = now - new
            after *= gates[:h]
            after += new
            if memory is not None:
                memory.append((gates, new, pulled[2 * h :]))
        state[:] = after.T
        return before.transpose(0, 2, 1)

    def predict(self, states: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural logarithms of the probability of each word after its state; gradients of their sum, negated, into ``grads``."""
        kinds, h = self.of_class[ids], self.hidden
        safe, ones, rows = self._safe(), np.ones(max(len(self.bounds), len(self.of_class), len(ids)), dtype=np.float32), np.arange(len(ids))
        # With a last column of ones, shifts are part of the products.
        order = np.argsort(kinds.astype(np.uint8 if len(self.bounds) < 256 else np.int64), kind="stable")
        kinds, ids, states = kinds[order], ids[order], np.column_stack([states[order], ones[: len(ids)]])

        def one(mine: np.ndarray, weights: np.ndarray, plain: np.ndarray, own: np.ndarray, of_weights: np.ndarray | None):
            """Logarithms of the probability of each state's own row of the weights, and gradients."""
            scores, own = mine @ weights.T, rows[: len(mine)] * len(weights) + own
            total, flat = self._exponentials(scores, safe, ones), scores.reshape(-1)
            chosen = np.take(flat, own)
            logs = np.log(chosen / total)
            if of_weights is None:
                return logs, None
            flat[own] = chosen - total
            share = (1.0 / total)[:, None]
            np.matmul(scores.T, mine * share, out=of_weights)
            return logs, (scores @ plain) * share

        classes, words = np.column_stack([self.wc, self.bc]), np.column_stack([self.wo, self.bo])
        of_classes, of_words = (None, None) if grads is None else (np.empty_like(classes), np.zeros_like(words))
        logs, back = one(states, classes, self.wc, kinds, of_classes)
        edges, bounds = np.searchsorted(kinds, np.arange(len(self.bounds) + 1)).tolist(), self.bounds.tolist()
        for a, b, i, j in zip(bounds, bounds[1:], edges, edges[1:]):
            if b - a < 2 or i == j:
                continue
            inner, of_states = one(states[i:j], words[a:b], self.wo[a:b], ids[i:j] - a, None if grads is None else of_words[a:b])
            logs[i:j] += inner
            if grads is not None:
                back[i:j] += of_states
        out = np.empty(len(ids), dtype=np.float32)
        out[order] = logs
        if grads is not None:
            grads["wc"], grads["bc"], grads["wo"], grads["bo"] = of_classes[:, :h], of_classes[:, h], of_words[:, :h], of_words[:, h]
            grads["states"] = np.empty_like(back)
            grads["states"][order] = back
        return out

    def _safe(self) -> bool:
        """Whether no score can leave single precision: states lie in (-1, 1), so the weights bound them."""
        return max(float((np.abs(w) @ np.ones(self.hidden, dtype=np.float32) + np.abs(shift)).max()) for w, shift in ((self.wc, self.bc), (self.wo, self.bo))) < SAFE

    @staticmethod
    def _exponentials(scores: np.ndarray, safe: bool, ones: np.ndarray) -> np.ndarray:
        """Exponentiate scores in place and return their sums."""
        if not safe:
            # The least probability keeps a logarithm.
            scores -= scores.max(axis=1, keepdims=True)
            np.maximum(scores, -SAFE, out=scores)
        np.exp(scores, out=scores)
        return scores @ ones[: scores.shape[1]]

    def backward(self, ids: np.ndarray, keep: np.ndarray, before: np.ndarray, memory: list, grads: dict, back: np.ndarray) -> None:
        """Carry errors of the states back through a window, into the gradients of inputs and recurrence."""
        h, (steps, lanes) = self.hidden, ids.shape
        pulls, inputs = np.empty((steps, 3 * h, lanes), dtype=np.float32), np.empty((steps, 3 * h, lanes), dtype=np.float32)
        before, back = (np.ascontiguousarray(x.transpose(0, 2, 1)) for x in (before, back))
        error = np.zeros((h, lanes), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            gates, new, pulled = memory[t]
            z, r, mine, pull = gates[:h], gates[h:], inputs[t], pulls[t]
            kept = error * z
            error -= kept
            np.multiply(error, 1 - new * new, out=mine[2 * h :])
            np.multiply((before[t] - new) * kept, 1 - z, out=mine[:h])
            np.multiply(mine[2 * h :], r, out=pull[2 * h :])
            np.multiply(pull[2 * h :] * pulled, 1 - r, out=mine[h : 2 * h])
            pull[: 2 * h] = mine[: 2 * h]
            error = self.u @ pull
            error += kept
            error += back[t]
            error *= keep[t]
        grads["u"] = (before @ pulls.transpose(0, 2, 1)).sum(axis=0)
        inputs = inputs.transpose(0, 2, 1)
        flat = ids.ravel()
        order = np.argsort(flat.astype(np.uint16 if len(self.of_class) <= 1 << 16 else np.int64), kind="stable")
        starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        # As complex numbers, two are added at once.
        pair = np.float32 if h % 2 else np.complex64
        sums = np.add.reduceat(np.take(inputs.reshape(-1, 3 * h), order, axis=0).view(pair), starts, axis=0)
        grads["rows"], grads["x"] = flat[order[starts]], sums.view(np.float32)

    def step(self, ids: np.ndarray, keep: np.ndarray, live: np.ndarray, state: np.ndarray, rate: float) -> None:
        """One update on a window; ``live`` marks the steps of lanes that have not run out."""
        memory, grads = [], {}
        before = self.run(ids, keep, state, memory)
        if live.all():
            self.predict(before.reshape(-1, self.hidden), ids.ravel(), grads)
            back = grads.pop("states").reshape(before.shape)
        else:
            self.predict(before[live], ids[live], grads)
            back = np.zeros(before.shape, dtype=np.float32)
            back[live] = grads.pop("states")
        self.backward(ids, keep, before, memory, grads, back)
        n, rows = np.float32(live.sum()), grads.pop("rows")
        for name in ("u", "wc", "bc", "bo"):
            g, seen = grads[name] / n, getattr(self, f"g{name}")
            seen += g * g
            getattr(self, name)[...] -= rate * g / np.sqrt(seen + 1e-12)
        g = grads["x"] / n
        self.gx[rows] += np.einsum("ij,ij->i", g, g)[:, None] / g.shape[1]
        self.x[rows] -= g * (rate / np.sqrt(self.gx[rows] + 1e-12))
        g = grads["wo"] / n
        self.gwo += np.einsum("ij,ij->i", g, g)[:, None] / g.shape[1]
        self.wo -= g * (rate / np.sqrt(self.gwo + 1e-12))


def in_lanes(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane, first step) of each text: the longest first, each into the lane that is free first."""
    lanes = min(lanes, len(lengths))
    lane, first = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    order, filled = np.argsort(-lengths, kind="stable"), np.zeros(lanes, dtype=np.int64)
    for i in range(0, len(order), lanes):
        some = order[i : i + lanes]
        free = np.argsort(filled, kind="stable")[: len(some)]
        lane[some], first[some] = free, filled[free]
        filled[free] += lengths[some]
    place = np.empty(lanes, dtype=np.int64)
    place[np.argsort(-filled, kind="stable")] = np.arange(lanes)
    return place[lane], first


def windows(texts: list[np.ndarray], width: int, lanes: int):
    """(ids, keep, live, owner) of the windows of texts laid in lanes, longest lane first; lanes that ran out leave."""
    lengths = np.array([len(t) for t in texts])
    lane, first = in_lanes(lengths, lanes)
    steps = int((first + lengths).max())
    n = int(lane.max()) + 1
    ids, owner = np.zeros((n, steps), dtype=np.int64), np.full((n, steps), -1, dtype=np.int32)
    keep = np.ones((n, steps), dtype=np.float32)
    for i, text in enumerate(texts):
        ids[lane[i], first[i] : first[i] + len(text)] = text
        owner[lane[i], first[i] : first[i] + len(text)] = i
        keep[lane[i], first[i]] = 0.0
    for s in range(0, steps, width):
        here = int((owner[:, s] >= 0).sum())
        part = owner[:here, s : s + width].T
        yield ids[:here, s : s + width].T, keep[:here, s : s + width].T, part >= 0, part


def _gathered(batches: Iterator[pa.RecordBatch], limit: int):
    """(other columns' rows, texts as ranks) of about ``limit`` words at a time."""
    rows, texts, n = [], [], 0
    for batch in batches:
        for row, ids in zip(batch.column(0).to_pylist(), batch.column("ids")):
            text = np.frombuffer(ids.as_buffer(), dtype=np.uint16)
            rows.append(row)
            texts.append(text.copy())
            n += len(text)
            if n >= limit:
                yield rows, texts
                rows, texts, n = [], [], 0
    if rows:
        yield rows, texts


def _fit(network, settings: dict) -> Callable:
    @keeping_memory
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, of_class, hidden, values = network.value
        own, read = Network(bounds, of_class, hidden, values.copy()), 0
        for _, texts in _gathered(batches, settings["words"]):
            state, words = None, sum(map(len, texts))
            lanes = max(1, min(settings["lanes"], words // (settings["window"] * UPDATES)))
            for ids, keep, live, _ in windows(texts, settings["window"], lanes):
                state = np.zeros((ids.shape[1], hidden), dtype=np.float32) if state is None else state[: ids.shape[1]]
                own.step(ids, keep, live, state, settings["rate"])
                read += int(live.sum())
        if read:
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([read]), pa.array([own.values.tobytes()], pa.binary())], ["part", "read", "weights"])

    return fit


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of weights, each times the words it has read."""
    total, read = None, 0
    for batch in batches:
        for n, weights in zip(batch.column("read").to_pylist(), batch.column("weights")):
            now = np.frombuffer(weights.as_buffer(), dtype=np.float32).astype(np.float64) * n
            total, read = now if total is None else total + now, read + n
    if read:
        yield pa.RecordBatch.from_arrays([pa.array([read]), pa.array([(total / read).astype(np.float32).tobytes()], pa.binary())], ["read", "weights"])


def fit_network(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, hidden: int = HIDDEN, **settings) -> Network:
    """Fit on all texts of a written encoded table, a share of them in each round.

    The driver holds one set of weights and adds at most ``GROUPS`` others; their
    size is set by ``HEAD`` and ``hidden`` alone.
    """
    settings = {"window": WINDOW, "lanes": LANES, "words": WORDS_AT_ONCE, "rate": RATE} | settings
    network, spark = Network.fresh(vocabulary, hidden), encoded.sparkSession
    share = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(rounds))
    for i in range(rounds):
        sent = spark.sparkContext.broadcast((network.bounds, network.of_class, hidden, network.values))
        fitted = encoded.filter(share == i).select("row", "ids").mapInArrow(_fit(sent, settings), "part long, read long, weights binary")
        added = fitted.repartition(GROUPS, "part").mapInArrow(_add, "read long, weights binary")
        total, read = None, 0
        for part in added.toLocalIterator():
            now = np.frombuffer(part["weights"], dtype=np.float32).astype(np.float64) * part["read"]
            total, read = now if total is None else total + now, read + part["read"]
        if read:
            network = Network(network.bounds, network.of_class, hidden, (total / read).astype(np.float32))
        sent.destroy()
    return network


def _likelihoods(network, settings: dict) -> Callable:
    @keeping_memory
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, of_class, hidden, values = network.value
        own = Network(bounds, of_class, hidden, values)
        for rows, texts in _gathered(batches, settings["words"]):
            sums, state = np.zeros(len(texts)), None
            for ids, keep, live, owner in windows(texts, settings["window"], settings["lanes"]):
                state = np.zeros((ids.shape[1], hidden), dtype=np.float32) if state is None else state[: ids.shape[1]]
                before = own.run(ids, keep, state)
                sums += np.bincount(owner[live], own.predict(before[live], ids[live]).astype(np.float64), len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sums / LN10)], ["row", "logp"])

    return score


def score_texts(docs: DataFrame, learn: Column | None = None, **settings) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    A-Z are lower-cased; tokens are the words between white space and one end.
    ``base_score`` is the smoothed unigram, ``score`` the network's log10
    probability of the whole text, both sums over all tokens. ``learn`` is true
    for rows to learn from (default: those not held out). A null or empty text is
    its end alone; repeated rows are scored, and learned from, each for itself;
    a text of any length is one task's, with a state of fixed size; other columns
    are left out; an empty table gives none, and without a row to learn from every
    token has probability one. Words are told apart by 64-bit hashes.
    """
    learn = ~held_out() if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select("doc_id", (~learn).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = rows.filter(~F.col("held_out")).select("text").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = materialised(counts, "counts")
    vocabulary = read_vocabulary(counts, settings.pop("head", HEAD), settings.pop("table", TABLE))
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = materialised(rows.mapInArrow(_encode(vocabulary), ENCODED.format(kind)), "encoded")
    network = fit_network(encoded.filter(~F.col("held_out")), vocabulary, **settings)

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((network.bounds, network.of_class, network.hidden, network.values))
    # Only states are kept from step to step here, so windows and lanes are as wide as memory likes.
    settings = {"words": settings.get("words", WORDS_AT_ONCE), "window": 2 * settings.get("window", WINDOW), "lanes": settings.get("lanes", LANES)}
    likelihoods = encoded.select("row", "ids").mapInArrow(_likelihoods(sent, settings), "row long, logp double")
    others = encoded.select("row", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.times").alias("times"))
    others = others.join(counts, "term", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.sum("times").alias("others"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known")
    )
    out = encoded.drop("ids", "terms", "times").join(likelihoods, "row").join(others, "row", "left")
    rare, rare_kinds = vocabulary.rare()
    part = lambda total, kinds: F.coalesce(F.col("logs") - F.col("others") * float(np.log10(total + 0.5 * (kinds + 1))), F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + part(vocabulary.total, vocabulary.different)).alias("base_score"), (F.col("logp") + F.col("rare") + part(rare, rare_kinds)).alias("score"),
    )
