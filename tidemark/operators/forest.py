"""Random forests without a limit of depth, grown where the rows are and finished inside tasks.

Rows keep one byte for each feature, its bin. Draws of rows and features are
hashes of a row's key, its tree and the way to a node, and counts are whole
numbers, so the trees depend neither on the partitioning nor on who grows them.

Where a task can hold the bins of all training rows, every task gets them once
and grows its share of the trees. Of a larger table only nodes with more rows
than that are split by sums that tasks add over their blocks, some nodes at a
time; then the rows of each smaller node meet in one task, which finishes it.
Rows to be scored go the same ways; only sums of votes come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.boosting import BINS, _mix
from tidemark.session import materialised

#: Bytes of bins that a task may hold; a node with more rows than fit is split by all tasks.
TASK_BYTES = 1 << 28
#: Rows of a block.
BLOCK_ROWS = 1 << 12
#: Rows that are looked at together.
CHUNK = 1 << 13
#: Bytes of sums that a task adds at a time.
SUM_BYTES = 1 << 27
#: A vote of one tree.
ONE = 1 << 32
# Chances of being drawn at most 0, 1, 2, ... times in as many draws as there are rows.
DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 20.0)]))
GOLD = np.uint64(0x9E3779B97F4A7C15)


def times_drawn(key: np.ndarray, path: np.uint64) -> np.ndarray:
    """How often rows are drawn for the tree whose root has this path."""
    return np.searchsorted(DRAWN, (_mix(key ^ path) >> np.uint64(11)) * 2.0**-53, "right").astype(np.int64)


def roots(trees: int, seed: int) -> np.ndarray:
    """The path of every tree's root."""
    return _mix(_mix(np.arange(1, trees + 1, dtype=np.uint64) * GOLD) ^ np.uint64(seed))


def children(path: np.ndarray) -> np.ndarray:
    """Paths of the left and right child of every node, side by side."""
    return _mix(path[:, None] ^ _mix(np.arange(1, 3, dtype=np.uint64) * GOLD)).ravel()


def drawn_features(path: np.ndarray, features: int, k: int) -> np.ndarray:
    """(nodes, k) different features of each node: the first steps of a shuffle."""
    deck = np.tile(np.arange(features, dtype=np.int32), (len(path), 1))
    step = np.arange(k, dtype=np.uint64)
    high = _mix(path[:, None] + (step + np.uint64(1)) * GOLD) >> np.uint64(32)
    swapped = (step + (high * (np.uint64(features) - step) >> np.uint64(32))).astype(np.int64)
    flat, start = deck.reshape(-1), np.arange(len(path)) * features
    for j in range(k):
        at = start + swapped[:, j]
        there = flat[at]
        flat[at] = deck[:, j]
        deck[:, j] = there
    return deck[:, :k].astype(np.int64)


def heads(a: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=out[1:])
    return out


def best_cuts(cell: np.ndarray, counts: np.ndarray, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The drawn feature and last bin on the left of each node's purest split; -1 where all rows are alike.

    ``cell`` is ``(node * k + place of the feature) * BINS + bin``, ascending, without the
    empty cells and those of bin 0; ``counts`` (classes, cells), ``total`` (classes, nodes).
    Of equal splits the one of the feature drawn first, at its lowest bin, is taken.
    """
    place, cut = np.full(total.shape[1], -1), np.zeros(total.shape[1], np.int64)
    if not len(cell):
        return place, cut
    group, bins = cell // BINS, cell % BINS
    node = group // k
    first = heads(group)
    starts, mine = np.flatnonzero(first), np.cumsum(first) - 1
    n_left, n_right, left_squares, right_squares = 0, 0, 0.0, 0.0
    for count, whole in zip(counts, total):
        before = np.cumsum(count) - count
        rest = whole[node[starts]] - np.add.reduceat(count, starts)
        left = (rest - before[starts])[mine] + before
        right = whole[node] - left
        n_left, n_right = n_left + left, n_right + right
        left_squares, right_squares = left_squares + left.astype(float) * left, right_squares + right.astype(float) * right
    pure = np.where(n_left > 0, left_squares / np.maximum(n_left, 1) + right_squares / n_right, -1.0)
    head = np.flatnonzero(heads(node))
    best = np.repeat(np.maximum.reduceat(pure, head), np.diff(head, append=len(node)))
    hit = np.flatnonzero((pure == best) & (pure >= 0))
    hit = hit[heads(node[hit])]
    place[node[hit]] = group[hit] % k
    cut[node[hit]] = (np.where(first[hit], 0, bins[hit - 1]) + bins[hit]) // 2
    return place, cut


def cells_by_sorting(seen: np.ndarray, node: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of rows (rows, k) of many small nodes."""
    k = seen.shape[1]
    seen = seen.ravel()
    at = np.flatnonzero(seen != 0)
    row = at // k
    # Node and feature, bin, class, times drawn; a draw is of less than 2^16, there are less than 2^8 classes.
    key = ((node * k) << 32 | y << 16 | weight)[row] + ((at - row * k) << 32) + (seen[at].astype(np.int64) << 24)
    key.sort()
    cell = key >> 24
    first = np.flatnonzero(heads(cell))
    drawn, label = key & 0xFFFF, key >> 16 & 0xFF
    sums = [np.add.reduceat(drawn * (label == c), first) if len(first) else first for c in range(classes)]
    return cell[first], np.stack(sums)


def node_sums(seen: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    """(k, bins, classes) sums of the rows of one node."""
    k = seen.shape[1]
    cell = (seen.astype(np.int64) + np.arange(k) * BINS) * classes + y[:, None]
    return np.bincount(cell.ravel(), np.repeat(weight, k), k * BINS * classes).astype(np.int64).reshape(k, BINS, classes)


def filled_sums(seen: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    """``node_sums`` without those of bin 0, which most values of sparse rows are in."""
    k = seen.shape[1]
    seen = seen.ravel()
    at = np.flatnonzero(seen != 0)
    row = at // k
    cell = ((at - row * k) * BINS + seen[at]) * classes + y[row]
    return np.bincount(cell, weight[row], k * BINS * classes).astype(np.int64).reshape(k, BINS, classes)


def cells_of_sums(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = sums.reshape(-1, sums.shape[2])
    cell = np.flatnonzero(flat.any(axis=1) & (np.arange(len(flat)) % BINS > 0))
    return cell, flat[cell].T


def drawn_among(path: np.ndarray, varied: np.ndarray) -> np.ndarray:
    """One feature of each node (nodes, features) that is not the same in all its rows; -1 where there is none."""
    n = varied.sum(axis=1)
    pick = (_mix(~path) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)
    return np.where(n > 0, (np.cumsum(varied, axis=1) <= pick[:, None]).sum(axis=1), -1)


@dataclass
class Level:
    """Nodes side by side with their rows, node after node, and what is known of these."""

    bins: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    classes: int
    row: np.ndarray
    size: np.ndarray
    path: np.ndarray

    def take(self, a: int, b: int, ends: np.ndarray) -> Level:
        first = ends[a - 1] if a else 0
        return Level(self.bins, self.y, self.weight, self.classes, self.row[first : ends[b - 1]], self.size[a:b], self.path[a:b])

    def only(self, which: np.ndarray) -> Level:
        return Level(self.bins, self.y, self.weight, self.classes, self.row[np.repeat(which, self.size)], self.size[which], self.path[which])

    def total(self) -> np.ndarray:
        """(classes, nodes) times drawn."""
        cell = np.repeat(np.arange(len(self.size)), self.size) + self.y[self.row] * len(self.size)
        return np.bincount(cell, self.weight[self.row], self.classes * len(self.size)).astype(np.int64).reshape(self.classes, -1)

    def cuts(self, feature: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of the features (nodes, k) of each node and its cut; -1 if none tells the rows apart."""
        (n, k), width, flat = feature.shape, self.bins.shape[1], self.bins.ravel()
        if len(self.row) > CHUNK:
            parts = [self.row[i : i + CHUNK] for i in range(0, len(self.row), CHUNK)]
            sums = sum(filled_sums(flat.take((r * width)[:, None] + feature), self.y[r], self.weight[r], self.classes) for r in parts)
            cells = cells_of_sums(sums)
        else:
            node = np.repeat(np.arange(n), self.size)
            at = feature.take(node, axis=0)
            at += (self.row * width)[:, None]
            seen = flat.take(at)
            cells = cells_by_sorting(seen, node, self.y[self.row], self.weight[self.row], self.classes)
        place, cut = best_cuts(*cells, total, k)
        return np.where(place >= 0, feature[np.arange(n), np.maximum(place, 0)], -1), cut

    def varied(self) -> np.ndarray:
        """(nodes, features) whether not all rows have the same bin."""
        first = np.r_[0, np.cumsum(self.size)[:-1]]
        out = np.zeros((len(self.size), self.bins.shape[1]), bool)
        node = np.repeat(np.arange(len(self.size)), self.size)
        for i in range(0, len(self.row), CHUNK):
            here = node[i : i + CHUNK]
            differs = self.bins[self.row[i : i + CHUNK]] != self.bins[self.row[first[here]]]
            head = np.flatnonzero(heads(here))
            out[here[head]] |= np.logical_or.reduceat(differs, head, axis=0)
        return out

    def splits(self, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature and cut of every node; -1 where all rows are alike.

        If none of the features drawn tells rows apart, one is drawn of those that do.
        """
        feature, cut = self.cuts(drawn_features(self.path, self.bins.shape[1], k), total)
        alike = feature < 0
        if alike.any():
            left = self.only(alike)
            one = drawn_among(left.path, left.varied())
            again = np.flatnonzero(alike)[one >= 0]
            if len(again):
                feature[again], cut[again] = left.only(one >= 0).cuts(one[one >= 0][:, None], total[:, again])
        return feature, cut


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 at leaves), last bin on the left, left child (the right one is next), votes (nodes, classes)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    votes: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(bins), np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            here = at[live]
            at[live] = self.left[here] + (bins[live, self.feature[here]] > self.cut[here])
            live = live[self.feature[at[live]] >= 0]
        return at


def votes_of(total: np.ndarray) -> np.ndarray:
    """(nodes, classes) shares of the classes as whole numbers."""
    return np.rint(total.T / np.maximum(total.sum(axis=0), 1)[:, None] * ONE).astype(np.int64)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, path: np.uint64, classes: int, k: int) -> Tree:
    """The tree below a node, down to nodes of one class or of equal rows."""
    row = np.flatnonzero(weight)
    now = Level(bins, y, weight, classes, row, np.array([len(row)]), np.array([path], np.uint64))
    done: list[tuple] = []
    nodes = 1
    while len(now.size):
        total = now.total()
        feature, cut = np.full(len(now.size), -1), np.zeros(len(now.size), np.int64)
        # Rows of pure nodes are let go at once.
        mixed = (total > 0).sum(axis=0) > 1
        open_nodes = np.flatnonzero(mixed)
        live = now.only(mixed)
        ends = np.cumsum(live.size)
        a = 0
        while a < len(open_nodes):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
            at = open_nodes[a:b]
            feature[at], cut[at] = live.take(a, b, ends).splits(total[:, at], k)
            a = b
        split = feature >= 0
        left = np.where(split, nodes + 2 * (np.cumsum(split) - 1), -1)
        done.append((feature, cut, left, votes_of(total)))
        nodes += 2 * int(split.sum())
        kept = split[mixed]
        row, size = live.row[np.repeat(kept, live.size)], live.size[kept]
        node = np.repeat(np.arange(len(size)), size)
        right = bins[row, feature[split][node]] > cut[split][node]
        # Left rows of a node before its right ones, both in their order.
        n_right = np.bincount(node, right, len(size)).astype(np.int64)
        start = np.cumsum(size) - size
        before = np.cumsum(right) - right
        before -= before[start][node] if len(size) else 0
        at = np.where(right, start[node] + (size - n_right)[node] + before, np.arange(len(row)) - before)
        moved = np.empty_like(row)
        moved[at] = row
        now = Level(bins, y, weight, classes, moved, np.stack([size - n_right, n_right], axis=1).ravel(), children(now.path[split]))
    return Tree(*[np.concatenate(c) for c in zip(*done)])


# Rows and their bins


def bin_edges(entries: DataFrame, features: int) -> list[np.ndarray]:
    """For each feature 0 and the quantiles of its other training values (feature, value), exact, all different.

    A value belongs to the bin of the first edge it does not exceed.
    """
    own = Window.partitionBy("feature")
    ranked = entries.filter("value <> 0 AND NOT isnan(value)").select(
        "feature", "value", F.row_number().over(own.orderBy("value")).alias("r"), F.count(F.lit(1)).over(own).alias("n")
    )
    # The last value of each of as many equal runs as there are edges left.
    at = lambda r: F.floor(r * (BINS - 2) / F.col("n"))
    edges = [[0.0] for _ in range(features)]
    for r in ranked.filter(at(F.col("r")) > at(F.col("r") - 1)).select("feature", "value").distinct().collect():
        edges[r["feature"]].append(r["value"])
    return [np.unique(np.array(e)) for e in edges]


BLOCK = "test boolean, bins binary, y binary, key binary, id binary"


def _block(test: bool, bins: np.ndarray, y: np.ndarray, key: np.ndarray, row_id: np.ndarray, **more: int) -> pa.RecordBatch:
    columns = {**{c: pa.array([v]) for c, v in more.items()}, "test": pa.array([test])}
    for name, values in (("bins", bins), ("y", y), ("key", key), ("id", row_id)):
        columns[name] = pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _read(row: dict, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, classes, keys and ids of a block."""
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, features)
    return bins, np.frombuffer(row["y"], np.uint8), np.frombuffer(row["key"], np.uint64), np.frombuffer(row["id"], np.int64)


def _blocks(edges: list[np.ndarray]) -> Callable:
    """Map: rows (test, y, key, id, indices, values) to blocks of bins."""
    zero = np.array([np.searchsorted(e, 0.0, "left") for e in edges], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                test, y, key, row_id = [part.column(j).to_numpy(zero_copy_only=False) for j in range(4)]
                indices, values = part.column(4), part.column(5)
                row = np.repeat(np.arange(part.num_rows), np.diff(indices.offsets.to_numpy()))
                feature, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
                order = np.argsort(feature, kind="stable")
                bounds = np.searchsorted(feature[order], np.arange(len(edges) + 1))
                bins = np.tile(zero, (part.num_rows, 1))
                for f in np.unique(feature):
                    mine = order[bounds[f] : bounds[f + 1]]
                    bins[row[mine], f] = np.searchsorted(edges[f], value[mine], "left")
                for which in (False, True):
                    mine = np.flatnonzero(test.astype(bool) == which)
                    if len(mine):
                        yield _block(which, bins[mine], y[mine].astype(np.uint8), key[mine].view(np.uint64), row_id[mine])

    return run


# Nodes with more rows than a task may hold


class Top:
    """The part of a tree that all tasks split together; ``state`` is open, wide (its draw failed), small or leaf."""

    def __init__(self, path: np.uint64, rows: int) -> None:
        self.feature, self.cut, self.left, self.path, self.state, self.rows, self.total = [-1], [0], [-1], [path], ["open"], [rows], [None]

    def tree(self) -> Tree:
        arrays = [np.array(a, np.int64) for a in (self.feature, self.cut, self.left)]
        return Tree(*arrays, np.zeros((len(self.feature), 0)))

    def split(self, node: int, feature: int, cut: int, left: list[int], right: list[int], small: int) -> None:
        self.feature[node], self.cut[node], self.left[node], self.state[node] = feature, cut, len(self.feature), "split"
        for path, total in zip(children(np.array([self.path[node]], np.uint64)), (left, right)):
            pure = sum(t > 0 for t in total) < 2
            for column, value in (("feature", -1), ("cut", 0), ("left", -1), ("path", path), ("rows", sum(total)), ("total", total)):
                getattr(self, column).append(value)
            self.state.append("leaf" if pure else "small" if sum(total) <= small else "open")


def _level(tops: dict[int, tuple[np.uint64, Tree]], wave: dict[tuple[int, int], np.ndarray], features: int, classes: int) -> Callable:
    """Map: training blocks to the sums of these nodes over their columns, added over a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for record in batch.to_pylist():
                bins, y, key, _ = _read(record, features)
                for tree, (root, top) in tops.items():
                    weight, at = times_drawn(key, root), top.leaves(bins)
                    for node in np.unique(at[weight > 0]).tolist():
                        if (tree, node) in wave:
                            mine = np.flatnonzero((at == node) & (weight > 0))
                            sums = node_sums(bins[mine][:, wave[tree, node]], y[mine], weight[mine], classes)
                            added[tree, node] = added[tree, node] + sums if (tree, node) in added else sums
        for (tree, node), sums in added.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree]), "node": pa.array([node]), "sums": pa.array([sums.tobytes()], pa.binary())})

    return run


def _choose(wave: dict[tuple[int, int], tuple[np.uint64, np.ndarray]], wide: set[tuple[int, int]], classes: int) -> Callable:
    """Map: sums that come sorted by (tree, node) to the chosen splits."""

    def done(at: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
        path, columns = wave[at]
        whole = sums[0].sum(axis=0)
        if at in wide:
            one = int(drawn_among(np.array([path], np.uint64), ((sums > 0).any(axis=2).sum(axis=1) > 1)[None])[0])
            keep = [one] if one >= 0 else []
            columns, sums = columns[keep], sums[keep]
        place, cut = best_cuts(*cells_of_sums(sums), whole[:, None], max(1, len(columns)))
        found = place[0] >= 0 and (whole > 0).sum() > 1
        left = sums[place[0], : cut[0] + 1].sum(axis=0) if found else whole
        values = (*at, int(columns[place[0]]) if found else -1, int(cut[0]))
        record = {n: pa.array([v]) for n, v in zip(("tree", "node", "feature", "cut"), values)}
        return pa.RecordBatch.from_pydict({**record, "left": pa.array([left.tolist()]), "right": pa.array([(whole - left).tolist()])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                at, sums = (r["tree"], r["node"]), np.frombuffer(r["sums"], np.int64).reshape(-1, BINS, classes)
                if at != now and now is not None:
                    yield done(now, total)
                now, total = at, sums if at != now else total + sums
        if now is not None:
            yield done(now, total)

    return run


def grow_tops(blocks: DataFrame, paths: np.ndarray, rows: int, small: int, features: int, classes: int, k: int) -> list[Top]:
    """All trees down to nodes whose rows are drawn at most ``small`` times."""
    tops = [Top(p, rows) for p in paths]
    train = blocks.filter("NOT test")
    while True:
        todo = [(t, n) for t, top in enumerate(tops) for n, s in enumerate(top.state) if s in ("open", "wide")]
        if not todo:
            return tops
        wave, wide, held = {}, set(), 0
        for t, n in todo:
            path = tops[t].path[n]
            if tops[t].state[n] == "wide":
                columns = np.arange(features)
                wide.add((t, n))
            else:
                columns = drawn_features(np.array([path], np.uint64), features, k)[0]
            held += len(columns) * BINS * classes * 8
            if wave and held > SUM_BYTES:
                wide.discard((t, n))
                break
            wave[t, n] = (path, columns)
        trees = {t: (paths[t], tops[t].tree()) for t in sorted({t for t, _ in wave})}
        sums = train.mapInArrow(_level(trees, {at: c for at, (_, c) in wave.items()}, features, classes), "tree long, node long, sums binary")
        chosen = sums.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(
            _choose(wave, wide, classes), "tree long, node long, feature long, cut long, left array<long>, right array<long>"
        )
        for r in chosen.collect():
            top, n = tops[r["tree"]], r["node"]
            if r["feature"] >= 0:
                top.split(n, r["feature"], r["cut"], r["left"], r["right"], small)
            else:
                pure = sum(t > 0 for t in r["left"]) < 2
                top.state[n], top.total[n] = "leaf" if pure or (r["tree"], n) in wide else "wide", r["left"]


def _deal(tops: list[Tree], paths: np.ndarray, slots: dict[tuple[int, int], int], features: int) -> Callable:
    """Map: blocks to the rows of each small node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                bins, y, key, row_id = _read(record, features)
                for tree, top in enumerate(tops):
                    at = top.leaves(bins)
                    there = np.ones(len(at), bool) if record["test"] else times_drawn(key, paths[tree]) > 0
                    for node in np.unique(at[there]).tolist():
                        if (tree, node) in slots:
                            mine = np.flatnonzero(there & (at == node))
                            yield _block(record["test"], bins[mine], y[mine], key[mine], row_id[mine], slot=slots[tree, node])

    return run


def _votes(row_id: np.ndarray, votes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array(row_id), **{f"v{c}": pa.array(votes[:, c]) for c in range(votes.shape[1])}})


def _leaf_votes(tops: list[Tree], leaves: list[dict[int, np.ndarray]], features: int, classes: int) -> Callable:
    """Map: blocks to be scored to the votes of the leaves that no task has to finish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                bins, _, _, row_id = _read(record, features)
                out = np.zeros((len(bins), classes), np.int64)
                for top, known in zip(tops, leaves):
                    at = top.leaves(bins)
                    for node, votes in known.items():
                        out[at == node] += votes
                yield _votes(row_id, out)

    return run


def _finish(work: dict[int, list[tuple[np.uint64, np.uint64]]], rows: dict[int, int], features: int, classes: int, k: int) -> Callable:
    """Map: blocks sorted by slot, training rows first, to the votes of the slot's trees, given by the paths of tree and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        slot, n, trees = None, 0, None

        def grown() -> list[Tree]:
            bins, y, key = (a[:n] for a in held)
            out = []
            for root, path in work[slot]:
                weight = times_drawn(key, root)
                # A tree that draws no row at all, as of a few it may, is grown from all of them.
                out.append(grow(bins, y, weight if weight.any() else weight + 1, path, classes, k))
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                (record,) = batch.slice(i, 1).to_pylist()
                if record["slot"] != slot:
                    if slot is not None and trees is None:
                        grown()
                    slot, n, trees = record["slot"], 0, None
                    held = [np.empty((rows[slot], features), np.uint8), np.empty(rows[slot], np.int64), np.empty(rows[slot], np.uint64)]
                bins, y, key, row_id = _read(record, features)
                if not record["test"]:
                    for whole, part in zip(held, (bins, y, key)):
                        whole[n : n + len(y)] = part
                    n += len(y)
                    continue
                trees = grown() if trees is None else trees
                yield _votes(row_id, sum(t.votes[t.leaves(bins)] for t in trees))
        if slot is not None and trees is None:
            grown()

    return run


def forest_scores(
    df: DataFrame, features: str, label: str, train: Column, keys: Sequence[str], n_features: int, n_classes: int = 2, trees: int = 300,
    n_drawn: int | None = None, seed: int = 42, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Rows outside ``train`` with ``score``, the mean shares of the classes over all trees, and ``prediction``.

    A forest of trees grown in full, without a limit of depth, on vectors: each
    from as many draws of training rows as there are, every node split by the
    least Gini impurity at ``n_drawn`` features, the square root of their number
    by default, or one more if these do not tell its rows apart. Labels are the
    classes 0, 1, ... Features are cut at up to 254 exact quantiles of their
    values other than 0. Of equal shares the first class is predicted. Training
    rows without a label or vector are left out; a row without a vector gets
    nulls. ``keys`` steer which rows are drawn. More than ``task_bytes`` of
    training rows, a byte a feature, are never sent to one task.
    """
    k = max(1, int(n_features**0.5)) if n_drawn is None else n_drawn
    spark = df.sparkSession
    is_train = F.coalesce(train, F.lit(False))
    rows = materialised(df.select("*", F.monotonically_increasing_id().alias("_id"), is_train.alias("_train")), "forest-rows")
    vector = F.unwrap_udt(features)
    sparse = rows.filter(F.col(features).isNotNull() & (~F.col("_train") | F.col(label).isNotNull())).select(
        (~F.col("_train")).alias("test"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"), F.xxhash64(*keys, label, F.lit(seed)).alias("key"), F.col("_id").alias("id"),
        F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1)).alias("indices"), vector["values"].alias("values"),
    )
    entries = sparse.filter("NOT test").select(F.explode(F.arrays_zip("indices", "values")).alias("e")).select(F.col("e.indices").alias("feature"), F.col("e.values").alias("value"))
    edges = bin_edges(entries, n_features)
    blocks = materialised(sparse.mapInArrow(_blocks(edges), BLOCK), "forest-blocks")
    n = blocks.filter("NOT test").agg(F.sum(F.length("y"))).first()[0]
    if not n:
        raise ValueError("no training row has a vector and a label")

    paths = roots(trees, seed)
    small = max(1, task_bytes // max(1, n_features))
    votes = ", ".join(f"v{c} long" for c in range(n_classes))
    if n <= small:
        # Every slot is a task that holds the training rows and grows its share of the trees.
        slots = min(trees, spark.sparkContext.defaultParallelism)
        work = {s: [(p, p) for p in paths[s::slots]] for s in range(slots)}
        sizes = dict.fromkeys(work, n)
        moved = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartitionById(slots, F.col("slot"))
        leaf_votes = None
    else:
        tops = grow_tops(blocks, paths, n, small, n_features, n_classes, k)
        arrays = [t.tree() for t in tops]
        nodes = [(t, i) for t, top in enumerate(tops) for i, s in enumerate(top.state) if s == "small"]
        slot = {at: s for s, at in enumerate(nodes)}
        work = {s: [(paths[t], tops[t].path[i])] for (t, i), s in slot.items()}
        sizes = {s: tops[t].rows[i] for (t, i), s in slot.items()}
        leaves = [{i: votes_of(np.array(top.total[i])[:, None])[0] for i, s in enumerate(top.state) if s == "leaf"} for top in tops]
        parts = max(1, min(len(slot), 4 * spark.sparkContext.defaultParallelism))
        moved = blocks.mapInArrow(_deal(arrays, paths, slot, n_features), f"slot long, {BLOCK}").repartitionById(parts, F.col("slot").cast("int"))
        leaf_votes = blocks.filter("test").mapInArrow(_leaf_votes(arrays, leaves, n_features, n_classes), f"id long, {votes}")
    given = moved.sortWithinPartitions("slot", "test").mapInArrow(_finish(work, sizes, n_features, n_classes, k), f"id long, {votes}")
    given = given if leaf_votes is None else given.unionByName(leaf_votes)
    summed = given.groupBy("id").agg(F.array(*[F.sum(f"v{c}") for c in range(n_classes)]).alias("_votes"))
    scored = rows.filter("NOT _train").join(summed.withColumnRenamed("id", "_id"), "_id", "left")
    return scored.withColumns({
        "score": F.transform("_votes", lambda v: v / F.lit(float(ONE) * trees)),
        "prediction": F.array_position("_votes", F.array_max("_votes")).cast("int") - 1,
    }).drop("_id", "_train", "_votes")
