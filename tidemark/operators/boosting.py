"""Boosted regression trees for many settings and folds at once, grown from level histograms.

Rows keep one byte for each feature, its bin. A level of all trees, of every
candidate on every fold, is grown together: tasks add gradients and counts by
(model, node, feature, bin) over their blocks of rows, the sums meet by model,
and only the chosen splits come back. Gradients are added as whole numbers, so
sums do not depend on how the rows are dealt out.

Where a table is so small that one task can hold its bins, every model is a task
that runs through its levels alone; the trees are the same.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import complete
from tidemark.operators.ordering import row_index
from tidemark.session import materialised

BINS = 256
#: Rows of a block, the unit of work for a level.
BLOCK_ROWS = 1 << 14
#: Rows up to which a task holds the whole table (a few bytes each) and fits a model alone.
TASK_ROWS = 1 << 18
#: Trees after which predictions are written; between, tasks add the newest trees themselves.
TREES_KEPT = 10

# The published space of the search.
SPACE = {
    "max_depth": [3, 4, 5, 6],
    "learning_rate": [0.01, 0.02, 0.03, 0.05, 0.08],
    "n_estimators": [200, 300, 400, 600],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
    "reg_lambda": [0.5, 1.0, 2.0, 5.0],
}


def draw_candidates(space: dict[str, Sequence], n: int, seed: int) -> list[dict]:
    """Random settings of the space, all different as far as it has so many."""
    draw, out = random.Random(seed), []
    size = int(np.prod([len(v) for v in space.values()]))
    while len(out) < min(n, size):
        one = {k: draw.choice(list(v)) for k, v in space.items()}
        if one not in out:
            out.append(one)
    return out


@dataclass
class Rows:
    """A block of rows: part in time, bins, target and a draw key; parts count from 0."""

    part: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    key: np.ndarray

    @classmethod
    def read(cls, row: dict, features: int) -> Rows:
        part = np.frombuffer(row["part"], np.uint8)
        return cls(part, np.frombuffer(row["bins"], np.uint8).reshape(len(part), features), np.frombuffer(row["y"], np.float64), np.frombuffer(row["key"], np.uint64))

    def take(self, keep: np.ndarray) -> Rows:
        return Rows(self.part[keep], self.bins[keep], self.y[keep], self.key[keep])


class Tree:
    """A tree as a heap: node i has the children 2i + 1 and 2i + 2; ``feature`` is -1 at leaves."""

    def __init__(self, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where rows stand after so many levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]), at)
        return at

    def split(self, node: int, choice: tuple, scale: float, settings: dict) -> None:
        """Set a split and the values of both sides."""
        feature, cut, left, n_left, right, n_right = choice
        if feature < 0:
            return
        self.feature[node], self.cut[node] = feature, cut
        for child, total, n in ((2 * node + 1, left, n_left), (2 * node + 2, right, n_right)):
            self.value[child] = -settings["learning_rate"] * total / scale / (n + settings["reg_lambda"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(key: np.ndarray, share: float, candidate: int, tree: int) -> np.ndarray:
    """Rows that a tree is grown from, by their key."""
    if share >= 1.0:
        return np.ones(len(key), bool)
    salt = _mix(np.array([candidate * 1_000_003 + tree + 1], np.uint64))
    return _mix(key ^ salt) < np.uint64(int(share * 2.0**64))


def columns_of(features: int, share: float, candidate: int, tree: int) -> np.ndarray:
    """Features that a tree may split on."""
    n = max(1, int(features * share))
    return np.sort(np.random.default_rng([candidate, tree]).permutation(features)[:n])


def cells_of(bins: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The cell of every row and feature within a node."""
    return bins[:, columns].astype(np.int64) + np.arange(len(columns)) * BINS


def level_sums(node: np.ndarray, nodes: int, cells: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """(2, nodes, features, bins): sums of gradients and rows."""
    k = cells.shape[1]
    cell = (cells + (node * (k * BINS))[:, None]).ravel()
    shape = (nodes, k, BINS)
    return np.stack([np.bincount(cell, np.repeat(gradient, k), nodes * k * BINS).reshape(shape), np.bincount(cell, minlength=nodes * k * BINS).reshape(shape)])


def best_splits(sums: np.ndarray, columns: np.ndarray, penalty: float) -> list[tuple]:
    """For each node (feature, last bin on the left, gradient and rows left, right); feature -1 where none gains."""
    total, n = sums[:, :, :1, :].sum(axis=3, keepdims=True)
    left, n_left = np.cumsum(sums, axis=3)
    right, n_right = total - left, n - n_left
    gain = left * left / (n_left + penalty) + right * right / (n_right + penalty) - total * total / (n + penalty)
    gain[(n_left == 0) | (n_right == 0)] = -1.0
    gain = gain.reshape(len(gain), -1)
    best = gain.argmax(axis=1)
    out = []
    for i, b in enumerate(best):
        j, cut = divmod(int(b), BINS)
        found = gain[i, b] > 0
        out.append((int(columns[j]) if found else -1, cut, left[i, j, cut], int(n_left[i, j, cut]), right[i, j, cut], int(n_right[i, j, cut])))
    return out


@dataclass
class Model:
    """A candidate on a fold: it learns from parts up to the fold and is tested on the next one."""

    number: int
    candidate: int
    fold: int
    settings: dict
    base: float
    scale: float

    def gradient(self, y: np.ndarray, prediction: np.ndarray) -> np.ndarray:
        """Gradients of the squared error as whole numbers."""
        return np.rint((prediction - y) * self.scale)


def fit_alone(rows: Rows, model: Model) -> tuple[float, int]:
    """Squared error and number of test rows after all trees."""
    s = model.settings
    rows = rows.take(rows.part <= model.fold + 1)
    train = np.flatnonzero(rows.part <= model.fold)
    prediction = np.full(len(rows.y), model.base)
    for t in range(s["n_estimators"]):
        tree = Tree(s["max_depth"])
        mine = train[drawn(rows.key[train], s["subsample"], model.candidate, t)]
        columns = columns_of(rows.bins.shape[1], s["colsample_bytree"], model.candidate, t)
        bins, gradient = rows.bins[mine], model.gradient(rows.y[mine], prediction[mine])
        cells, at, each = cells_of(bins, columns), np.zeros(len(mine), np.int64), np.arange(len(mine))
        for level in range(s["max_depth"]):
            first = 2**level - 1
            live = slice(None) if (at >= first).all() else at >= first
            if not len(at[live]):
                break
            for node, choice in enumerate(best_splits(level_sums(at[live] - first, first + 1, cells[live], gradient[live]), columns, s["reg_lambda"]), first):
                tree.split(node, choice, model.scale, s)
            f = tree.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[each, np.maximum(f, 0)] > tree.cut[at]), at)
        prediction += tree.value[tree.nodes(rows.bins, s["max_depth"])]
    test = rows.part == model.fold + 1
    return float(((rows.y[test] - prediction[test]) ** 2).sum()), int(test.sum())


BLOCK = "part binary, bins binary, y binary, key binary"


def _blocks(edges: list[np.ndarray], size: int) -> Callable:
    """Map: rows (part, key, y, features) to blocks of bins; a value goes to the bin of the first edge it does not exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["part", "bins", "y", "key"])

        held, n = [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bins = np.stack([np.searchsorted(e, c, "left").astype(np.uint8) for e, c in zip(edges, columns[3:])], axis=1)
            whole = [columns[0].astype(np.uint8), bins, columns[2].astype(np.float64), columns[1].view(np.uint64)]
            for a in range(0, len(bins), size):
                held.append([c[a : a + size] for c in whole])
                n += len(held[-1][0])
                if n >= size:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def _latest(models: list[Model], state: bytes | None, rows: Rows, pending: list[dict]) -> np.ndarray:
    """Predictions (models, rows) with the trees added that are newer than the written ones."""
    if state is None:
        out = np.repeat(np.array([m.base for m in models])[:, None], len(rows.y), axis=1)
    else:
        out = np.frombuffer(state, np.float64).reshape(len(models), len(rows.y)).copy()
    for trees in pending:
        for m in models:
            if m.number in trees:
                out[m.number] += trees[m.number].value[trees[m.number].nodes(rows.bins, m.settings["max_depth"])]
    return out


def _level(models: list[Model], features: int, pending: list[dict], growing: dict, t: int, level: int) -> Callable:
    """Map: blocks to the sums of this level's nodes, added over a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows.read(row, features)
                predictions = _latest(models, row["state"], rows, pending)
                for m in models:
                    if m.number not in growing:
                        continue
                    mine = np.flatnonzero((rows.part <= m.fold) & drawn(rows.key, m.settings["subsample"], m.candidate, t))
                    at = growing[m.number].nodes(rows.bins[mine], level)
                    live = at >= 2**level - 1
                    if not live.any():
                        continue
                    mine, at = mine[live], at[live]
                    columns = columns_of(features, m.settings["colsample_bytree"], m.candidate, t)
                    used, slot = np.unique(at, return_inverse=True)
                    sums = level_sums(slot, len(used), cells_of(rows.bins[mine], columns), m.gradient(rows.y[mine], predictions[m.number, mine]))
                    for i, node in enumerate(used.tolist()):
                        before = added.get((m.number, node))
                        added[m.number, node] = sums[:, i] if before is None else before + sums[:, i]
        if added:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(*key, v.tobytes()) for key, v in added.items()]), (pa.int64(), pa.int64(), pa.binary()))], ["model", "node", "sums"])

    return run


def _choose(models: list[Model], features: int, t: int) -> Callable:
    """Map: sums that come sorted by (model, node) to the chosen splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, sums: np.ndarray) -> pa.RecordBatch:
            m = models[key[0]]
            columns = columns_of(features, m.settings["colsample_bytree"], m.candidate, t)
            (choice,) = best_splits(sums[:, None], columns, m.settings["reg_lambda"])
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *choice)], ["model", "node", "feature", "cut", "left", "n_left", "right", "n_right"])

        now, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                key, sums = (row["model"], row["node"]), np.frombuffer(row["sums"], np.float64).reshape(2, -1, BINS)
                if key != now:
                    if now is not None:
                        yield done(now, total)
                    now, total = key, sums
                else:
                    total = total + sums
        if now is not None:
            yield done(now, total)

    return run


CHOICE = "model long, node long, feature long, cut long, left double, n_left long, right double, n_right long"


def _with_predictions(models: list[Model], features: int, pending: list[dict]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                state = _latest(models, row["state"], Rows.read(row, features), pending).tobytes()
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:4], pa.array([state], pa.binary())], [*batch.schema.names[:4], "state"])

    return run


def _errors(models: list[Model], features: int, pending: list[dict]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows.read(row, features)
                predictions = _latest(models, row["state"], rows, pending)
                tests = [rows.part == m.fold + 1 for m in models]
                sse = [float(((rows.y[x] - predictions[m.number, x]) ** 2).sum()) for m, x in zip(models, tests)]
                yield pa.RecordBatch.from_arrays([pa.array([m.number for m in models]), pa.array(sse), pa.array([int(x.sum()) for x in tests])], ["model", "sse", "n"])

    return run


def fit_by_levels(blocks: DataFrame, models: list[Model], features: int) -> DataFrame:
    """(model, sse, n) after all trees, each level one pass over the blocks for all models."""
    state, pending = materialised(blocks.withColumn("state", F.lit(None).cast("binary")), "boosting"), []
    for t in range(max(m.settings["n_estimators"] for m in models)):
        open_models = [m for m in models if t < m.settings["n_estimators"]]
        trees = {m.number: Tree(m.settings["max_depth"]) for m in open_models}
        for level in range(max(m.settings["max_depth"] for m in open_models)):
            growing = {m.number: trees[m.number] for m in open_models if level < m.settings["max_depth"]}
            sums = state.mapInArrow(_level(models, features, pending, growing, t, level), "model long, node long, sums binary")
            chosen = sums.repartition("model", "node").sortWithinPartitions("model", "node").mapInArrow(_choose(models, features, t), CHOICE)
            for r in chosen.collect():
                trees[r["model"]].split(r["node"], (r["feature"], r["cut"], r["left"], r["n_left"], r["right"], r["n_right"]), models[r["model"]].scale, models[r["model"]].settings)
        pending.append(trees)
        if len(pending) == TREES_KEPT:
            state, pending = materialised(state.mapInArrow(_with_predictions(models, features, pending), f"{BLOCK}, state binary"), "boosting"), []
    errors = state.mapInArrow(_errors(models, features, pending), "model long, sse double, n long")
    return errors.groupBy("model").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))


def fit_each_alone(blocks: DataFrame, models: list[Model], features: int) -> DataFrame:
    """(model, sse, n) with one task for each model; the blocks, few by their count, go to all."""
    spark = blocks.sparkSession
    parts = [Rows.read(r.asDict(), features) for r in blocks.collect()]
    whole = spark.sparkContext.broadcast((Rows(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("part", "bins", "y", "key")]), models))

    # The longest first, so that none of them is left for the end.
    order = sorted(range(len(models)), key=lambda i: -models[i].settings["n_estimators"] * models[i].settings["max_depth"] * (models[i].fold + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, all_models = whole.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                sse, n = fit_alone(rows, all_models[order[i]])
                yield pa.RecordBatch.from_arrays([pa.array([order[i]]), pa.array([sse]), pa.array([n])], ["model", "sse", "n"])

    return spark.range(0, len(models), 1, len(models)).mapInArrow(run, "model long, sse double, n long")


def boosted_search(
    df: DataFrame, features: Sequence[str], label: str, space: dict[str, Sequence] | None = None, n_iter: int = 20, n_splits: int = 4,
    seed: int = 42, by: Sequence[str] = ("series_id",), ts: str = "ts", alone: bool | None = None,
) -> tuple[dict, DataFrame]:
    """Random search over boosted trees with expanding folds; the best settings and the RMSE of each candidate and fold.

    Every series is cut into ``n_splits + 1`` parts in time, the first taking the
    rest; fold k learns from parts up to k and is tested on the next. Rows with a
    missing feature or label are left out. Features are cut at ``BINS`` quantiles.
    ``alone`` says whether each model is one task; by default that is so up to
    ``TASK_ROWS`` rows.
    """
    numbered = row_index(df.filter(complete([*features, label])), by, ts, name="row_idx", total="_len", slots=False)
    size = F.floor(F.col("_len") / (n_splits + 1))
    part = F.greatest(F.lit(0), F.floor((F.col("row_idx") - (F.col("_len") - n_splits * size)) / F.greatest(size, F.lit(1))) + 1).cast("int")
    rows = numbered.select(part.alias("part"), F.xxhash64(*by, ts, F.lit(seed)).alias("key"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    rows = materialised(rows, "boosting-rows")
    names = [f"x{i}" for i in range(len(features))]
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, shares, 100_000).alias(c) for c in names], F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("range")).first()
    if not found["n"]:
        raise ValueError("no row has all features and the label")
    edges = [np.unique(np.array(found[c])) for c in names]
    blocks = rows.mapInArrow(_blocks(edges, BLOCK_ROWS), BLOCK)

    sums = {r["part"]: (r["s"], r["n"]) for r in rows.groupBy("part").agg(F.sum(F.col("y").cast("decimal(38,18)")).cast("double").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    candidates = draw_candidates(space or SPACE, n_iter, seed)
    # Whole numbers that add up exactly in doubles, for residuals of up to four times the range.
    scale = 2.0 ** np.floor(50 - np.log2(found["n"]) - np.log2(max(4 * found["range"], 1e-300)))
    models = []
    for c, settings in enumerate(candidates):
        for fold in range(n_splits):
            mine = [sums[p] for p in sums if p <= fold]
            models.append(Model(len(models), c, fold, settings, sum(s for s, _ in mine) / max(1, sum(n for _, n in mine)), scale))
    alone = found["n"] <= TASK_ROWS if alone is None else alone
    errors = (fit_each_alone if alone else fit_by_levels)(blocks, models, len(features))
    done = {r["model"]: (r["sse"] / r["n"]) ** 0.5 if r["n"] else None for r in errors.collect()}
    rows = [(m.candidate, m.fold, done.get(m.number)) for m in models]
    means = [np.mean([r if r is not None else np.inf for c, _, r in rows if c == i]) for i in range(len(candidates))]
    return candidates[int(np.argmin(means))], df.sparkSession.createDataFrame(rows, "candidate int, fold int, rmse double")
