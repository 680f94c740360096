"""Near copies among embeddings by p-stable hashing.

Normalised vectors are projected on Gaussian directions; the projections, shifted
and cut into steps, are 2-stable hashes of the Euclidean distance, which for unit
vectors follows the cosine. Several steps together are a bucket of one table.
Vectors of one label that share a bucket in any table are compared by their exact
cosine, once, in the first table in which they meet. Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import U64, random_values, scramble
from tidemark.llm.frames import components
from tidemark.session import materialised

TABLES = 24
HASHES = 6
#: Step of the quantised projections, three times the distance at a cosine of 0.98.
STEP = 0.6
SEED = 20


def projections(size: int, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of all hashes of vectors of a size."""
    rng = np.random.default_rng([seed, size])
    return rng.normal(size=(size, tables * hashes)), rng.uniform(0, STEP, tables * hashes)


def buckets(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """The bucket of each vector in each table."""
    directions, shifts = projections(vectors.shape[1], tables, hashes, seed)
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    steps = np.floor((unit @ directions + shifts) / STEP).astype(np.int64).astype(U64).reshape(len(vectors), tables, hashes)
    mixers = random_values(hashes, 47) | U64(1)
    return scramble((steps * mixers).sum(axis=2, dtype=U64) + random_values(tables, 53))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        sizes = vectors.value_lengths().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        values = vectors.flatten().to_numpy().astype(np.float64)
        keys = np.zeros((batch.num_rows, TABLES), dtype=U64)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            keys[rows] = buckets(values[starts[rows][:, None] + np.arange(size)])
        bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TABLES)
        lists = pa.ListArray.from_arrays(bounds, pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), lists], ["node", "label", "keys"])


def _cosines(least: float):
    """Map: pairs of vectors to those with at least this cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            sizes = x.value_lengths().to_numpy()
            same = sizes == y.value_lengths().to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            x_at, y_at = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]) for c in (x, y))
            x_all, y_all = (c.flatten().to_numpy().astype(np.float64) for c in (x, y))
            for size in np.unique(sizes[same]).tolist():
                rows = np.flatnonzero(same & (sizes == size))
                a, b = x_all[x_at[rows][:, None] + np.arange(size)], y_all[y_at[rows][:, None] + np.arange(size)]
                cosine = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                keep[rows] = cosine >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def similar_vectors(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings``.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least ``least``; of different sizes they do not.
    ``n_links`` counts the other rows linked directly, equal vectors included;
    ``component_id`` is the least vec_id reachable; ``kept`` tells whether it is
    the row's own. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing and are kept. Repeated rows count as
    rows of their own; a null vec_id names no component. Extra columns are left
    out; an empty table gives an empty result.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("vector")
    )
    peak = F.array_max(F.transform("vector", F.abs))
    fine = F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull()) & (peak > 0) & (peak < float("inf"))
    rows = rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "vector")))
    # A power of two takes no digit and keeps squares in range; in two steps, as one may be out of range itself.
    high = F.floor(F.log2(peak))
    half = F.floor(high / 2)
    rows = rows.withColumn("vector", F.when(F.col("node").isNotNull(), F.transform("vector", lambda v: v * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - high))))
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("least")
    )
    classes = materialised(classes, "vectors")
    hashed = materialised(classes.mapInArrow(_hash, "node long, label " + dict(classes.dtypes)["label"] + ", keys array<long>"), "vector_keys")
    spread = hashed.select("label", "node", "keys", F.posexplode("keys").alias("table", "bucket"))
    x = spread.select("label", "table", "bucket", F.col("node").alias("a"), F.col("keys").alias("a_keys"))
    y = spread.select("label", "table", "bucket", F.col("node").alias("b"), F.col("keys").alias("b_keys"))
    met = F.array_position(F.zip_with("a_keys", "b_keys", lambda p, q: p == q), True)
    pairs = x.join(y, ["label", "table", "bucket"]).filter("a < b").filter(met == F.col("table") + 1).select("a", "b")
    vectors = classes.select("node", "vector")
    checked = pairs.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b").mapInArrow(_cosines(least), "a long, b long")
    links = materialised(checked, "vector_links")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("node").alias("b"), "members"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("members").alias("others"))
    named = components(links).join(classes.select("node", "least"), "node")
    lowest = named.groupBy("component").agg(F.min("least").alias("lowest"))
    named = named.join(lowest, "component").select("node", "lowest")
    found = classes.join(counts, "node", "left").join(named, "node", "left").select(
        "node", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("lowest", "least").alias("first")
    )
    found = materialised(found, "vector_classes")
    out = rows.select("vec_id", "node").join(found, "node", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
