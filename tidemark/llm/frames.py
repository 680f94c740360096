"""Small frame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialised

#: Rows of fixed-size keys up to which a side is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of a batch that Spark hands to a Python task, or one longer row.
BATCH_BYTES = 1 << 22


def with_small(df: DataFrame, side: DataFrame, on: list[str], how: str, *items: str) -> DataFrame:
    """Join a written side: broadcast if counted small, shuffled beyond that.

    ``side`` should be read from files, so that counting it is cheap. Its rows
    have a fixed size, but for the list columns ``items``, whose items count too.
    """
    each = sum((F.size(i) for i in items), F.lit(1))
    if (side.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, on, how)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it sets a bound itself.

    Spark counts rows, 10000 for a batch. Of whole texts that is a task's share,
    which the executor then holds several times outside of its heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the least node.

    Alternating star contraction: every step is one aggregate and one join, hub
    nodes are only ever reduced to their least neighbour. Each round is written
    to the shared folder. It ends when the edges, told by exact digests that do
    not depend on order, stay as they are. Nodes without an edge to another node
    are left out.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = materialised(now, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialised(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if not seen[0] or seen[0] == seen[3] and seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
