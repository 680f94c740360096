"""A trie of conversations: which beginnings many of them share, and what sharing saves.

The trie is a z-fast trie. Only nodes where conversations part or end, and every
``PAGE``-th depth, are kept (compacted); an edge carries the keys of all depths it
runs over. A node is hashed under its handle: the key of its edge at the
two-fattest depth, the one divisible by the highest power of two. A conversation
finds the node it leaves the trie at by fat binary search over depths, a look-up
of one key at each step. Conversations go in in batches, each twice and more the
size of what is there; at the end edges are expanded to one node for each depth.

A key is a 128-bit hash of a whole beginning, so equal keys mean equal paths.
Searches, edges and windows stay within a page of depths, so no row or group
grows with the length of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import BROADCAST_ROWS, with_small
from tidemark.llm.ordered import in_ranges, with_prefix_sums
from tidemark.session import materialised

#: Depths between two nodes that are kept for certain.
PAGE = 1024
#: Shares of the conversations that are in after each batch.
BATCHES = (0.1, 0.4, 1.0)

DIGEST = ("d1", "d2", "d3", "d4")
KEY = "struct<a:bigint,b:bigint>"


def _key(parts: list[Column], place: Column) -> Column:
    return F.struct(F.xxhash64(*parts, place, F.lit(0)).alias("a"), F.xxhash64(*parts, place, F.lit(1)).alias("b"))


def _root() -> Column:
    zero = F.lit(0).cast("long")
    return _key([zero] * len(DIGEST), zero)


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the highest power of two divides; a < b."""
    high = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return b.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), high))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, mark, tokens): turns by number, null first, then by a hash of role and text."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("mark"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("tokens"),
    )
    order = ["conv_id", "turn", "mark"]
    placed = with_prefix_sums(in_ranges(turns, order, "turns"), order, {"place": F.lit(1).cast("long")}, by="conv_id")
    return placed.select("conv_id", (F.col("place") + 1).alias("place"), "mark", "tokens")


def regrown(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation behind the first turns of its group's first one.

    Conversation c begins with the first h turns of c - c % ``group`` (h: crc32 of
    its number modulo ``most``; all if there are fewer) and goes on with its own
    after its first h.
    """
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    heads = turns.filter((F.col("place") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    wants = turns.select("conv_id").distinct().select("conv_id", base, h).filter("h > 0")
    borrowed = wants.join(heads, "base").filter("place <= h").select("conv_id", "place", "mark", "tokens")
    held = heads.groupBy("base").agg(F.max("place").alias("held"))
    own = turns.select("*", base, h).filter("place > h").join(held, "base", "left")
    place = F.col("place") - F.col("h") + F.least(F.col("h"), F.coalesce("held", F.lit(0)))
    return borrowed.unionByName(own.select("conv_id", place.alias("place"), "mark", "tokens"))


def _beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, place, before, key, tokens): the key of every beginning and of the one a turn shorter."""
    marks = {}
    for i in (0, 1):
        h = F.xxhash64("place", "mark", F.lit(i))
        marks |= {f"t{2 * i + 1}": h.bitwiseAND(F.lit(2**32 - 1)), f"t{2 * i + 2}": F.shiftrightunsigned(h, 32)}
    order = ["conv_id", "place"]
    ranged = in_ranges(turns.withColumns(marks), order, "regrown")
    sums = with_prefix_sums(ranged, order, {d: F.col(f"t{d[1]}") for d in DIGEST}, by="conv_id")
    before = _key([F.col(d) for d in DIGEST], F.col("place") - 1)
    now = _key([F.col(d) + F.col(f"t{d[1]}") for d in DIGEST], F.col("place"))
    return sums.select("conv_id", "place", before.alias("before"), now.alias("key"), "tokens")


def _pages(beginnings: DataFrame, ends: DataFrame) -> DataFrame:
    """One row for each different conversation and page: its keys, in order, and its batch."""
    lead = ends.groupBy("end_key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_ends"), F.min("n").alias("n"))
    share = F.pmod(F.xxhash64("end_key", F.lit("batch")), F.lit(1_000_000)) / 1e6
    batch = sum((F.when(share >= s, 1).otherwise(0) for s in BATCHES[:-1]), F.lit(0))
    rows = beginnings.join(lead.select("conv_id", "n_ends", "n", "end_key", batch.alias("batch")), "conv_id")
    rows = rows.withColumn("base", F.expr(f"(place - 1) div {PAGE} * {PAGE}"))
    pages = rows.groupBy("conv_id", "n", "n_ends", "end_key", "batch", "base").agg(F.array_sort(F.collect_list(F.struct("place", "before", "key", "tokens"))).alias("turns"))
    return pages.select("conv_id", "n", "n_ends", "end_key", "batch", "base", F.col("turns.key").alias("keys"), F.col("turns.tokens").alias("tokens"), F.col("turns")[0]["before"].alias("before"))


def _with_handles(edges: DataFrame) -> DataFrame:
    """Edges, (above, depth] with the keys of their depths, and the key they are hashed under."""
    handle = F.element_at("keys", (two_fattest(F.col("above"), F.col("depth")) - F.col("above")).cast("int"))
    return edges.select("above", "depth", "parent", F.col("keys")[0].alias("first"), F.element_at("keys", -1).alias("key"), handle.alias("handle"), "keys", "tokens")


def _located(pages: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """Pages with ``shared``, the depth down to which the trie holds them, and the edge that ends in.

    Fat binary search: between a depth known to be shared and one known to be the
    end or not shared, the two-fattest depth is looked up among the handles. A hit
    goes on below that node, a miss above the depth.
    """
    handles = trie.select(F.col("handle").alias("probe"), F.col("depth").alias("hit"), F.col("above").alias("hit_above"), F.col("key").alias("hit_key"))
    at = lambda d: F.get("keys", (d - F.col("base") - 1).cast("int"))
    none = F.lit(None).cast(KEY)
    if trie.count() <= BROADCAST_ROWS:
        handles = F.broadcast(handles)
    now = pages.select("*", F.col("base").alias("lo"), (F.col("base") + F.size("keys")).alias("hi"), F.col("base").alias("top"), none.alias("found"))
    for _ in range(longest.bit_length() + 1):
        middle = F.when(F.col("lo") < F.col("hi"), two_fattest(F.col("lo"), F.col("hi")))
        now = now.withColumn("middle", middle).withColumn("probe", at(F.col("middle"))).join(handles, "probe", "left")
        hit = F.col("hit").isNotNull()
        now = now.select(
            *pages.columns, F.when(hit, F.col("hit")).otherwise(F.col("lo")).alias("lo"), F.when(hit | F.col("middle").isNull(), F.col("hi")).otherwise(F.col("middle") - 1).alias("hi"),
            F.when(hit, F.col("hit_above")).otherwise(F.col("top")).alias("top"), F.when(hit, F.col("hit_key")).otherwise(F.col("found")).alias("found"),
        )
    whole = F.col("found").isNull() | F.coalesce(at(F.col("lo")) == F.col("found"), F.lit(False))
    now = now.withColumn("start", F.when(whole, F.col("lo")).otherwise(F.col("top"))).withColumn("first", at(F.col("start") + 1))
    exits = trie.select("first", F.col("above").alias("edge_above"), F.col("depth").alias("edge_depth"), F.col("key").alias("edge"), F.col("keys").alias("edge_keys"))
    now = now.join(exits, "first", "left")
    own = F.slice("keys", (F.col("edge_above") - F.col("base") + 1).cast("int"), F.size("edge_keys"))
    same = F.size(F.filter(F.arrays_zip(own.alias("x"), F.col("edge_keys").alias("y")), lambda z: F.coalesce(z["x"] == z["y"], F.lit(False))))
    shared = F.when(F.col("edge").isNull(), F.col("start")).otherwise(F.col("edge_above") + same)
    return now.select(*pages.columns, shared.alias("shared"), "edge", "edge_above", "edge_depth")


def _cut(trie: DataFrame, located: DataFrame) -> DataFrame:
    """Edges cut where conversations of a batch end or leave in their middle."""
    cuts = located.filter("shared > edge_above AND shared < edge_depth").groupBy(F.col("edge").alias("key")).agg(F.array_sort(F.collect_set("shared")).alias("cuts"))
    edges = with_small(trie, materialised(cuts, "cuts"), ["key"], "left", "cuts")
    bounds = F.concat(F.array("above"), F.coalesce("cuts", F.expr("array()").cast("array<bigint>")), F.array("depth"))
    edges = edges.select("above", "parent", "keys", "tokens", bounds.alias("bounds")).select("*", F.posexplode(F.slice("bounds", 2, F.size("bounds"))).alias("i", "to"))
    since = F.get("bounds", F.col("i"))
    at, size = (since - F.col("above") + 1).cast("int"), (F.col("to") - since).cast("int")
    parent = F.when(F.col("i") == 0, F.col("parent")).otherwise(F.get("keys", at - 2))
    return _with_handles(edges.select(since.alias("above"), F.col("to").alias("depth"), parent.alias("parent"), F.slice("keys", at, size).alias("keys"), F.slice("tokens", at, size).alias("tokens")))


def _grown(located: DataFrame) -> DataFrame:
    """The edges of what a batch adds below the depths that the trie shares with it."""
    at = F.col("shared") - F.col("base")
    rest = located.filter("shared < base + size(keys)")
    place = F.col("base") + F.col("i") + 1
    rows = rest.select("conv_id", "n", "base", "shared", "before", "keys", F.posexplode(F.arrays_zip("keys", "tokens")).alias("i", "turn")).filter(F.col("i") >= at)
    rows = rows.select(
        "conv_id", "base", place.alias("place"), F.col("turn.keys").alias("key"), F.col("turn.tokens").alias("tokens"),
        F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("keys", F.col("i") - 1)).alias("parent"), (place == F.col("n")).alias("ends"),
    )
    rows = materialised(rows, "added")
    nodes = rows.groupBy("key").agg(*[F.min(c).alias(c) for c in ("conv_id", "base", "place", "tokens")], F.min("parent.a").alias("pa"), F.min("parent.b").alias("pb"), F.max("ends").alias("ends"))
    parts = rows.groupBy(F.col("parent").alias("key")).agg(((F.min("key.a") < F.max("key.a")) | (F.min("key.b") < F.max("key.b"))).alias("parts"))
    kept = F.col("ends") | F.coalesce("parts", F.lit(False)) | (F.col("place") % PAGE == 0)
    nodes = nodes.join(parts, "key", "left").select("conv_id", "base", "place", "key", "tokens", F.struct(F.col("pa").alias("a"), F.col("pb").alias("b")).alias("parent"), kept.alias("kept"))
    below = Window.partitionBy("conv_id", "base").orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("depth", F.min(F.when(F.col("kept"), F.col("place"))).over(below))
    edges = nodes.groupBy("conv_id", "base", "depth").agg(F.array_sort(F.collect_list(F.struct("place", "key", "tokens", "parent"))).alias("e"))
    return _with_handles(edges.select((F.col("e")[0]["place"] - 1).alias("above"), "depth", F.col("e")[0]["parent"].alias("parent"), F.col("e.key").alias("keys"), F.col("e.tokens").alias("tokens")))


def grow_trie(pages: DataFrame) -> DataFrame:
    """The compacted trie of all pages, put in batch by batch."""
    longest = pages.agg(F.max(F.size("keys"))).first()[0] or 0
    trie = None
    for i in range(len(BATCHES)):
        batch = pages.filter(F.col("batch") == i)
        if trie is None:
            none = F.lit(None)
            located = batch.select("*", F.col("base").alias("shared"), none.cast(KEY).alias("edge"), none.cast("long").alias("edge_above"), none.cast("long").alias("edge_depth"))
            trie = materialised(_grown(located), "trie")
        else:
            located = materialised(_located(batch, trie, longest), "located")
            trie = materialised(_cut(trie, located).unionByName(_grown(located)), "trie")
    return trie


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's numbers, which come sorted, joined by commas; a group is never held."""
    now, digest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1), len(a)]
        done = []
        for i, j in zip(starts, starts[1:]):
            text = ",".join(map(str, ids[i:j].tolist())).encode()
            if now == (a[i], b[i]):
                digest.update(b"," + text)
                continue
            if now is not None:
                done.append((*now, digest.hexdigest()))
            now, digest = (a[i], b[i]), hashlib.sha256(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["a", "b", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, digest.hexdigest())], ["a", "b", "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    sorted_ends = ends.select("end_key.a", "end_key.b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    out = sorted_ends.mapInArrow(_joined_digests, "a long, b long, ends_sha256 string")
    return out.select(F.struct("a", "b").alias("key"), "ends_sha256")


def prefix_nodes(conversations: DataFrame, rebuild=regrown) -> DataFrame:
    """One row for each node of the trie of conversations, the textless root included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): the smallest conversation through the node and through its
    parent, how many go through it, its children, the childless nodes below it
    (itself included), the words that need not be read again if every node is
    read once, and the SHA-256 of the numbers of those that end there.

    Turns are ordered by number, null first, turns of one number by a hash of
    role and text; a null role or text is empty; repeated rows are turns of their
    own. Rows without a conv_id belong to no conversation. A conversation that
    ``rebuild`` leaves without turns ends at the root. Texts of any length and
    extra columns do no harm; an empty table gives no node. ``rebuild`` maps
    (conv_id, place, mark, tokens) to the same; ``None`` takes conversations as
    they are. A SHA-256 can only be taken in one stretch: the numbers that end at
    one node pass through one task, as a stream.
    """
    turns = materialised(ordered_turns(conversations), "places")
    beginnings = materialised(_beginnings(rebuild(turns) if rebuild else turns), "beginnings")
    last = beginnings.groupBy("conv_id").agg(F.max("place").alias("n"), F.max_by("key", "place").alias("end_key"))
    ends = turns.select("conv_id").distinct().join(last, "conv_id", "left")
    ends = materialised(ends.select("conv_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("end_key", _root()).alias("end_key")), "ends")
    pages = materialised(_pages(beginnings, ends.filter("n > 0")), "pages")
    trie = grow_trie(pages)

    kept = trie.select("key", "parent", F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t).alias("words"))
    turns_of = pages.select("conv_id", "n_ends", "end_key", "base", F.posexplode("keys").alias("i", "key"))
    path = materialised(turns_of.join(kept.select("key"), "key").select("key", "conv_id", "n_ends", "end_key", "base", "i"), "paths")
    through = path.groupBy("key").agg(F.sum("n_ends").alias("n_convs"), F.min("conv_id").alias("node_conv"))
    children = kept.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = kept.join(through, "key").join(children, "key", "left")
    nodes = nodes.select("key", "node_conv", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = materialised(nodes, "nodes")

    # a node's saving is counted on the path of its smallest conversation, whose turns from some depth on are its own
    mine = path.join(nodes.select("key", "node_conv", "saved", "n_children"), "key")
    mine = mine.withColumns({"own": F.when(F.col("conv_id") == F.col("node_conv"), F.col("saved")).otherwise(0), "leaf": ((F.col("key") == F.col("end_key")) & (F.col("n_children") == 0)).cast("long")})
    mine = materialised(mine.select("key", "conv_id", "end_key", "base", "i", "own", "leaf"), "savings")
    later = Window.partitionBy("conv_id").orderBy(F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = mine.groupBy("conv_id", "base").agg(F.sum("own").alias("own_in"), F.max("leaf").alias("ends_in_leaf"))
    totals = totals.select("conv_id", "base", F.coalesce(F.sum("own_in").over(later), zero).alias("own_later"), F.greatest("ends_in_leaf", F.coalesce(F.max("ends_in_leaf").over(later), zero)).alias("leaves"))
    here = Window.partitionBy("conv_id", "base").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = mine.withColumn("below", F.sum("own").over(here)).join(totals, ["conv_id", "base"])
    below = below.groupBy("key").agg(F.sum(F.col("below") + F.col("own_later")).alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    all_in = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    whole = mine.agg(F.sum("own").alias("saved"), F.sum("leaf").alias("leaves")).first()
    at_root = kept.filter(F.col("parent") == _root()).count()
    spark = conversations.sparkSession
    root = spark.range(1 if all_in["n_convs"] else 0).select(
        _root().alias("key"), F.lit(all_in["conv_id"]).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_in["n_convs"]).cast("long").alias("n_convs"),
        F.lit(at_root).cast("long").alias("n_children"), F.lit(whole["leaves"] or 1).cast("long").alias("n_leaves"), F.lit(whole["saved"] or 0).cast("long").alias("saved_tokens"),
    )

    edges = trie.select("key", "parent", "above", "depth", F.col("tokens").alias("words")).join(nodes, "key").join(below, "key")
    above = nodes.select(F.col("key").alias("parent"), F.col("node_conv").alias("parent_conv"))
    edges = edges.join(above, "parent", "left").withColumn("parent_conv", F.coalesce("parent_conv", F.lit(all_in["conv_id"]).cast("long")))
    edges = edges.select("*", F.posexplode("words").alias("i", "word"))
    bottom = F.col("above") + F.col("i") + 1 == F.col("depth")
    read = F.aggregate(F.slice("words", F.lit(1), F.col("i")), zero, lambda s, t: s + t)
    expanded = edges.select(
        F.when(bottom, F.col("key")).alias("key"), F.col("node_conv").alias("conv_id"), (F.col("above") + F.col("i") + 1).alias("depth"),
        F.when(F.col("i") == 0, F.col("parent_conv")).otherwise(F.col("node_conv")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") - (F.col("n_convs") - 1) * read).alias("saved_tokens"),
    )
    out = expanded.unionByName(root).join(_end_digests(ends), "key", "left").drop("key")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


ORACLE = r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM t),
x AS (SELECT range::BIGINT AS byte, list_reduce(list_prepend(range::BIGINT, range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS entry FROM range(256)),
e AS (SELECT list(entry ORDER BY byte) AS entries FROM x),
h AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda v, b: xor(v >> 8, entries[(xor(v, b) & 255) + 1])), 4294967295) % 4 AS h FROM c, e),
r AS (SELECT h.conv_id, 0 AS own, t.place, role, text FROM h JOIN t ON t.conv_id = h.base AND t.place <= h.h
    UNION ALL SELECT h.conv_id, 1, t.place, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.place > h.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    md5(string_agg(md5(role) || md5(text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
a AS (SELECT conv_id, depth, words, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent FROM p
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
s AS (SELECT conv_id, arg_max(key, depth) AS key FROM a GROUP BY conv_id),
n AS (SELECT key, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM a GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT a.key, sum(n.saved) AS saved_tokens, count(*) FILTER (k.key IS NULL) AS n_leaves
    FROM n LEFT JOIN k ON k.key = n.key JOIN a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key),
d AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM s GROUP BY key)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens,
    coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n q ON q.key = n.parent LEFT JOIN k ON k.key = n.key JOIN u ON u.key = n.key LEFT JOIN d ON d.key = n.key"""
