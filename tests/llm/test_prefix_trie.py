"""The trie of conversations next to a plain one, and its searches."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuilt=True):
    own = {}
    mark = lambda r: hashlib.md5((f"{len((r[2] or '').encode())}:" + (r[2] or "") + (r[3] or "")).encode()).hexdigest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, mark(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = {}
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].replace("\n", " ").split(" ")) - node[-1][1].replace("\n", " ").split(" ").count("") if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children.get(node, []))
        leaves[node] = sum(leaves[c] for c in children.get(node, [])) or 1
        out[min(members[node]), len(node)] = [
            min(members[node[:-1]]) if node else None, len(members[node]), len(children.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ]
    return out


def found(df):
    rows = df.select(*COLUMNS).collect()
    out = {(r[0], r[1]): list(r[2:]) for r in rows}
    assert len(out) == len(rows)
    return out


def sample(seed=5, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        path = rng.integers(0, 2, int(rng.integers(1, 12)))
        rows += [(c, i, ["user", "bot"][i % 2], f"turn {'x ' * int(v)}") for i, v in enumerate(path)]
    rows += [(1000 + c, i, "user", "the same") for c in range(60) for i in range(7)]
    rows += [(2000, i % 50, "user", f"t{i}") for i in range(300)] + [(2020, i % 50, "user", f"t{i}") for i in range(250)] + [(2021, 1, None, None)]
    rows += [(3001, None, "user", "odd"), (3001, 0, None, "  spread \n out "), (3001, 0, "a", "tie"), (3001, 0, "a", "tie"), (None, 0, "user", "lost"), (-7, 0, "user", "below"), (-20, 0, "user", "base")]
    return rows + [(4000, 0, "user", "long " * 50_000), (4001, 0, "user", "long " * 50_000)]


@pytest.mark.parametrize("page", [4, 1024])
def test_nodes(spark, page, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PAGE", page)
    rows = sample()
    df = spark.createDataFrame(rows, TURNS).repartition(5).select("*", *[F.lit("x").alias(c) for c in ("place", "key", "base", "mark", "keys", "depth", "i")])
    assert found(prefix_trie.prefix_nodes(df)) == plain(rows)


def test_as_they_are_and_in_one_batch(spark, monkeypatch):
    rows = sample(6, 120)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert found(prefix_trie.prefix_nodes(df, rebuild=None)) == plain(rows, rebuilt=False)
    monkeypatch.setattr(prefix_trie, "BATCHES", (0.2, 0.3, 0.5, 0.9, 1.0))
    assert found(prefix_trie.prefix_nodes(df)) == plain(rows)


def test_without_turns(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, 0, "user", "x") for c in (21, 22, 23, 24, 25)]
    assert found(prefix_trie.prefix_nodes(spark.createDataFrame(rows, TURNS))) == plain(rows)
    alone = [(c, 0, "user", "x") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    assert found(prefix_trie.prefix_nodes(spark.createDataFrame(alone, TURNS))) == plain(alone)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)] + [(2**40 - 1, 2**40 + 5), (1023, 1024)]
    for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        want = r.b & ~((1 << ((r.a ^ r.b).bit_length() - 1)) - 1)
        assert r.f == want and r.a < r.f <= r.b
        if r.b < 50:
            assert want == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)
