"""Long periodic words, which hashes modulo a power of two cannot tell apart, and digests that do not depend on order."""

import numpy as np
import pytest
from brute import bytes_kept, passages, similar, words_kept
from pyspark.sql import functions as F

from tidemark.llm import fm_index, frames, jaccard_join, recompression, suffix_dedup, vector_dedup
from tidemark.llm.batches import BASE, PRIME, Powers, Words, _times, random_values, white_space

SCHEMA = "doc_id long, text string"


def alternating(n, a, b):
    """The word that swaps its letters and doubles, n letters long."""
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_alternating_words_differ(n):
    one, two = alternating(n, "a", "b"), alternating(n, "b", "a")
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), white_space())
    assert words.hash[0] != words.hash[1]
    powers = Powers()
    sums = powers.sums(random_values(256, 11)[data])
    spans = powers.spans(sums, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert spans[0] != spans[1]


def test_sums_modulo_the_prime():
    rng, prime = np.random.default_rng(0), int(PRIME)
    a, b = rng.integers(0, prime, (2, 500), dtype=np.uint64)
    assert [int(v) for v in _times(a, b)] == [int(x) * int(y) % prime for x, y in zip(a, b)]
    values = rng.integers(0, 2**64 - 1, 400, dtype=np.uint64)
    total, want = 0, []
    for i, v in enumerate(values):
        total = (total + int(v) * pow(BASE, i, prime)) % prime
        want.append(total)
    assert [int(v) for v in Powers().sums(values)[1:]] == want


def test_words_by_place_and_beginning():
    text = "ab ba ab abc " + "x" * 500 + " " + "x" * 501 + " " + "x" * 500
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), white_space())
    kinds = dict(zip(text.split(), words.hash.tolist()))
    assert [kinds[w] for w in text.split()] == words.hash.tolist() and len(set(kinds.values())) == len(kinds)
    start = [int(words.sums[a + 2] - words.sums[a]) if words.sums[a + 2] >= words.sums[a] else int(words.sums[a + 2]) - int(words.sums[a]) + 2**64 for a in words.at]
    assert start[0] == start[2] == start[3] != start[1] and start[4] == start[5]


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, n in enumerate((1024, 4096)):
        for i, (a, b) in enumerate((("a", "b"), ("b", "a"), ("c", "d"))):
            word = alternating(n, a, b)
            out.append((10 * k + i, " ".join([word, *(f"w{j}" for j in range(60))])))
    long = [" ".join("xy"[c == "b"] for c in alternating(2048, a, b)) for a, b in (("a", "b"), ("b", "a"))]
    return out + [(100, long[0]), (101, long[1]), (102, alternating(4096, "a", "b")), (103, alternating(4096, "b", "a"))]


def test_operators_on_alternating_words(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert got(jaccard_join.similar_texts(docs, 4, 85)) == sorted(similar(rows, 4, 85), key=repr)
    words = recompression.remove_repeats(docs, 50).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert got(words) == sorted(words_kept(rows, 50), key=repr)
    out = suffix_dedup.remove_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert got(out) == sorted(bytes_kept(rows, 200), key=repr)
    items = [(1, alternating(1024, "b", "a")), (2, alternating(4096, "a", "b")), (3, alternating(1024, "d", "c"))]
    found = fm_index.find_passages(docs, spark.createDataFrame(items, "item_id long, text string"), 10)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    found = found.select("doc_id", "n_words", hits, F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256))
    assert got(found) == sorted(passages(rows, items, 10), key=repr)


def test_components_of_many_edges_end(spark):
    """Rounds depend on the edges alone, not on how they are dealt out."""
    edges = spark.range(200_000).select(F.col("id").alias("a"), (F.col("id") - F.pmod(F.xxhash64("id"), F.lit(50)) - 1).alias("b")).filter("a % 1000 > 50")
    found = [frames.components(edges.repartition(n)).groupBy("component").count().agg(F.count("*"), F.sum("count")).first() for n in (3, 17)]
    assert found[0] == found[1]


def test_vectors_of_any_scale(spark):
    base = [0.3, -1.0, 0.2, 0.9]
    rows = [(i, "x", [v * s for v in base]) for i, s in enumerate((1.0, 1e-170, 1e-300, 1e170, 1e300, 3.0))]
    rows += [(10, "x", [0.0] * 4), (11, "x", [float("inf"), 1.0, 0.0, 0.0]), (12, "x", [float("nan"), 1.0, 0.0, 0.0]), (13, "x", [1.0, None, 0.0, 0.0]), (14, "x", None), (15, "x", [])]
    out = vector_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    assert all(found[i] == (5, 0) for i in range(6)) and all(found[i] == (0, i) for i in range(10, 16))
