"""Text operators against plain-Python versions, with odd rows and clashing columns."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from brute import bytes_kept, passages, similar, texts, words_kept
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import fm_index, frames, jaccard_join, recompression, suffix_dedup
from tidemark.llm.batches import Powers

SCHEMA = "doc_id long, text string"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, rows):
    assert plain(df) == sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = ("set_id", "text_key", "spans", "segments", "own_id", "n_words", "token", "wins", "items")
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_similar_texts(docs, rows, k, percent):
    same(jaccard_join.similar_texts(docs, k, percent), similar(rows, k, percent))


def test_one_of_each(docs, rows):
    kept = jaccard_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    found = similar(rows, 5, 80)
    want = [r[0] for r in found if r[0] is None or r[1] == 0 or r[2] == r[0]]
    assert sorted(map(repr, want)) == sorted(repr(r[0]) for r in kept.select("doc_id").collect())


def test_large_group_of_near_copies(spark):
    """Hubs gather a group; its size must not show in the number of pairs."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        words[rng.integers(120)] = f"other{i}"
        words[rng.integers(120)] = f"more{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"x{i}y{j}" for j in range(50)) + " " + " ".join(base[:20])) for i in range(60)]
    out = jaccard_join.similar_texts(spark.createDataFrame(rows, SCHEMA), 4, 85)
    same(out, similar(rows, 4, 85))


def test_prefix_choice_trades_lists_for_matches():
    cheap = np.zeros(50)
    assert jaccard_join.prefix_choice(cheap, 50, 80) == 1
    level = np.full(50, 100.0)
    assert jaccard_join.prefix_choice(level, 50, 80) == 4
    steep = np.concatenate([np.full(11, 1.0), np.full(39, 1e6)])
    assert jaccard_join.prefix_choice(steep, 50, 80) == 1


@pytest.mark.parametrize("window", [8, 20, 50])
def test_word_repeats(docs, rows, window):
    out = recompression.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    same(out, words_kept(rows, window))


def test_equal_passages_get_equal_symbols():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 30, 200).astype(np.uint64)
    symbols = []
    for n in (7, 31):
        names = np.concatenate([rng.integers(0, 30, n).astype(np.uint64), passage])
        name, start, end, left, right = recompression.compress(names, np.zeros(len(names), dtype=np.int64))
        assert (np.diff(left) >= 0).all() and (np.diff(right) >= 0).all() and (start[1:] == end[:-1]).all()
        inner = (left >= n) & (right <= len(names))
        symbols.append({(int(a), int(b - n)) for a, b in zip(name[inner], start[inner])})
    assert symbols[0] == symbols[1] and len(symbols[0]) > 20


@pytest.mark.parametrize("window,most,cuts", [(48, 256, 4), (100, 1, 2), (200, 256, 4), (200, 1, 0)])
def test_byte_repeats(docs, rows, window, most, cuts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "CUTS", cuts)
    out = suffix_dedup.remove_repeats(docs, window).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same(out, bytes_kept(rows, window))


def test_suffix_array_in_two_stages():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 5):
        text = np.concatenate([rng.integers(1, letters + 1, 300), [0]]).astype(np.uint8)
        sums = Powers().sums(text.astype(np.uint64))
        powers = Powers()
        sums = powers.sums(text.astype(np.uint64))
        ends = np.minimum(np.arange(301) + 304, 301)
        order = suffix_dedup.suffix_array(text, powers.spans(sums, np.arange(301), ends), 304)
        raw = text.tobytes()
        assert order.tolist() == sorted(range(301), key=lambda i: raw[i:])


def test_very_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA)
    same(suffix_dedup.remove_repeats(docs, 64).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)), bytes_kept(rows, 64))


@pytest.fixture(scope="module")
def items(rows):
    words = rows[7][1].split()
    other = rows[9][1].split()
    return [
        (1, " ".join(words[5:30])), (2, "!".join(words[20:32]).upper()), (10, " ".join(other[3:6])), (10, " ".join(other[12:26])), (3, None), (4, ""), (5, "?!"),
        (None, " ".join(other[30:42])), (6, "çà straße"), (7, "absent from all of the texts whatever they may be called today"),
    ]


def digest(found):
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", "n_words", hits, F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256))


@pytest.mark.parametrize("block", [1 << 22, 100])
def test_passages(spark, docs, rows, items, block, monkeypatch):
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", block)
    found = digest(fm_index.find_passages(docs, spark.createDataFrame(items, "item_id long, text string"), 10))
    assert plain(found) == sorted(passages(rows, items, 10), key=repr)


@pytest.mark.parametrize("rows_sent", [500_000, 0])
def test_passages_of_every_row_in_blocks(spark, rows, items, rows_sent, monkeypatch):
    """Repeated rows, and rows without a doc_id, each have their result whatever the blocks."""
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 100)
    monkeypatch.setattr(frames, "BROADCAST_ROWS", rows_sent)
    more = rows + [(None, None)] * 3 + [(None, rows[7][1])] * 3 + [(7, rows[7][1])] * 2 + [(7, None), (-(2**63), rows[7][1])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    same(digest(fm_index.find_passages(spark.createDataFrame(more, SCHEMA).repartition(3), tests, 10)), passages(more, items, 10))


def test_removed_passages(spark, docs, rows, items):
    tests = spark.createDataFrame(items, "item_id long, text string")
    clean = fm_index.remove_passages(docs.withColumn("n_chars", F.length("text").cast("long")), tests, 10)
    assert clean.columns == [*docs.columns, "n_chars"] and clean.count() == len(rows)
    assert clean.filter("n_chars <> length(text)").isEmpty()
    kept = {repr(r[0]): r[1] for r in clean.select("doc_id", "text").collect()}
    assert kept["16"] == rows[16][1] and kept["20"] is None and kept["21"] == ""
    left = rows[7][1].split()
    assert kept["7"].split() == left[:5] + left[32:]


def test_index_counts_and_locates():
    rng = np.random.default_rng(4)
    runs = [rng.integers(1, 4, n) for n in (40, 3, 90)]
    text = np.concatenate([np.concatenate([r, [0]]) for r in runs])
    index = fm_index.FMIndex(text, 3)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_empty_tables(spark, none):
    tests = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.similar_texts(none).count() == 0
    assert recompression.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert fm_index.find_passages(none, tests).count() == 0
    docs = spark.createDataFrame([(1, "some words")], SCHEMA)
    assert [tuple(r)[2:] for r in fm_index.find_passages(docs, tests).collect()] == [(2, [], [])]


def test_parities_never_hide_a_shared_shingle():
    """The bound holds for sets of any sizes, and is tight enough to tell unlike sets apart."""
    rng = np.random.default_rng(6)
    for n, m, shared in [(1, 1, 1), (3, 900, 2), (700, 5000, 650), (5000, 5100, 4700), (4000, 4000, 10), (20_000, 19_000, 18_500)]:
        pool = np.unique(rng.integers(0, 2**63, 2 * (n + m), dtype=np.uint64))
        rng.shuffle(pool)
        x, y = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        for one, other in ((x, y), (y, x)):
            bound = jaccard_join.most_shared(jaccard_join.parities(one), jaccard_join.parities(other), n + m)
            assert bound >= shared
    assert jaccard_join.most_shared(*map(jaccard_join.parities, (pool[:4000], pool[4000:8000])), 8000) < 0.92 * 4000


def test_sets_of_unlike_texts_are_not_moved(spark, monkeypatch):
    """Pairs that share a passage but cannot link are dropped before whole sets are joined."""
    sizes = {}

    def noted(df, name):
        out = session.materialised(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialised", noted)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"w{w}" for w in rng.integers(0, 10**9, 40)), *passage[i % 3 :]])) for i in range(3)]
    rows += [(i + 10, text + " end") for i, text in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(jaccard_join.similar_texts(docs, 4, 85), similar(rows, 4, 85))
    readers = spark.createDataFrame([(a, b, a, b, a, b) for a, b in [(0, 10), (0, 1), (1, 12)]], "a long, b long, a_comp long, b_comp long, a_reader long, b_reader long")
    ids = {r["doc_id"]: r["set_id"] for r in docs.mapInArrow(jaccard_join._read_sets(4, 20), "doc_id long, n_shingles long, set_id long, chunk int, counts binary").filter("doc_id IS NOT NULL").collect()}
    pairs = spark.createDataFrame([(ids[r["a"]], ids[r["b"]], r["a"], r["b"], r["a"], r["b"]) for r in readers.collect()], readers.schema)
    sizes.clear()
    assert jaccard_join._linked(pairs, docs, 4, 85).count() == 1 and sizes["possible"] == [1] and sizes["possible_sets"] == [2]


def test_windows_are_hashed_for_a_small_slice_at_once():
    """Memory of a task follows SLICE, and segments do not depend on where slices end."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(range(900)), pa.array(texts)], ["doc_id", "text_key", "text"])
    run = suffix_dedup._segments(200)
    list(run(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    got = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    alone = [b for i in range(900) for b in run(iter([batch.slice(i, 1)]))]
    assert pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches(alone).to_pydict()


def test_passages_are_searched_in_a_small_shard_at_once():
    """Memory of a task follows SHARD_BYTES: words and index take about 40 times a shard's bytes."""
    draw = np.random.default_rng(6)
    texts = [" ".join(f"word{w}" for w in draw.integers(0, 3000, 400)) for _ in range(1500)]
    phrases = fm_index.Phrases([(0, texts[0]), (1, texts[900])], 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts), pa.array(range(1500))], ["doc_id", "text", "text_key"])
    tracemalloc.start()
    items = [i for b in fm_index._search(phrases)(iter([batch])) for i in b.column("items").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, own in enumerate(items) if own] == [0, 900] and peak < 60e6


def test_ranks_of_hubs_need_no_join(spark, monkeypatch):
    """A set's postings meet once by a window; a join of all postings grew with them."""
    base = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join([*base[:d % 50], f"x{d}", *base[d % 50 + 1 :]])) for d in range(60)]
    plans, plain = {}, jaccard_join.materialised

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(jaccard_join, "materialised", written)
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    same(jaccard_join.similar_texts(docs, 4, 85), similar(rows, 4, 85))
    assert "Join" not in plans["ranked"]
