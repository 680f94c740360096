"""Chats, mixing, sharding, scores, vectors, URLs and the pipeline on small inputs."""

import math
import os
import zlib

import numpy as np
import pytest
from brute import mixed, raw, similar, texts
from compare import compare, duck
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, queries, sharding, toxicity, url_filter, vector_dedup
from tidemark.session import work_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(rows):
    sources = ["b", "a", None, "", "é", "b", "b"]
    return [(d, t, ["en", "fr", None][i % 3], sources[i % 7], None if t is None else len(t)) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return rows_of(texts())


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in ("size", "target", "range_no", "place", "before", "draw", "mix_of")])


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    ok, text, _, _ = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, text


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "hello"),
        (2, 0, "user", "hi"), (2, 1, "bot", "hello"), (2, 2, "user", "bye <|im_end|>"),
        (3, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 5, "bot", "hello"), (3, 9, "user", "bye <|im_end|>"),
        (4, 0, "user", "hi"), (4, 1, "bot", None),
        (5, 0, "user", "hi"), (5, 1, "bot", ""),
        (6, None, None, "odd"), (6, 1, "user", "x"), (6, 1, "bot", "x"),
        (None, 0, "user", "lost"),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r["conv_id"]: r for r in out.collect()}
    assert sorted(found) == [2, 4, 5, 6]
    assert found[2]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nhello<|im_end|>\n<|im_start|>user\nbye < |im_end|><|im_end|>\n"
    assert found[6]["text"].startswith("<|im_start|>unknown\nodd") and found[6]["n_turns"] == 3


def test_long_chats_have_parts(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(200)] + [(2, i, "user", f"t{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.repartition(5)).orderBy("part").collect()
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in out] == [(1, p, 200) for p in range(4)]
    assert "".join(r["text"] for r in out).count("<|im_start|>") == 200
    assert chat.format_chats(df.limit(0)).count() == 0


def test_mix_equals_plain_python(docs, rows):
    out = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(mixed([(d, t, s) for d, t, _, s, _ in rows]), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a[:3], a[4]) == (b[:3], b[4]) and math.isclose(a[3], b[3], rel_tol=1e-9)
    assert got == sorted((tuple(r) for r in out.collect()), key=repr)


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = dict(out.groupBy("source").agg(F.sum(mixing.word_count())).collect())
    targets = {r["source"]: r for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    longest = docs.groupBy("source").agg(F.max(mixing.word_count())).collect()
    for source, most in longest:
        assert abs((words.get(source) or 0) - targets[source]["target"]) <= 2 * most
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_curve_steps_to_neighbours():
    place = sorted(range(4096), key=lambda c, index=sharding.curve(): index[c])
    assert sorted(sharding.curve()) == list(range(4096))
    cells = np.array([(c // 256, c // 16 % 16, c % 16) for c in place])
    assert (np.abs(np.diff(cells, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("shards", [16, 3])
def test_shards(docs, rows, shards):
    out = sharding.shard(docs, shards).collect()
    assert len(out) == len(rows)
    slots: dict = {}
    for r in out:
        assert r["size"] == len(raw(r["text"])) + 1 and r["text_crc32"] == zlib.crc32(raw(r["text"])) and r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard(docs.limit(0)).count() == 0


def test_machine_learns_pairs():
    """Label 1 only where an insult meets a group: no additive weights express it."""
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        docs.append(np.array([0] * insult + [1] * group + [2 + rng.integers(20)], dtype=np.int64))
        labels.append(int(insult and group))
    machine = toxicity.Machine(np.arange(22), 0.25)
    machine.fit(docs, np.array(labels, dtype=float), 20, 1)
    score, _ = machine.raw(np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1]), 3)
    assert score[0] > 1 and score[1] < -1 and score[2] < -1


def labelled(n=600, seed=9):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"word{rng.integers(300)}" for _ in range(30)]
        if toxic := int(rng.random() < 0.3):
            words[5:7] = [f"grumb{rng.choice(['ler', 'ling', 'lette'])}", "scumbag"]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (9001, None), (9002, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (9001, None), (1, None)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, machine).withColumn("held", toxicity.held_out()).collect()
    truth = {i: x for i, _, x in rows}
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in truth:
            assert (r["score"] >= toxicity.THRESHOLD) == truth[r["doc_id"]]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3 - sum(truth.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, labels) is None
    assert [r["score"] for r in toxicity.score_toxicity(docs, None).collect()] == [0.0]
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        centre = rng.normal(size=16)
        for _ in range(6):
            noise = rng.normal(size=16)
            rows.append((len(rows), [float(np.float32(x)) for x in centre + noise * rng.choice([0.02, 0.2]) * np.linalg.norm(centre) / 4], c % 3))
    rows.append((len(rows), [2 * x for x in rows[0][1]], rows[0][2]))
    rows.append((len(rows), rows[0][1], rows[0][2]))
    odd = [([0.0] * 16, 0), (None, 0), ([], 0), ([1.0, None], 0), ([1.0, math.nan], 0), ([1.0, math.inf], 0), (rows[0][1], None), ([1.0, 0.0], 0), ([1.0, 0.001], 0)]
    first = len(rows)
    rows += [(first + i, v, label) for i, (v, label) in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    out = {r["vec_id"]: r for r in vector_dedup.similar_vectors(df).collect()}
    assert len(out) == len(rows)
    whole = {i: np.array(v, dtype=float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    true = {i: 0 for i in out}
    for i, a in whole.items():
        for j, b in whole.items():
            if i != j and label[i] == label[j] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                true[i] += 1
    assert all(out[i]["n_links"] <= n for i, n in true.items())
    assert sum(r["n_links"] for r in out.values()) >= 0.9 * sum(true.values()) > 0
    for i in range(first, first + 7):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert out[first + 8]["component_id"] == first + 7 and not out[first + 8]["kept"]
    assert out[first - 1]["component_id"] == out[first - 2]["component_id"] == out[0]["component_id"]
    assert vector_dedup.similar_vectors(df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [
        ("http://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("https://a.example.org/en/12?q=1", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://a.example.org/en/2#x", "a.example.org", "/en/2", "org/", "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/a/b", "x.com", "/de/a/b", "com/de/", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.org", "x.org", "", None, None), ("http://x.com/en/", "x.com", "/en/", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("://", "", "", None, None), ("http://x.com?a/fr/", "x.com", "", None, None),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("x"))
    out = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert len(out) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule), urls[i]
        assert out[i]["verdict"] == verdict if verdict else out[i]["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df.filter("page_id > 8")).collect()} == {"allow"}


def test_url_trees_follow_features(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        bad = i % 2
        name = "".join(rng.choice(list("abcdefgh"), 6))
        rows.append((i, f"http://{name}.{'com/de' if bad else 'org'}/{rng.integers(10**8) if bad else name}"))
        rows.append((1000 + i, f"http://{name}.net/{'de/' + str(rng.integers(10**8)) if bad else name}"))
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 1000")
    right = [(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in out.collect()]
    assert sum(right) > 0.9 * len(right)


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    toxic = labelled(300)
    rows = rows_of(texts() + [(100 + i, t) for i, t, _ in toxic])
    documents = spark.createDataFrame(rows, DOCS)
    items = rows[9][1].split()[4:20]
    folder = work_path(spark, "corpus")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, x) for i, _, x in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(items))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*documents.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    # The same in plain Python: toxic rows, then near copies, then the passage, then the mix.
    bad = {100 + i for i, _, x in toxic if x}
    left = [r for r in rows if r[0] not in bad]
    found = similar([(r[0], r[1]) for r in left], 5, 80)
    left = [r for r, (doc, n, least) in zip(left, found) if doc is None or n == 0 or least == doc]
    at = rows[9][1].split()
    clean = {9: " ".join(at[:4]) + "  " + " ".join(at[20:])}
    got = out.select("doc_id", "text").distinct().collect()
    kept = {repr(r[0]): r[1] for r in left}
    assert {repr(r["doc_id"]) for r in got} <= set(kept)
    empty = {repr(r[0]) for r in left if not (r[1] or "").split()}
    assert empty <= {repr(r["doc_id"]) for r in got}
    for r in got:
        assert r["doc_id"] is None or r["text"] == clean.get(r["doc_id"], kept[repr(r["doc_id"])])
    taken = mixing.mix(spark.createDataFrame([(r[0], clean.get(r[0], r[1]), *r[2:]) for r in left], DOCS)).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size"))).collect()
    copies = dict(out.groupBy("doc_id").count().collect())
    repeated = {doc: sum(r[0] == doc for r in left) for doc, _ in taken}
    for doc, share in taken:
        want = 1 if share is None else math.floor(share + 0.5)
        assert copies.get(doc, 0) == want * repeated[doc]
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
