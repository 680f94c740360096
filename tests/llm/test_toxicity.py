"""Terms that matter only together are learned, whatever their own share in the classes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import toxicity


def test_balanced_terms_that_are_toxic_together(spark):
    """Insult and group stand equally often in both classes; alone they are clean."""
    rng = np.random.default_rng(4)
    rows, kind = [], {}
    for i in range(3000):
        toxic = i % 4 == 0
        kind[i] = rng.choice(["both", "slur"], p=[0.4, 0.6]) if toxic else rng.choice(["group", "insult", "neither"], p=[0.4, 0.4, 0.2])
        words = [f"word{rng.integers(60)}" for _ in range(6)]
        words += {"both": ["muppet", "welsh"], "slur": ["scumbag"], "group": ["welsh"], "insult": ["muppet"], "neither": []}[kind[i]]
        rows.append((i, " ".join(words), int(kind[i] in ("both", "slur"))))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.fit_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(docs, machine).withColumn("held", toxicity.held_out()).filter("held").collect()
    right = {k: np.mean([(r["score"] >= toxicity.THRESHOLD) == (k in ("both", "slur")) for r in out if kind[r["doc_id"]] == k]) for k in set(kind.values())}
    assert min(right.values()) > 0.9


def test_terms_are_looked_up_for_a_small_slice_at_once():
    """Memory of a task follows TERM_BYTES: the terms of a slice take many times its bytes."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{w}" for w in rng.integers(0, 5000, 300)) for _ in range(1500)]
    machine = toxicity.Machine(np.arange(1000), 0.1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], ["doc_id", "text"])
    run = toxicity._score(machine)
    list(run(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    scores = np.concatenate([b.column("score").to_numpy() for b in run(iter([batch]))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 1500 and peak < 40e6


def test_terms_of_a_text_are_told_apart_without_hashing_all_of_them(monkeypatch):
    """Pairs are marked in a table or sorted; both give each text the terms it has alone, once each."""
    texts = [b"", b"Fine fine FINE day!!!", None, b"", b"antidisestablishment Antidisestablished day", "\u00e9t\u00e9 12 -".encode(), b"day", b"!"]
    texts += [b" ".join(b"word%d" % (i * j % 97) for j in range(40)) for i in range(30)]
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    offsets = np.cumsum([0] + [len(t or b"") for t in texts])
    alone = [toxicity.Terms()(data[a:b], np.array([0, b - a]))[1].tolist() for a, b in zip(offsets, offsets[1:])]
    assert all(x == sorted(set(x)) for x in alone) and alone[0] == alone[2] and len(alone[6]) == 3
    monkeypatch.setattr(toxicity.np, "unique", None)
    slot = np.where(np.arange(toxicity.BUCKETS) % 3 == 1, -1, np.arange(toxicity.BUCKETS))
    for cells in (1 << 22, 0):
        monkeypatch.setattr(toxicity, "CELLS", cells)
        text, term = toxicity.Terms()(data, offsets)
        assert [term[text == i].tolist() for i in range(len(texts))] == alone and (np.diff(text) >= 0).all()
        text, term = toxicity.Terms(slot)(data, offsets)
        assert [term[text == i].tolist() for i in range(len(texts))] == [[x for x in one if x % 3 != 1] for one in alone]
        assert [len(x) for x in toxicity.Terms()(data[:0], np.zeros(4, dtype=np.int64))] == [6, 6]


def test_fit_follows_the_gradient_of_every_text():
    """One step over few texts, one of them without terms, against the formula written out."""
    machine = toxicity.Machine(np.arange(5), 0.3)
    bias, weight, factor = machine.bias, machine.weight.astype(float), machine.factor.astype(float)
    docs, labels = [np.array([0, 3]), np.array([], dtype=int), np.array([3, 4, 1])], np.array([1.0, 0.0, 0.0])
    machine.fit(docs, labels, 1, 7, rate=0.1, shrink=1e-4)
    x = np.array([[i in d for i in range(5)] for d in docs], dtype=float)
    sums = x @ factor
    error = (1 / (1 + np.exp(-(bias + x @ weight + 0.5 * (sums**2 - x @ factor**2).sum(axis=1)))) - labels) / 3
    touched = x.any(axis=0)
    g_weight = x.T @ error + 1e-4 * weight
    g_factor = x.T @ (error[:, None] * sums) - (x.T @ error)[:, None] * factor + 1e-4 * factor
    assert np.allclose(machine.weight, weight - touched * 0.1 * g_weight / np.sqrt(1e-2 + g_weight**2), atol=1e-6)
    assert np.allclose(machine.factor, factor - touched[:, None] * 0.1 * g_factor / np.sqrt(1e-2 + g_factor**2), atol=1e-6)
    assert np.isclose(machine.bias, bias - 0.1 * error.sum() / (1e-2 + error.sum() ** 2) ** 0.5)


def test_rows_stay_while_their_texts_are_scored(spark):
    """Whole rows do not move through Python; batches of texts are bounded by bytes, not by 10000 rows."""
    rows = [(i, f"word{i % 7} fine day", "en") for i in range(400)] + [(i, f"word{i % 7} scumbag", None) for i in range(400, 500)]
    rows += [(500, None, "en"), (501, "", "de"), (None, "word1 scumbag", "en"), (None, "word1 fine day", "en"), (3, "word3 fine day", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text", "doc_id")
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(500)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 22
    machine = toxicity.fit_toxicity(docs, labels)
    scored = toxicity._score(machine)(iter([pa.RecordBatch.from_pylist([{"text": r[1], "at": i} for i, r in enumerate(rows)])]))
    want = [(rows[r["at"]][2], *rows[r["at"]][1::-1]) for b in scored for r in b.to_pylist() if r["score"] < toxicity.THRESHOLD]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr) and 400 < len(want) < 410


def test_no_machine_keeps_every_row(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert toxicity.drop_toxic(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).count() == 2
