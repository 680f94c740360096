"""The filter audit next to a plain recount of every order."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit

DOCS = "doc_id long, text string, lang string"


def plain(rows, labels):
    """All rows of the audit from sets of documents, order by order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    marked = []
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and first[t] < d,
        }
        marked.append((lang or "", d, {k for k, v in flags.items() if v}))
    out = {}
    for part in {p for p, _, _ in marked}:
        here = [(d, f) for p, d, f in marked if p == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                removed = [(d, f) for d, f in here if letter in f and not f & gone]
                removed_in_all[letter] += len(removed)
                gone.add(letter)
                out[part, "".join(order), step] = [
                    sum(not f & gone for _, f in here), len(removed), sum(letter in f and bool(f & (gone - {letter})) for _, f in here),
                    sum(f == {letter} for _, f in here), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(removed_in_all[key[1][key[2] - 1]])
    return out


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def sample():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(600)] + ["ABC", "#x", "é"]
    rows = []
    for d in range(150):
        n, kinds = int(rng.integers(0, 500)), int(rng.integers(1, 603))
        rows.append((d, " ".join(rng.choice(words[-kinds:], n)), [None, "", "en", "fr"][d % 4]))
    rows += [(1000 + i, "same text", "en") for i in range(60)] + [(500, "same text", "fr"), (2000, None, None), (2001, "", "en"), (2001, "", "en")]
    rows += [(None, "same text", "en"), (None, "alone", "en"), (None, None, None)]
    rows += [(3000, "long " * 60_000, "en"), (2999, "long " * 60_000, "de"), (3001, "W" * 5000, "de"), (500, "another", "fr")]
    labels = [(d, d % 2, d % 3 % 2) for d in range(0, 150, 2)] + [(1001, 1, None), (1001, None, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_counts(spark):
    rows, labels = sample()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("part", "mask", "hash", "words", "key", "first", "cells", "n", "step")])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("*", F.lit(1).alias("good"), F.lit("x").alias("part"))
    assert found(filter_audit.audit_filters(docs, marks)) == plain(rows, labels)


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, marks).count() == 0
    one = spark.createDataFrame([(1, None, None)], DOCS)
    assert found(filter_audit.audit_filters(one, marks)) == plain([(1, None, None)], [])


def test_own_checks_without_repeats(spark):
    docs, marks = spark.createDataFrame([(1, "a b", "x"), (2, "a", "x")], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit_filters(docs, marks, {"S": F.size("words") < 2, "T": F.length("text") < 9}, repeats=None)
    assert found(out)["x", "ST", 2][:3] == [0, 1, 1] and found(out)["x", "TS", 1][6] == 3


@pytest.mark.parametrize("slices", [1, 4, 1 << 14])
def test_sketch_never_clears_a_repeat(spark, slices, monkeypatch):
    monkeypatch.setattr(filter_audit, "ROWS_AT_ONCE", 100)
    once = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    values = np.concatenate([once, once[:200], np.repeat(once[:1], 700)])
    df = spark.createDataFrame([(int(v),) for v in values], "hash long").repartition(6)
    slices, bits = filter_audit.repeat_sketch(df, slices * filter_audit.SLICE_CELLS // filter_audit.CELLS_A_ROW)
    cells = filter_audit._cells(once, slices)
    seen = ((bits.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1)
    assert seen[:200].all() and (slices == 1 or seen[200:].mean() < 0.05)
