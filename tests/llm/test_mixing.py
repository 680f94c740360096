"""The mix takes rows for themselves, not by their doc_id."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import frames, mixing


@pytest.mark.parametrize("doc", [None, 7])
@pytest.mark.parametrize("rows_sent", [500_000, 0])
def test_rows_of_one_doc_id_meet_their_sources_targets(spark, doc, rows_sent, monkeypatch):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", rows_sent)
    rows = [(doc if i % 3 else i, f"text{i} one two three", "abc"[i % 3]) for i in range(900)] + [(doc, None, "a"), (doc, "  ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("mix_of", F.lit("x"))
    out = mixing.mixed_documents(docs, weights=(3, 1, 2), share=0.5)
    assert out.columns == docs.columns and out.filter("mix_of <> 'x'").isEmpty()
    words = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(mixing.word_count())).collect()}
    for source, target in mixing.mix(docs, weights=(3, 1, 2), share=0.5).select("source", "target").distinct().collect():
        assert abs(words[source] - target) <= 4
    assert out.filter(mixing.word_count() == 0).count() == 2
