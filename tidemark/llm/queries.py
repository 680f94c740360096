"""The registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, filter_audit, fm_index, jaccard_join, mixing, prefix_trie, recompression, recurrent_lm, sharding, suffix_dedup, toxicity, url_filter, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_ngram_jaccard_join(spark, sf_dir):
    """Components of texts whose sets of 4-word shingles have a similarity of 0.85."""
    return jaccard_join.similar_texts(_table(spark, sf_dir, "documents"), k=4, percent=85)


@_query
def op3_substring_recompression(spark, sf_dir):
    """Words outside of 50-word windows that a lesser doc_id has as well."""
    out = recompression.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op6_benchmark_fm_index(spark, sf_dir):
    """Words of each text inside 10-word windows of benchmark items, and those items."""
    out = fm_index.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@_query
def op10_suffix_array_dedup(spark, sf_dir):
    """Bytes of each text outside of 200-byte strings that start anywhere else."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op7_toxicity_factorization(spark, sf_dir):
    """Toxicity scores of all texts, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query
def op1_chat_formatting(spark, sf_dir):
    """Conversations that no other one continues, rendered."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


@_query
def op4_mix_sources(spark, sf_dir):
    """How many words of each document a mix of all sources takes."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op5_hilbert_sharding(spark, sf_dir):
    """Shards and slots of all documents along a Hilbert curve."""
    return sharding.shard(_table(spark, sf_dir, "documents"), keep=["doc_id"])


@_query
def op8_pstable_embeddings(spark, sf_dir):
    """Links and components of embeddings with a cosine of at least 0.98."""
    return vector_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


@_query
def op9_url_trees(spark, sf_dir):
    """Verdicts on all page URLs by rules and boosted trees."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


@_query
def op11_filter_audit(spark, sf_dir):
    """What five filters remove from each language, in every order."""
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op12_recurrent_lm(spark, sf_dir):
    """Likelihoods of all texts by a gated recurrent model and by smoothed unigrams."""
    return recurrent_lm.score_texts(_table(spark, sf_dir, "documents"))


@_query
def op13_prefix_trie(spark, sf_dir):
    """All beginnings of the rebuilt conversations, from a z-fast trie."""
    return prefix_trie.prefix_nodes(_table(spark, sf_dir, "conversations"))


ORACLES["op1_chat_formatting"] = chat.ORACLE
ORACLES["op11_filter_audit"] = filter_audit.ORACLE
ORACLES["op13_prefix_trie"] = prefix_trie.ORACLE

#: Words of a text as the contracts part them, in DuckDB.
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLES["op3_substring_recompression"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM g),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (h) WHERE first < doc_id),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.p) AS kept, count(*) AS n FROM o ANTI JOIN r ON o.doc_id = r.doc_id AND o.p = r.p GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""

ORACLES["op4_mix_sources"] = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (weights - coalesce(sum(weight) OVER o, 0)) AS level FROM c
    WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, coalesce(least(v.level * weight, cap), cap) AS target FROM l, v),
b AS (SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS budget FROM t),
p AS (SELECT d.*, source_size, target, budget // greatest(source_size, 1) AS times, budget - budget // greatest(source_size, 1) * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (times * size + least(greatest(rest - before, 0), size))::BIGINT AS taken FROM p"""

ORACLES["op6_benchmark_fm_index"] = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, unnest(range(1, greatest(len(w) - 8, 2))) AS i, w FROM b WHERE len(w) > 0),
q AS (SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase FROM n),
z AS (SELECT DISTINCT size FROM q),
g AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, z WHERE len(w) >= size),
k AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM g),
h AS (SELECT doc_id, k.size, i, item_id FROM k JOIN q USING (phrase)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)"""
