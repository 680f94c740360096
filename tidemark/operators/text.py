"""Text scoring: TF-IDF, lexicon or model scores, and the sentiment screener."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shapes import polarity, top_label
from tidemark.operators.attach import attach_row
from tidemark.session import dealt_out, materialised

# A token is a run of letters, digits or underscores of this length.
NOT_TOKEN = r"[^\p{L}\p{N}_]+"
SHORTEST = 2
#: Rows of a word and a number up to which a side is sent to every task.
FEW_ROWS = 1_000_000
#: Words up to which a set of them is written into an expression.
FEW_WORDS = 5_000
# Report order of the sentiment categories.
CATEGORY_ORDER = ("negative", "neutral", "positive")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TOKEN), lambda w: F.length(w) >= SHORTEST)


def ngrams(words: Column, ngram: tuple[int, int] = (1, 2)) -> Column:
    """All n-grams of the token array, sizes from ``ngram[0]`` to ``ngram[1]``."""
    parts = []
    for n in range(ngram[0], ngram[1] + 1):
        if n == 1:
            parts.append(words)
            continue
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, 1, count)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(words, k + 1, count), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grams)
    return F.concat(*parts)


def is_words(df: DataFrame, text: str) -> bool:
    """Whether the column holds words, not a text."""
    return isinstance(df.schema[text].dataType, T.ArrayType)


def tokenised(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """The words of every text, written once for the passes that read them; a column of words is read as it is."""
    if is_words(df, text):
        return df.select(*keys, F.col(text).alias("words"))
    return materialised(dealt_out(df.select(*keys, text)).select(*keys, tokens(F.col(text)).alias("words")), "words")


def term_rows(words: DataFrame, keys: Sequence[str], ngram: tuple[int, int], only: Sequence[str] | None = None) -> DataFrame:
    """One row for every n-gram; with ``only``, for every one made of those words alone."""
    return words.select(*keys, F.explode(grams_of(F.col("words"), ngram, only)).alias("term"))


def grams_of(words: Column, ngram: tuple[int, int], only: Sequence[str] | None = None) -> Column:
    """The n-grams of a token array; with ``only``, those made of these words alone, the others are never built."""
    if only is None:
        return ngrams(words, ngram)
    # A gram with a null in it is null.
    known = F.transform(words, lambda w: F.when(w.isin(list(only)), w))
    return F.filter(ngrams(known, ngram), lambda g: g.isNotNull())


def sent(side: DataFrame, rows: int) -> DataFrame:
    """A side of at most so many short rows, broadcast if that is few enough."""
    return F.broadcast(side) if rows <= FEW_ROWS else side


def top_terms(words: DataFrame, keys: Sequence[str], ngram: tuple[int, int], max_features: int) -> DataFrame:
    """The most frequent terms, counted.

    A gram is no more frequent than any of its words, and the term that comes
    last is at least as frequent as the last of the most frequent words. So words
    are counted first, and longer grams only of words that are frequent enough.
    """
    only = None
    if ngram[0] == 1 < ngram[1] and max_features <= FEW_WORDS:
        single = materialised(term_rows(words, keys, (1, 1)).groupBy("term").agg(F.count(F.lit(1)).alias("n_total")), "word-counts")
        first = single.orderBy(F.col("n_total").desc(), "term").limit(max_features).agg(F.count(F.lit(1)), F.min("n_total")).first()
        # Fewer words than terms wanted leave no bound.
        frequent = single.filter(F.col("n_total") >= (first[1] if first[0] == max_features else 0)).limit(FEW_WORDS + 1).select("term").collect()
        only = [r["term"] for r in frequent] if len(frequent) <= FEW_WORDS else None
    if only is None:
        counts = term_rows(words, keys, ngram).groupBy("term").agg(F.count(F.lit(1)).alias("n_total"))
    else:
        longer = term_rows(words, keys, (2, ngram[1]), only).groupBy("term").agg(F.count(F.lit(1)).alias("n_total"))
        counts = single.unionByName(longer)
    return counts.orderBy(F.col("n_total").desc(), "term").limit(max_features)


def vocabulary(df: DataFrame, text: str, keys: Sequence[str], ngram: tuple[int, int] = (1, 2), max_features: int = 500) -> DataFrame:
    """The most frequent terms of the corpus; equal counts in alphabetical order."""
    return top_terms(tokenised(df, text, keys), keys, ngram, max_features)


def words_in(terms: DataFrame, max_features: int) -> list[str] | None:
    """The words that the terms are made of, if they are few."""
    if max_features > FEW_WORDS:
        return None
    return sorted({w for r in terms.select("term").collect() for w in r["term"].split(" ")})


def inverse_frequencies(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, idf) from one row for each document and term of ``words``, written."""
    doc_freq = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    n_docs = words.agg(F.count(F.lit(1)).alias("_n"))
    idf = attach_row(doc_freq, n_docs).select("term", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"))
    return materialised(idf, "idf")


def document_frequencies(words: DataFrame, keys: Sequence[str], ngram: tuple[int, int], max_features: int) -> tuple[DataFrame, DataFrame]:
    """(term, idf) of the vocabulary, and its terms counted per document, both written."""
    vocab = materialised(top_terms(words, keys, ngram, max_features).select("term"), "vocabulary")
    counts = materialised(term_counts(words, vocab, keys, ngram, max_features), "term-counts")
    return inverse_frequencies(counts, words), counts


def term_counts(words: DataFrame, vocab: DataFrame, keys: Sequence[str], ngram: tuple[int, int], max_features: int) -> DataFrame:
    rows = term_rows(words, keys, ngram, words_in(vocab, max_features))
    kept = rows.join(sent(vocab.select("term"), max_features), "term")
    return kept.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n_in_doc"))


def tfidf(
    df: DataFrame, text: str, keys: Sequence[str] = ("doc_id",), ngram: tuple[int, int] = (1, 2), max_features: int = 500,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Unit-length TF-IDF weights, long: ``keys, term, n_in_doc, idf, weight``.

    ``idf = ln((1 + n) / (1 + df)) + 1`` over the documents of ``fit_on``. Texts
    are split into words once. The vocabulary has at most ``max_features`` rows;
    terms outside it are dropped before anything but counts is shuffled.
    """
    keys = list(keys)
    words = tokenised(df, text, keys)
    train = words if fit_on is None else tokenised(fit_on, text, keys)
    idf, counts = document_frequencies(train, keys, ngram, max_features)
    rows = counts if fit_on is None else term_counts(words, idf, keys, ngram, max_features)
    raw = rows.join(sent(idf, max_features), "term").withColumn("_raw", F.col("n_in_doc") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", "n_in_doc", "idf", (F.col("_raw") / norm).alias("weight"))


def tfidf_vectors(
    df: DataFrame, text: str, keys: Sequence[str] = ("doc_id",), ngram: tuple[int, int] = (1, 2), max_features: int = 500,
    fit_on: DataFrame | None = None, out: str = "features",
) -> tuple[DataFrame, list[str]]:
    """``df`` with sparse unit-length TF-IDF vectors, and the terms their places stand for, in alphabetical order.

    Counting, weighting and scaling are Spark ML's own transformers on sparse
    vectors. A null text, or one without a word of the vocabulary, is all zeros.
    ``text`` may be a written column of words, which then is not split again.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    keys = list(keys)
    train = tokenised(df if fit_on is None else fit_on, text, keys)
    vocab = materialised(top_terms(train, keys, ngram, max_features).select("term"), "vocabulary")
    only = words_in(vocab, max_features)
    # A document's terms are told apart where its words are; only counts of documents are moved.
    each = train.select(F.explode(F.array_distinct(grams_of(F.col("words"), ngram, only))).alias("term"))
    idf = inverse_frequencies(each.join(sent(vocab, max_features), "term"), train)
    terms = {r["term"]: r["idf"] for r in idf.orderBy("term").collect()}
    words = F.col(text) if is_words(df, text) else tokens(F.col(text))
    grams = F.coalesce(grams_of(words, ngram, only), F.array().cast("array<string>"))
    rows = dealt_out(df).withColumn("_grams", grams)
    if not terms:
        return rows.withColumn(out, F.lit(None)).drop("_grams"), []
    counted = CountVectorizerModel.from_vocabulary(list(terms), inputCol="_grams", outputCol="_counts", minTF=1.0).transform(rows)
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(list(terms.values())), inputCol="_counts", outputCol="_raw").transform(counted)
    return Normalizer(p=2.0, inputCol="_raw", outputCol=out).transform(weighted).drop("_grams", "_counts", "_raw"), list(terms)


def as_vectors(weights: DataFrame, vocab: DataFrame, keys: Sequence[str], out: str = "features") -> DataFrame:
    """One vector per document; term numbers follow the alphabet of the bounded vocabulary."""
    from pyspark.ml.functions import array_to_vector

    listed = vocab.agg(F.array_sort(F.collect_list("term")).alias("_terms"))
    packed = weights.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("_w"))
    dense = F.transform("_terms", lambda t: F.coalesce(F.try_element_at("_w", t), F.lit(0.0)))
    return attach_row(packed, listed).select(*keys, array_to_vector(dense).alias(out))


def sentiment_from_probs(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Predicted label and P(positive) - P(negative) from a label-to-probability map."""
    p = F.col(probs)
    return df.withColumns({"predicted_label": top_label(p), "sentiment_score": polarity(p)})


def lexicon_probs(df: DataFrame, text: str, lexicon: DataFrame, keys: Sequence[str], out: str = "probs") -> DataFrame:
    """Class probabilities from a lexicon ``(word, weight)`` of signed weights.

    The shares of positive and negative weight per token go through a softmax
    together with the rest. A lexicon of at most ``FEW_ROWS`` words is looked up
    where the text is, in Arrow batches, so neither words nor texts are shuffled.
    Of a longer one the words used most, by a column ``n`` that says how often,
    are looked up so, and only those that are not among them are joined.
    """
    keys = list(keys)
    n = F.sum("n") if "n" in lexicon.columns else F.lit(1)
    merged = materialised(lexicon.groupBy("word").agg(F.sum("weight").cast("double").alias("weight"), n.cast("long").alias("n")), "lexicon")
    if merged.count() <= FEW_ROWS:
        joined = dealt_out(df).withColumn("_sums", _lexicon_sums(merged)(tokens(F.col(text)))).select(*df.columns, "_sums._pos", "_sums._neg", "_sums._all")
    else:
        least = _least_use(merged, FEW_ROWS)
        look = _lexicon_sums(merged.filter(F.col("n") >= least), rest=True)
        looked = dealt_out(df.select(*keys, text)).withColumn("_sums", look(tokens(F.col(text)))).select(*keys, "_sums.*")
        looked = materialised(looked, "looked-up")
        rest = looked.select(*keys, F.explode("_rest").alias("word"))
        rare = rest.join(merged.filter(F.col("n") < least).select("word", "weight"), "word")
        parts = [
            looked.select(*keys, "_pos", "_neg", "_all"),
            rare.select(*keys, F.greatest("weight", F.lit(0.0)).alias("_pos"), F.greatest(-F.col("weight"), F.lit(0.0)).alias("_neg"), F.lit(0).cast("long").alias("_all")),
        ]
        sums = parts[0].unionByName(parts[1]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_pos", "_neg", "_all")])
        joined = df.join(sums, keys, "left")
    pos = F.when(F.col("_all") > 0, F.col("_pos") / F.col("_all")).otherwise(0.0)
    neg = F.when(F.col("_all") > 0, F.col("_neg") / F.col("_all")).otherwise(0.0)
    e = {"negative": F.exp(neg), "neutral": F.exp(1 - pos - neg), "positive": F.exp(pos)}
    total = e["negative"] + e["neutral"] + e["positive"]
    pairs = [x for name in CATEGORY_ORDER for x in (F.lit(name), e[name] / total)]
    return joined.withColumn(out, F.create_map(*pairs)).drop("_pos", "_neg", "_all")


def _least_use(lexicon: DataFrame, rows: int) -> int:
    """The least ``n`` for which no more than so many words of the lexicon are used as often."""
    sizes = lexicon.groupBy("n").agg(F.count(F.lit(1)).alias("_words"))
    # No more different numbers than the square root of twice their sum.
    total, least = 0, None
    for r in sizes.orderBy(F.col("n").desc()).toLocalIterator():
        total += r["_words"]
        if total > rows:
            break
        least = r["n"]
    return least if least is not None else 2**62


def _lexicon_sums(lexicon: DataFrame, rest: bool = False) -> Callable[[Column], Column]:
    """Column function: sums of positive and negative weights, and the number, of an array of words; and the words not found."""
    table = lexicon.orderBy("word").select("word", "weight").toArrow()
    shared = lexicon.sparkSession.sparkContext.broadcast((table.column("word").combine_chunks(), table.column("weight").to_numpy()))

    @F.pandas_udf("_pos double, _neg double, _all long" + ", _rest array<string>" * rest)
    def sums(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, weights = shared.value
        for words in batches:
            lists = pa.array(words, pa.list_(pa.string()))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
            w = np.where(at >= 0, weights[np.maximum(at, 0)], 0.0) if len(weights) else np.zeros(len(at))
            row = np.repeat(np.arange(len(sizes)), sizes)
            out = pd.DataFrame({"_pos": np.bincount(row, np.maximum(w, 0.0), len(sizes)), "_neg": np.bincount(row, np.maximum(-w, 0.0), len(sizes)), "_all": sizes})
            if rest:
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[at < 0], minlength=len(sizes)))])
                left = flat.filter(pa.array(at < 0)).to_pylist()
                out["_rest"] = [left[i:j] for i, j in zip(ends[:-1], ends[1:])]
            yield out

    return sums


def score_text(
    df: DataFrame, text: str, scorer: DataFrame | Callable, keys: Sequence[str] = ("doc_id",), labels: Sequence[str] = CATEGORY_ORDER,
    batch_size: int = 16,
) -> DataFrame:
    """Sentiment label and score per text.

    ``scorer`` is a lexicon, or a function that loads a model once per Python
    worker and returns a batch function (texts in, one probability per label
    out), which Spark feeds in batches.
    """
    if isinstance(scorer, DataFrame):
        scored = lexicon_probs(df, text, scorer, keys)
    else:
        from pyspark.ml.functions import predict_batch_udf

        predict = predict_batch_udf(scorer, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
        names = F.array(*[F.lit(v) for v in labels])
        scored = df.withColumn("probs", F.map_from_arrays(names, predict(F.col(text))))
    return sentiment_from_probs(scored)


def category_rank(label: Column) -> Column:
    rank = F.when(F.lit(False), -1)
    for i, name in enumerate(CATEGORY_ORDER):
        rank = rank.when(label == name, i)
    return rank


def volume_by_category(df: DataFrame, label: str = "predicted_label", score: str = "sentiment_score", volume: str = "volume") -> DataFrame:
    """Mean volume and score per sentiment category, in report order."""
    rows = df.filter(F.col(label).isin(*CATEGORY_ORDER)).groupBy(label).agg(
        F.avg(volume).alias("avg_volume"), F.avg(score).alias("avg_sentiment"), F.count(F.lit(1)).alias("n_headlines")
    )
    return rows.orderBy(category_rank(F.col(label)))


def sentiment_screener(df: DataFrame, group: str = "ticker", score: str = "sentiment_score", volume: str = "volume") -> DataFrame:
    """Mean score and volume per group, most positive first."""
    rows = df.groupBy(group).agg(
        F.avg(score).alias("avg_sentiment"), F.avg(volume).alias("avg_volume"), F.count(F.lit(1)).alias("n_headlines")
    )
    return rows.orderBy(F.col("avg_sentiment").desc(), group)
