"""Queries on texts: TF-IDF, lexicon scores and the screener."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.operators import text as X
from tidemark.plans import views as V
from tidemark.plans.registry import big, num, nums, query, shown
from tidemark.session import materialised

TOKEN_SQL = r"""tk AS (SELECT doc_id, regexp_extract_all(lower(headline), '[\p{L}\p{N}_]{2,}') AS w FROM texts),
uni AS (SELECT doc_id, unnest(w) AS term FROM tk),
bi AS (SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2])) AS term FROM tk WHERE len(w) > 1),
terms AS (SELECT * FROM uni UNION ALL SELECT * FROM bi),
vocab AS (SELECT term FROM (SELECT term, count(*) AS n FROM terms GROUP BY term) ORDER BY n DESC, term LIMIT 500),
tf AS (SELECT doc_id, term, count(*) AS n FROM terms JOIN vocab USING (term) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term)"""


@query("tfidf", f"""WITH {V.TEXTS_SQL}, {TOKEN_SQL}
SELECT doc_id, term, {big('n', 'n_in_doc')}, {nums('idf')}, {num('n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id))', 'weight')} FROM tf JOIN idf USING (term)""")
def tfidf(spark, sf):
    return shown(X.tfidf(V.headlines(spark, sf), "headline"))


@query("tfidf_vectors", f"""WITH {V.TEXTS_SQL}, {TOKEN_SQL}, names AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM idf)
SELECT doc_id, {big('place')}, {num('n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id))', 'weight')} FROM tf JOIN idf USING (term) JOIN names USING (term)""")
def tfidf_vectors(spark, sf):
    """The places and values of the sparse vectors that the text models read."""
    from pyspark.ml.functions import vector_to_array

    vectors, _ = X.tfidf_vectors(X.tokenised(V.headlines(spark, sf), "headline", ["doc_id"]), "words")
    cells = vectors.select("doc_id", F.posexplode(vector_to_array("features")).alias("place", "weight"))
    return shown(cells.filter("weight <> 0"))


LEXICON_SQL = """lex AS (SELECT term AS word, CASE WHEN avg(quality) >= (SELECT avg(quality) FROM texts) THEN 1.0 ELSE -1.0 END AS weight
  FROM (SELECT DISTINCT doc_id, term FROM uni) JOIN texts USING (doc_id) WHERE quality IS NOT NULL GROUP BY term)"""


def quality_lexicon(spark, sf):
    """All words of labelled texts, signed by the mean quality of the texts that use them."""
    docs = V.texts(spark, sf)
    labelled = docs.filter(F.col("quality").isNotNull())
    overall = labelled.agg(F.avg("quality")).first()[0]
    words = labelled.select("quality", F.explode(F.array_distinct(X.tokens(F.col("headline")))).alias("word"))
    rows = words.groupBy("word")
    return rows.agg(F.when(F.avg("quality") >= overall, 1.0).otherwise(-1.0).alias("weight"), F.count(F.lit(1)).alias("n"))


SCORE_SQL = f"""{TOKEN_SQL}, {LEXICON_SQL},
cnt AS (SELECT doc_id, term, count(*) AS n FROM uni GROUP BY ALL),
sm AS (SELECT doc_id, sum(greatest(coalesce(weight, 0) * n, 0)) / sum(n) AS pos, sum(greatest(-coalesce(weight, 0) * n, 0)) / sum(n) AS neg FROM cnt LEFT JOIN lex ON word = term GROUP BY doc_id),
ex AS (SELECT texts.*, exp(coalesce(neg, 0)) AS en, exp(1 - coalesce(pos, 0) - coalesce(neg, 0)) AS eu, exp(coalesce(pos, 0)) AS ep FROM texts LEFT JOIN sm USING (doc_id)),
pr AS (SELECT *, en / (en + eu + ep) AS negative, eu / (en + eu + ep) AS neutral, ep / (en + eu + ep) AS positive FROM ex),
scored AS (SELECT *, positive - negative AS sentiment_score,
  CASE WHEN negative >= neutral AND negative >= positive THEN 'negative' WHEN neutral >= positive THEN 'neutral' ELSE 'positive' END AS predicted_label FROM pr)"""


def scored(spark, sf):
    lexicon = materialised(quality_lexicon(spark, sf), "lexicon")
    return X.score_text(V.headlines(spark, sf), "headline", lexicon)


@query("text_scores", f"""WITH {V.TEXTS_SQL}, {SCORE_SQL}
SELECT doc_id, predicted_label, {nums('sentiment_score negative neutral positive')} FROM scored""")
def text_scores(spark, sf):
    """Every document's class probabilities, label and score by lexicon."""
    out = scored(spark, sf)
    return shown(out.select("doc_id", "predicted_label", "sentiment_score", *[F.col("probs")[c].alias(c) for c in X.CATEGORY_ORDER]))


@query("ticker_screener", f"""WITH {V.TEXTS_SQL}, {SCORE_SQL}
SELECT ticker, {num('avg(sentiment_score)', 'avg_sentiment')}, {num('avg(volume)', 'avg_volume')}, {big('count(*)', 'n_headlines')} FROM scored GROUP BY ticker""")
def ticker_screener(spark, sf):
    return shown(X.sentiment_screener(scored(spark, sf)))


@query("volume_by_sentiment", f"""WITH {V.TEXTS_SQL}, {SCORE_SQL}
SELECT predicted_label, {num('avg(volume)', 'avg_volume')}, {num('avg(sentiment_score)', 'avg_sentiment')}, {big('count(*)', 'n_headlines')} FROM scored GROUP BY predicted_label""")
def volume_by_sentiment(spark, sf):
    return shown(X.volume_by_category(scored(spark, sf)))


@query("sentiment_from_probabilities", f"""WITH p AS (SELECT doc_id, quality, toxic, 0.2 + 0.5 * quality AS positive, 0.1 + 0.6 * toxic AS negative, 0.35 AS neutral FROM labels)
SELECT doc_id, CASE WHEN negative >= neutral AND negative >= positive THEN 'negative' WHEN neutral >= positive THEN 'neutral' ELSE 'positive' END AS predicted_label,
  {num('positive - negative', 'sentiment_score')} FROM p""")
def sentiment_from_probabilities(spark, sf):
    """Label and score from a map whose keys come in any case."""
    probs = F.create_map(
        F.lit("Positive"), 0.2 + 0.5 * F.col("quality"), F.lit("NEGATIVE"), 0.1 + 0.6 * F.col("toxic"), F.lit("neutral"), F.lit(0.35)
    )
    out = X.sentiment_from_probs(V.table(spark, sf, "labels").withColumn("probs", probs))
    return shown(out.select("doc_id", "predicted_label", "sentiment_score"))


@query("stratified_rows", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY substr(md5('42:' || doc_id), 1, 15), doc_id) AS place, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT {big('doc_id')}, {big('quality')}, CASE WHEN place <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_rows(spark, sf):
    """Which labelled texts a seeded split with equal test shares puts where."""
    return shown(splits.stratified_split(V.table(spark, sf, "labels"), "quality", ["doc_id"]).select("doc_id", "quality", "split"))


@query("stratified_split", f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT {big('quality')}, 'test' AS split, {big('ceil(n * 0.25)', 'n_rows')} FROM c UNION ALL SELECT {big('quality')}, 'train', {big('n - ceil(n * 0.25)', 'n_rows')} FROM c""")
def stratified_split(spark, sf):
    """Class sizes of a seeded split with equal test shares."""
    out = splits.stratified_split(V.table(spark, sf, "labels"), "quality", ["doc_id"])
    return shown(out.groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n_rows")))


@query("model_scored_texts")
def model_scored_texts(spark, sf):
    """Documents through the pluggable batch scorer, here a character-class model."""

    def load_model():
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def predict(texts):
            column = pa.array(texts, pa.string())
            size = pc.add(pc.utf8_length(column), 1).to_numpy()
            letters = pc.count_substring_regex(column, r"\p{L}").to_numpy() / size
            digits = pc.count_substring_regex(column, r"\p{Nd}").to_numpy() / size
            return np.stack([digits, 1.0 - letters - digits, letters], axis=1)

        return predict

    out = X.score_text(V.headlines(spark, sf), "headline", load_model)
    return shown(out.select("doc_id", "predicted_label", "sentiment_score"))
