"""Queries on splits, folds and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import features as X
from tidemark.operators import splits
from tidemark.operators.audit import audit_lookahead
from tidemark.functions import series as S
from tidemark.plans import views as V
from tidemark.plans.registry import big, day, num, nums, query, shown
from tidemark.plans.series import RETURNS_SQL, W, returns

NUMBERED = f"""n AS (SELECT series_id, date, price, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM panel)"""


@query("chronological_split", f"""WITH {V.PANEL_SQL}, {NUMBERED},
s AS (SELECT *, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train' WHEN idx < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM n)
SELECT series_id, split, {big('count(*)', 'n_rows')}, {day('min(date)', 'first_day')}, {day('max(date)', 'last_day')} FROM s GROUP BY series_id, split""")
def chronological_split(spark, sf):
    out = splits.chronological_split(V.panel(spark, sf), ts="date")
    return shown(out.groupBy("series_id", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    ))


def _fold_sizes(rows):
    return rows.groupBy("series_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row")
    )


@query("walk_forward_folds", f"""WITH {V.PANEL_SQL}, {NUMBERED}, k AS (SELECT k FROM range(5) AS r(k)),
f AS (SELECT series_id, idx, k, floor(n * 0.5::DOUBLE) + k * floor((n - floor(n * 0.5::DOUBLE)) / 5) AS ts, CASE WHEN k = 4 THEN n ELSE floor(n * 0.5::DOUBLE) + (k + 1) * floor((n - floor(n * 0.5::DOUBLE)) / 5) END AS te FROM n, k),
r AS (SELECT series_id, idx, k, CASE WHEN idx < floor(ts * (1 - 0.15::DOUBLE)) THEN 'train' WHEN idx < ts THEN 'val' WHEN idx < te THEN 'test' END AS role FROM f)
SELECT series_id, {big('k', 'fold')}, role, {big('count(*)', 'n_rows')}, {big('min(idx)', 'first_row')}, {big('max(idx)', 'last_row')} FROM r WHERE role IS NOT NULL GROUP BY series_id, k, role""")
def walk_forward_folds(spark, sf):
    out = splits.assign_folds(V.panel(spark, sf), ts="date")
    return shown(_fold_sizes(out))


@query("time_series_folds", f"""WITH {V.PANEL_SQL}, {NUMBERED}, k AS (SELECT k FROM range(4) AS r(k)),
f AS (SELECT series_id, idx, k, n // 5 AS size, n - (4 - k) * (n // 5) AS start FROM n, k),
r AS (SELECT series_id, idx, k, CASE WHEN idx < start THEN 'train' WHEN idx < start + size THEN 'test' END AS role FROM f)
SELECT series_id, {big('k', 'fold')}, role, {big('count(*)', 'n_rows')}, {big('min(idx)', 'first_row')}, {big('max(idx)', 'last_row')} FROM r WHERE role IS NOT NULL GROUP BY series_id, k, role""")
def time_series_folds(spark, sf):
    out = splits.expanding_folds(V.panel(spark, sf), ts="date")
    return shown(_fold_sizes(out))


@query("standardised_returns", f"""WITH {RETURNS_SQL}, {NUMBERED}, t AS (SELECT r.series_id, r.date, r.ret, idx < floor(n * 0.8::DOUBLE) AS train FROM rets r JOIN n USING (series_id, date)),
s AS (SELECT series_id, avg(ret) AS m, stddev_pop(ret) AS sd FROM t WHERE train GROUP BY series_id)
SELECT series_id, {day('date', 'date')}, CASE WHEN train THEN 'train' ELSE 'test' END AS split, {num('(ret - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 'ret')} FROM t JOIN s USING (series_id)""")
def standardised_returns(spark, sf):
    """Scaling learnt on the first 80 percent, applied to both parts."""
    rows = splits.chronological_split(returns(spark, sf), (0.8, 0.2), ("train", "test"), ts="date", slots=False)
    train, test = splits.standardize(rows.filter("split = 'train'"), rows.filter("split = 'test'"), cols=["ret"], by=["series_id"])
    return shown(train.unionByName(test).select("series_id", "date", "split", "ret"))


PRED_SQL = """pred AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity > 34 THEN 'A' WHEN l_quantity > 17 THEN 'N' ELSE 'R' END AS guess,
  l_returnflag = 'R' AS is_r, round(l_extendedprice / 1000, 1) AS score, l_linestatus FROM lineitem)"""


def predictions(spark, sf):
    """Order lines with a class guessed from the quantity and a coarse score."""
    q = F.col("l_quantity")
    return V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("truth"), F.when(q > 34, "A").when(q > 17, "N").otherwise("R").alias("guess"),
        (F.col("l_returnflag") == "R").alias("is_r"), F.round(F.col("l_extendedprice") / 1000, 1).alias("score"), "l_linestatus",
    )


@query("binary_metrics", f"""WITH {PRED_SQL}, c AS (SELECT l_linestatus, count(*) FILTER (is_r AND guess = 'R') AS tp, count(*) FILTER (NOT is_r AND guess = 'R') AS fp,
  count(*) FILTER (is_r AND guess <> 'R') AS fn, count(*) FILTER (NOT is_r AND guess <> 'R') AS tn FROM pred GROUP BY l_linestatus)
SELECT l_linestatus, {big('tp')}, {big('fp')}, {big('fn')}, {big('tn')}, {num('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {num('tp / (tp + fp)', 'precision')},
  {num('tp / (tp + fn)', 'recall')}, {num('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM c""")
def binary_metrics(spark, sf):
    rows = predictions(spark, sf).withColumn("flag", F.col("guess") == "R")
    return shown(E.binary_metrics(rows, "is_r", "flag", ["l_linestatus"]))


CM_SQL = "lab AS (SELECT l FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS v(l)), cm AS (SELECT a.l AS truth, b.l AS guess, count(p.truth) AS n FROM lab a CROSS JOIN lab b LEFT JOIN pred p ON p.truth = a.l AND p.guess = b.l GROUP BY ALL)"


@query("confusion_matrix", f"""WITH {PRED_SQL}, {CM_SQL}
SELECT truth, guess AS pred, {big('n', 'n_rows')}, {num('coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0)', 'row_share')} FROM cm""")
def confusion_matrix(spark, sf):
    """Counts of all label pairs, with a label that never occurs."""
    return shown(E.confusion(predictions(spark, sf), "truth", "guess", ["A", "N", "R", "X"]))


@query("multiclass_metrics", f"""WITH {PRED_SQL}, {CM_SQL},
c AS (SELECT l AS label, (SELECT sum(n) FROM cm WHERE truth = l) AS support, (SELECT sum(n) FROM cm WHERE guess = l) AS np, (SELECT n FROM cm WHERE truth = l AND guess = l) AS hit FROM lab),
m AS (SELECT label, support, hit, coalesce(hit / nullif(np, 0), 0) AS precision_, coalesce(hit / nullif(support, 0), 0) AS recall_, coalesce(2 * hit / nullif(np + support, 0), 0) AS f1 FROM c)
SELECT label, {big('support')}, {num('precision_', 'precision')}, {num('recall_', 'recall')}, {nums('f1')}, {num('sum(hit) OVER () / sum(support) OVER ()', 'accuracy')}, {num('avg(f1) OVER ()', 'macro_f1')} FROM m""")
def multiclass_metrics(spark, sf):
    return shown(E.multiclass_metrics(predictions(spark, sf), "truth", "guess", ["A", "N", "R", "X"]))


ROC_SQL = f"""{PRED_SQL}, d AS (SELECT score, count(*) FILTER (is_r) AS p, count(*) FILTER (NOT is_r) AS q FROM pred GROUP BY score),
cu AS (SELECT *, sum(p) OVER o AS cp, sum(q) OVER o AS cq, sum(p) OVER () AS ap, sum(q) OVER () AS aq FROM d WINDOW o AS (ORDER BY score DESC))"""


@query("roc_curve", f"WITH {ROC_SQL} SELECT {num('score', 'threshold')}, {num('cp / ap', 'tpr')}, {num('cq / aq', 'fpr')} FROM cu")
def roc_curve(spark, sf):
    return shown(E.roc_curve(predictions(spark, sf), "is_r", "score").select("threshold", "tpr", "fpr"))


@query("roc_auc", f"WITH {ROC_SQL} SELECT {num('sum(q * (cp - p + cp) / 2) / (max(ap) * max(aq))', 'roc_auc')} FROM cu")
def roc_auc(spark, sf):
    return shown(E.roc_auc(predictions(spark, sf), "is_r", "score"))


REG_SQL = f"""{RETURNS_SQL}, g AS (SELECT series_id, ret / 100 AS y, lag(ret) OVER w / 100 AS p FROM rets {W}), v AS (SELECT * FROM g WHERE y IS NOT NULL AND p IS NOT NULL)"""


def return_forecasts(spark, sf):
    """Yesterday's return as the forecast of today's."""
    rows = returns(spark, sf).select("series_id", (F.col("ret") / 100).alias("y"), (F.lag("ret").over(S.ordered(ts="date")) / 100).alias("p"))
    return rows.na.drop()


@query("regression_metrics", f"""WITH {REG_SQL}
SELECT series_id, {num('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {num('avg(abs(y - p))', 'mae')}, {num('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 'r2')},
  {num('sqrt(avg((y - 0.01) * (y - 0.01)))', 'baseline_rmse')}, {num('(1 - sqrt(avg((y - p) * (y - p))) / sqrt(avg((y - 0.01) * (y - 0.01)))) * 100', 'reduction_pct')}, {big('count(*)', 'n_test')},
  {num('avg(CASE WHEN abs(y - p) <= 0.05 THEN 0.5 * (y - p) * (y - p) ELSE 0.05 * (abs(y - p) - 0.025) END)', 'huber')} FROM v GROUP BY series_id""")
def regression_metrics(spark, sf):
    rows = return_forecasts(spark, sf)
    table = E.regression_metrics(rows, "y", "p", 0.01, by=["series_id"])
    return shown(table.join(E.huber_metric(rows, "y", "p", 0.05, by=["series_id"]), "series_id"))


@query("model_leaderboard", f"""WITH {PRED_SQL}, b AS (SELECT 'quantity' AS model, l_linestatus AS part, avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END) AS acc FROM pred GROUP BY l_linestatus
  UNION ALL SELECT 'always_n', l_linestatus, avg(CASE WHEN truth = 'N' THEN 1.0 ELSE 0.0 END) FROM pred GROUP BY l_linestatus)
SELECT part, {num('max(acc)', 'accuracy')}, arg_max(model, acc) AS model FROM b GROUP BY part""")
def model_leaderboard(spark, sf):
    """Metric tables of two models under each other; the better one per part."""
    rows = predictions(spark, sf)

    def table(name, hit):
        return rows.groupBy(F.col("l_linestatus").alias("part")).agg(F.avg(hit.cast("double")).alias("accuracy")).withColumn("model", F.lit(name))

    board = E.leaderboard(table("quantity", F.col("truth") == F.col("guess")), table("always_n", F.col("truth") == "N"))
    return shown(E.choose_variant(board, "model", "accuracy", by=["part"]))


@query("class_balance", f"""SELECT l_linestatus, l_returnflag, {big('count(*)', 'n_rows')}, {num('count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus)', 'share')} FROM lineitem GROUP BY l_linestatus, l_returnflag""")
def class_balance(spark, sf):
    return shown(splits.class_balance(V.table(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus"]))


@query("lookahead_audit", f"""WITH {V.PANEL_SQL}, c AS (SELECT count(*) AS n FROM panel WHERE date <= TIMESTAMP '1999-01-01')
SELECT 'trailing features' AS transform, {big('0', 'n_changed')} UNION ALL SELECT 'whole-sample score', {big('n', 'n_changed')} FROM c""")
def lookahead_audit(spark, sf):
    """Trailing features pass the audit; a whole-sample score is caught on every row."""
    df = V.panel(spark, sf)
    cutoff = F.to_timestamp(F.lit("1999-01-01"))
    keys = ["series_id", "date"]

    def whole(d):
        return splits.zscore_flag(d, "price").select(*keys, "zscore")

    trailing = audit_lookahead(lambda d: X.lagged_features(d, dropna=False), df, cutoff, keys, "date")
    leaking = audit_lookahead(whole, df, cutoff, keys, "date", tol=1e-15)
    counted = [
        rows.agg(F.count(F.lit(1)).alias("n_changed")).withColumn("transform", F.lit(name))
        for name, rows in (("trailing features", trailing), ("whole-sample score", leaking))
    ]
    return shown(counted[0].unionByName(counted[1]))
