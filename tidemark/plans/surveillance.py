"""Queries on order books, alert budgets and anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.shapes import alert_outcome
from tidemark.operators import anomaly as A
from tidemark.operators import book as Bk
from tidemark.operators import evaluate as E
from tidemark.operators import quantiles as Q
from tidemark.operators.splits import assign_refit_windows, zscore_flag
from tidemark.plans import views as V
from tidemark.plans.registry import big, day, num, nums, query, shown
from tidemark.session import materialised

TS = "snapshot_id"

TOTALS_SQL = f"""{V.BOOK_SQL},
totals AS (SELECT series_id, snapshot_id, sum(CASE WHEN side = 'bid' THEN size END) AS total_bid_depth, sum(CASE WHEN side = 'ask' THEN size END) AS total_ask_depth,
  max(CASE WHEN side = 'bid' AND level = 0 THEN size END) AS bid_size, max(CASE WHEN side = 'ask' AND level = 0 THEN size END) AS ask_size,
  sum(placed) AS num_orders_placed, sum(canceled) AS num_orders_canceled, sum(executed) AS num_orders_executed, avg(price_impact) AS price_impact FROM book GROUP BY ALL),
book_rows AS (SELECT *, (total_bid_depth - total_ask_depth) / (total_bid_depth + total_ask_depth) AS order_book_imbalance,
  num_orders_canceled / (num_orders_executed + 1) AS cancel_to_trade_ratio, num_orders_canceled > num_orders_executed AS truth FROM totals)"""


def totals(spark, sf, levels=None):
    """Snapshot totals; more cancellations than executions is the truth to find."""
    out = Bk.book_totals(V.book_levels(spark, sf) if levels is None else levels, means=["price_impact"])
    return out.withColumn("truth", F.col("num_orders_canceled") > F.col("num_orders_executed"))


@query("book_totals", f"""WITH {TOTALS_SQL}
SELECT series_id, {day('snapshot_id', 'snapshot_id')}, {nums('total_bid_depth total_ask_depth bid_size ask_size price_impact order_book_imbalance cancel_to_trade_ratio')},
  {big('num_orders_placed')}, {big('num_orders_canceled')}, {big('num_orders_executed')}, truth FROM book_rows""")
def book_totals(spark, sf):
    return shown(totals(spark, sf))


_LV = "(PARTITION BY series_id, side, level ORDER BY snapshot_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_TOP = "(PARTITION BY series_id ORDER BY snapshot_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
FEATURE_SQL = f"""{TOTALS_SQL},
dl AS (SELECT *, coalesce(size - lag(size) OVER (PARTITION BY series_id, side, level ORDER BY snapshot_id), 0) AS delta FROM book),
ds AS (SELECT *, CASE WHEN count(*) OVER {_LV} >= 5 THEN stddev_samp(delta) OVER {_LV} END AS sd FROM dl),
gs AS (SELECT series_id, side, level, CASE WHEN coalesce(stddev_samp(delta), 0) = 0 THEN 1.0 ELSE stddev_samp(delta) END AS gsd FROM dl GROUP BY ALL),
lv AS (SELECT ds.*, delta / greatest(coalesce(sd, gsd), 1e-6) AS size_velocity, canceled / (executed + 1) AS cancel_ratio FROM ds JOIN gs USING (series_id, side, level)),
sn AS (SELECT series_id, snapshot_id, max(CASE WHEN level = 0 THEN size END) AS top_size, {', '.join(f"max(CASE WHEN side = '{s}' AND level = {v} THEN {f} END) AS {s}_{f}_l{v}" for f in ('cancel_ratio', 'size_velocity') for s in Bk.SIDES for v in range(5))},
  max(cancel_ratio) AS max_cancel_ratio_across_levels, max(abs(size_velocity)) AS max_size_velocity_across_levels FROM lv GROUP BY ALL),
gm AS (SELECT series_id, avg(top_size) AS gmean FROM sn GROUP BY series_id),
ra AS (SELECT *, coalesce(CASE WHEN count(*) OVER {_TOP} >= 10 THEN avg(top_size) OVER {_TOP} END, gmean) AS rolling_avg_size FROM sn JOIN gm USING (series_id)),
bf AS (SELECT *, top_size / nullif(rolling_avg_size, 0) AS top_level_size_ratio FROM ra)"""

ALL_FEATURES = ["top_level_size_ratio", *Bk.level_columns(), "max_cancel_ratio_across_levels", "max_size_velocity_across_levels"]


@query("book_features", f"WITH {FEATURE_SQL} SELECT series_id, {day('snapshot_id', 'snapshot_id')}, {nums('top_size rolling_avg_size ' + ' '.join(ALL_FEATURES))} FROM bf")
def book_features(spark, sf):
    """Level features on blocks of the history."""
    out = Bk.book_features(V.book_levels(spark, sf), block_rows=1_000)
    return shown(out.select("series_id", TS, "top_size", "rolling_avg_size", *ALL_FEATURES))


def scored(spark, sf):
    """Feature rows with snapshot totals and truth."""
    levels = materialised(V.book_levels(spark, sf), "levels")
    feats = Bk.book_features(levels)
    return feats.join(totals(spark, sf, levels), ["series_id", TS]).fillna(0.0, subset=ALL_FEATURES)


SCORE_SQL = f"{FEATURE_SQL}, sc AS (SELECT round(max_size_velocity_across_levels + 3.1e-9, 6) AS score, * FROM bf JOIN book_rows USING (series_id, snapshot_id))"


def velocity_scores(spark, sf):
    rows = scored(spark, sf).withColumn("score", F.round(F.col("max_size_velocity_across_levels") + 3.1e-9, 6))
    return rows.select("series_id", TS, "score", "truth", "order_book_imbalance", "cancel_to_trade_ratio", "price_impact")


BUDGET_SQL = ", ".join(f"({b})" for b in E.BUDGETS)


@query("alert_budgets", f"""WITH {SCORE_SQL}, b AS (SELECT b FROM (VALUES {BUDGET_SQL}) AS v(b)),
t AS (SELECT b, (SELECT list_sort(list(score)) FROM sc) AS l FROM b),
h AS (SELECT b, l, (len(l) - 1) * (1 - b::DOUBLE) AS h FROM t),
c AS (SELECT b, l[floor(h)::BIGINT + 1] + (h - floor(h)) * (l[least(floor(h)::BIGINT + 2, len(l))] - l[floor(h)::BIGINT + 1]) AS cut FROM h),
m AS (SELECT b, cut, count(*) FILTER (score >= cut) AS n_flagged, count(*) FILTER (score >= cut AND truth) AS tp, count(*) FILTER (truth) AS pos FROM c, sc GROUP BY b, cut),
p AS (SELECT *, tp / nullif(n_flagged, 0) AS precision_, tp / nullif(pos, 0) AS recall_ FROM m)
SELECT {num('b::DOUBLE * 100', 'budget_pct')}, {num('cut', 'threshold')}, {big('n_flagged')}, {num('coalesce(precision_, 0)', 'precision')}, {num('coalesce(recall_, 0)', 'recall')},
  {num('coalesce(2 * precision_ * recall_ / nullif(precision_ + recall_, 0), 0)', 'f1')} FROM p""")
def alert_budgets(spark, sf):
    """Precision and recall at every alert budget."""
    return shown(E.precision_at_budget(materialised(velocity_scores(spark, sf), "scores"), "score", "truth"))


@query("ranked_budgets", f"""WITH {SCORE_SQL}, b AS (SELECT b FROM (VALUES {BUDGET_SQL}) AS v(b)),
t AS (SELECT b, (SELECT list_sort(list(score)) FROM sc) AS l FROM b),
h AS (SELECT b, l, (len(l) - 1) * (1 - b::DOUBLE) AS h FROM t),
c AS (SELECT b, l[floor(h)::BIGINT + 1] + (h - floor(h)) * (l[least(floor(h)::BIGINT + 2, len(l))] - l[floor(h)::BIGINT + 1]) AS cut FROM h),
m AS (SELECT b, count(*) FILTER (score >= cut) AS n_flagged, count(*) FILTER (score >= cut AND truth) AS tp, count(*) FILTER (truth) AS pos FROM c, sc GROUP BY b, cut),
f AS (SELECT {num('b::DOUBLE * 100', 'budget_pct')}, {num('coalesce(2.0 * tp / nullif(n_flagged + pos, 0), 0)', 'f1')} FROM m)
SELECT budget_pct, f1, row_number() OVER (ORDER BY f1 DESC, budget_pct) AS rank FROM f""")
def ranked_budgets(spark, sf):
    """Alert budgets by their F1."""
    table = shown(E.precision_at_budget(materialised(velocity_scores(spark, sf), "scores"), "score", "truth"))
    return shown(E.ranked(table, "f1", ["budget_pct"]).select("budget_pct", "f1", "rank"))


@query("walk_forward_sweeps")
def walk_forward_sweeps(spark, sf):
    """Budget sweeps of the forest fitted on everything and of forests refit on the past, on the same snapshots."""
    rows = materialised(scored(spark, sf).select("series_id", TS, "truth", *FOREST_COLS), "book-scores")
    walk = A.walk_forward_scores(rows, FOREST_COLS).filter("streaming_score IS NOT NULL").select("series_id", TS, "truth", "streaming_score")
    batch = A.isolation_forest(rows, FOREST_COLS, ["series_id", TS], contamination=None).select("series_id", TS, "anomaly_score")
    both = materialised(walk.join(batch, ["series_id", TS]), "both-scores")
    return shown(E.join_sweeps(E.precision_at_budget(both, "anomaly_score", "truth"), E.precision_at_budget(both, "streaming_score", "truth")))


@query("sweeps_side_by_side", f"""WITH {SCORE_SQL}, b AS (SELECT b FROM (VALUES {BUDGET_SQL}) AS v(b)),
x AS (SELECT 'a' AS k, score AS s FROM sc UNION ALL SELECT 'b', abs(round(order_book_imbalance + 3.1e-9, 6)) FROM sc),
q AS (SELECT b, k, list_sort(list(s)) AS l FROM x, b GROUP BY b, k), h AS (SELECT b, k, l, (len(l) - 1) * (1 - b::DOUBLE) AS h FROM q),
c AS (SELECT b, k, l[floor(h)::BIGINT + 1] + (h - floor(h)) * (l[least(floor(h)::BIGINT + 2, len(l))] - l[floor(h)::BIGINT + 1]) AS cut FROM h),
n AS (SELECT b, c.k, cut, count(*) FILTER (s >= cut) AS n FROM c JOIN x USING (k) GROUP BY b, c.k, cut)
SELECT {num('u.b::DOUBLE * 100', 'budget_pct')}, {num('u.cut', 'threshold_batch')}, {num('v.cut', 'threshold_walk')}, {big('u.n', 'n_flagged_batch')}, {big('v.n', 'n_flagged_walk')}
FROM n u JOIN n v ON u.b = v.b AND u.k = 'a' AND v.k = 'b'""")
def sweeps_side_by_side(spark, sf):
    """Two scores' budget sweeps joined on the budget."""
    rows = materialised(velocity_scores(spark, sf).withColumn("other", F.abs(F.round(F.col("order_book_imbalance") + 3.1e-9, 6))), "scores")
    both = E.join_sweeps(E.precision_at_budget(rows, "score", "truth"), E.precision_at_budget(rows, "other", "truth"))
    return shown(both.select("budget_pct", "threshold_batch", "threshold_walk", "n_flagged_batch", "n_flagged_walk"))


@query("zscore_alerts", f"""WITH {TOTALS_SQL}, s AS (SELECT avg(order_book_imbalance) AS m, stddev_pop(order_book_imbalance) AS sd FROM book_rows),
z AS (SELECT series_id, snapshot_id, truth, (order_book_imbalance - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS zscore FROM book_rows, s)
SELECT series_id, {day('snapshot_id', 'snapshot_id')}, {nums('zscore')}, abs(zscore) >= 1.5 AS is_anomaly,
  CASE WHEN truth AND abs(zscore) >= 1.5 THEN 'true_positive' WHEN NOT truth AND abs(zscore) >= 1.5 THEN 'false_alarm' WHEN truth THEN 'missed' ELSE 'true_negative' END AS outcome FROM z""")
def zscore_alerts(spark, sf):
    rows = zscore_flag(totals(spark, sf), "order_book_imbalance", 1.5)
    return shown(rows.select("series_id", TS, "zscore", "is_anomaly", alert_outcome(F.col("truth"), F.col("is_anomaly")).alias("outcome")))


@query("size_histogram", f"""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, lo, (hi - lo) / 40 AS w FROM lineitem, e)
SELECT bin, {num('lo + bin * w', 'left_edge')}, {num('lo + bin * w + w', 'right_edge')}, {big('count(*)', 'n_rows')} FROM b GROUP BY bin, lo, w""")
def size_histogram(spark, sf):
    return shown(Q.histogram(V.table(spark, sf, "lineitem"), "l_extendedprice", 40))


@query("price_description", f"""WITH d AS (SELECT 'l_extendedprice' AS c, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem)
SELECT c AS "column", {big('count(v)', 'n')}, {num('avg(v)', 'mean', 4)}, {num('stddev_samp(v)', 'std', 4)}, {num('min(v)', 'min', 4)}, {num('quantile_cont(v, 0.25)', 'q25', 4)},
  {num('quantile_cont(v, 0.5)', 'q50', 4)}, {num('quantile_cont(v, 0.75)', 'q75', 4)}, {num('max(v)', 'max', 4)} FROM d GROUP BY c""")
def price_description(spark, sf):
    return shown(Q.describe(V.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]), 4)


@query("exact_quantiles", f"""SELECT {num('quantile_cont(l_extendedprice, 0.005)', 'low')}, {num('quantile_cont(l_extendedprice, 0.995)', 'high')},
  {num('quantile_cont(l_extendedprice, 0.98)', 'threshold_2pct')} FROM lineitem""")
def exact_quantiles(spark, sf):
    """Axis limits and an alert threshold, narrowed by brackets as for huge tables."""
    rows = V.table(spark, sf, "lineitem")
    low, high, cut = Q.exact_quantiles(rows, "l_extendedprice", [0.005, 0.995, 0.98])
    one = rows.agg(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(cut).alias("threshold_2pct"))
    return shown(one)


@query("refit_windows", f"""WITH {TOTALS_SQL}, i AS (SELECT series_id, snapshot_id, row_number() OVER (PARTITION BY series_id ORDER BY snapshot_id) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM book_rows),
m AS (SELECT DISTINCT series_id, unnest(range(0, 1 + (n - 1000 - 1) // 250)) AS model_id FROM i WHERE n > 1000),
p AS (SELECT i.series_id, model_id, idx, CASE WHEN idx < 1000 + model_id * 250 THEN 'train' ELSE 'score' END AS role FROM i JOIN m USING (series_id)
  WHERE idx >= greatest(0, 1000 + model_id * 250 - 1500) AND idx < 1000 + model_id * 250 + 250)
SELECT series_id, {big('model_id')}, role, {big('count(*)', 'n_rows')}, {big('min(idx)', 'first_row')}, {big('max(idx)', 'last_row')} FROM p GROUP BY series_id, model_id, role""")
def refit_windows(spark, sf):
    rows = assign_refit_windows(totals(spark, sf).select("series_id", TS), ts=TS)
    return shown(rows.groupBy("series_id", "model_id", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row")
    ))


FOREST_COLS = ["top_level_size_ratio", "max_cancel_ratio_across_levels", "max_size_velocity_across_levels", "order_book_imbalance", "cancel_to_trade_ratio"]


@query("isolation_forest")
def isolation_forest(spark, sf):
    rows = materialised(scored(spark, sf).select("series_id", TS, "truth", *FOREST_COLS), "book-scores")
    out = A.isolation_forest(rows, FOREST_COLS, ["series_id", TS])
    return shown(out.select("series_id", TS, "anomaly_score", "is_anomaly"))


@query("feature_ablation")
def feature_ablation(spark, sf):
    rows = materialised(scored(spark, sf).select("series_id", TS, "truth", *FOREST_COLS), "book-scores")
    sets = {"top": FOREST_COLS[:1], "levels": FOREST_COLS[:3], "all": FOREST_COLS}
    return shown(A.ablation(rows, sets, "truth", ["series_id", TS]))


@query("walk_forward_alerts")
def walk_forward_alerts(spark, sf):
    """Scores from forests refit on trailing snapshots only."""
    rows = materialised(scored(spark, sf).select("series_id", TS, "truth", *FOREST_COLS), "book-scores")
    out = A.walk_forward_scores(rows, FOREST_COLS)
    return shown(out.select("series_id", TS, "streaming_score", "streaming_model_id"))


@query("reconstruction_error")
def reconstruction_error(spark, sf):
    rows = materialised(scored(spark, sf).select("series_id", TS, "truth", *FOREST_COLS), "book-scores")
    out = materialised(A.pca_reconstruction_score(rows, FOREST_COLS, k=3), "reconstruction")
    return shown(A.flag_top(out, "reconstruction_error").select("series_id", TS, "reconstruction_error", "is_anomaly"))
