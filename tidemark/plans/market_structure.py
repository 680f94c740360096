"""Queries on portfolios and correlation regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import bars as B
from tidemark.operators import models as M
from tidemark.operators import portfolio as Pf
from tidemark.operators import regimes as R
from tidemark.operators.evaluate import adjusted_rand
from tidemark.operators.ordering import runs
from tidemark.operators.splits import standardize
from tidemark.plans import views as V
from tidemark.plans.market import roll
from tidemark.plans.registry import big, day, num, nums, query, shown
from tidemark.session import materialised

QRET_SQL = f"""{V.QUOTES_SQL}, full_days AS (SELECT date FROM quotes GROUP BY date HAVING count(*) = (SELECT count(DISTINCT series_id) FROM quotes)),
qret AS (SELECT series_id, date, ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY date)) AS ret FROM quotes)"""
PAIR_RET = "pr AS (SELECT a.series_id AS i, b.series_id AS j, a.date, a.ret AS y, b.ret AS x FROM qret a JOIN qret b ON a.date = b.date AND a.series_id < b.series_id)"


def quote_returns(spark, sf):
    q = V.quotes(spark, sf)
    return q.select("series_id", "date", S.log_return("price", ts="date").alias("ret"))


@query("panel_alignment", f"""WITH {V.REGION_PANEL_SQL}, n AS (SELECT count(DISTINCT series_id) AS n FROM panel),
d AS (SELECT date FROM panel GROUP BY date HAVING count(*) = (SELECT n FROM n))
SELECT {day('date', 'date')}, {', '.join(f'''max(CASE WHEN series_id = '{r}' THEN {num('price').split(' AS ')[0]} END) AS "{r.lower()}"''' for r in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))}
FROM panel JOIN d USING (date) GROUP BY date""")
def panel_alignment(spark, sf):
    """Wide panel of the days on which every region traded."""
    panel = V.region_panel(spark, sf)
    aligned = B.align_panel(panel, "inner")
    names = sorted(r["series_id"] for r in panel.select("series_id").distinct().collect())  # one row for each region
    wide = B.to_wide(aligned, names)
    return shown(wide.select("date", *[F.col(n).alias(n.lower()) for n in names]))


@query("annualised_moments", f"""WITH {QRET_SQL}, {PAIR_RET},
u AS (SELECT i, j, covar_samp(y, x) * 365 AS value FROM pr WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY i, j),
c AS (SELECT i, j, value FROM u UNION ALL SELECT j, i, value FROM u UNION ALL SELECT series_id, series_id, var_samp(ret) * 365 FROM qret GROUP BY series_id)
SELECT i, j, {num('value', 'covariance')}, {num('m', 'mean_return')} FROM c JOIN (SELECT series_id, avg(ret) * 365 AS m FROM qret GROUP BY series_id) ON i = series_id""")
def annualised_moments(spark, sf):
    mean, cov = Pf.annualised_moments(quote_returns(spark, sf))
    joined = cov.join(mean, cov.i == mean.series_id)
    return shown(joined.select("i", "j", F.col("value").alias("covariance"), "mean_return"))


@query("correlation_matrix", f"""WITH {QRET_SQL}, {PAIR_RET}, u AS (SELECT i, j, corr(y, x) AS value FROM pr WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY i, j)
SELECT i, j, {nums('value')} FROM (SELECT i, j, value FROM u UNION ALL SELECT j, i, value FROM u UNION ALL SELECT DISTINCT series_id, series_id, 1.0 FROM qret)""")
def correlation_matrix(spark, sf):
    return shown(Pf.correlation_matrix(quote_returns(spark, sf)))


WEIGHT_SQL = """wq AS (SELECT l_suppkey AS portfolio_id, p_brand AS series_id, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
wt AS (SELECT portfolio_id, series_id, q / sum(q) OVER (PARTITION BY portfolio_id) AS weight FROM wq)"""


def supplier_weights(spark, sf):
    """What a supplier shipped of each brand, as portfolio weights."""
    lines, part = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part")
    q = (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(F.col("l_suppkey").alias("portfolio_id"), F.col("p_brand").alias("series_id")).agg(F.sum("l_quantity").alias("q"))
    )
    total = q.groupBy("portfolio_id").agg(F.sum("q").alias("total"))
    return q.join(total, "portfolio_id").select("portfolio_id", "series_id", (F.col("q") / F.col("total")).alias("weight"))


PERFORMANCE_SQL = """u AS (SELECT i, j, covar_samp(y, x) * 365 AS value FROM pr WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY i, j),
c AS (SELECT i, j, value FROM u UNION ALL SELECT j, i, value FROM u UNION ALL SELECT series_id, series_id, var_samp(ret) * 365 FROM qret GROUP BY series_id),
m AS (SELECT series_id, avg(ret) * 365 AS m FROM qret GROUP BY series_id),
r AS (SELECT portfolio_id, sum(weight * m) AS ret FROM wt JOIN m USING (series_id) GROUP BY portfolio_id),
v AS (SELECT a.portfolio_id, sqrt(sum(a.weight * b.weight * value)) AS vol FROM wt a JOIN wt b USING (portfolio_id)
  JOIN c ON c.i = a.series_id AND c.j = b.series_id GROUP BY a.portfolio_id)"""


@query("portfolio_performance", f"""WITH {QRET_SQL}, {PAIR_RET}, {WEIGHT_SQL}, {PERFORMANCE_SQL}
SELECT portfolio_id, {nums('ret vol')}, {num('(ret - 0.045) / vol', 'sharpe')} FROM r JOIN v USING (portfolio_id)""")
def portfolio_performance(spark, sf):
    mean, cov = Pf.annualised_moments(quote_returns(spark, sf))
    return shown(Pf.portfolio_performance(supplier_weights(spark, sf), mean, cov))


DRAW_SQL = """drawn AS (SELECT p.portfolio_id, s.series_id, md5('42:' || p.portfolio_id || ':' || s.series_id) AS h
  FROM (SELECT unnest(range(5000)) AS portfolio_id) p, (SELECT DISTINCT series_id FROM qret) s),
bits AS (SELECT portfolio_id, series_id, list_sum(list_transform(range(1, 14), lambda k: (strpos('0123456789abcdef', substr(h, k, 1)) - 1)::DOUBLE * pow(16::DOUBLE, 13 - k))) AS b FROM drawn),
ex AS (SELECT portfolio_id, series_id, -ln((b + 0.5) / pow(2::DOUBLE, 52)) AS e FROM bits),
wt AS (SELECT portfolio_id, series_id, e / sum(e) OVER (PARTITION BY portfolio_id) AS weight FROM ex)"""


@query("random_portfolios", f"""WITH {QRET_SQL}, {PAIR_RET}, {DRAW_SQL}, {PERFORMANCE_SQL}
SELECT portfolio_id, {nums('ret vol')}, {num('(ret - 0.045) / vol', 'sharpe')} FROM r JOIN v USING (portfolio_id)""")
def random_portfolios(spark, sf):
    """5,000 random long-only portfolios of the brands."""
    mean, cov = Pf.annualised_moments(quote_returns(spark, sf))
    return shown(Pf.random_portfolios(mean, materialised(cov, "cov")))


@query("optimal_portfolios")
def optimal_portfolios(spark, sf):
    """Max-Sharpe, minimum-volatility and frontier portfolios for each year's moments."""
    rows = quote_returns(spark, sf).filter(F.col("ret").isNotNull()).withColumn("basket", F.year("date"))
    mean, cov = Pf.annualised_moments(rows, by=["basket"])
    best = Pf.optimize_portfolios(mean, cov)
    return shown(best.withColumn("n_held", F.size(F.map_filter("weights", lambda _, w: w > 1e-9))).drop("weights"))


REGION_RET_SQL = f"{V.REGION_PANEL_SQL}, qret AS (SELECT series_id, date, ln((1000 + price / 100) / (1000 + lag(price) OVER (PARTITION BY series_id ORDER BY date) / 100)) AS ret FROM panel)"


def region_returns(spark, sf):
    p = V.region_panel(spark, sf).withColumn("price", 1000 + F.col("price") / 100)
    return p.select("series_id", "date", S.log_return("price", ts="date").alias("ret"))


def _tidy_sql(n: int) -> str:
    w = f"(PARTITION BY i, j ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"rc AS (SELECT i, j, date, CASE WHEN count(*) OVER {w} >= {n} THEN corr(y, x) OVER {w} END AS c FROM (SELECT * FROM pr WHERE y IS NOT NULL AND x IS NOT NULL))"


@query("rolling_pair_correlation", f"""WITH {REGION_RET_SQL}, {PAIR_RET}, {_tidy_sql(30)}
SELECT i || '/' || j AS pair, {day('date', 'date')}, {num('c', 'corr')} FROM rc WHERE c IS NOT NULL""")
def rolling_pair_correlation(spark, sf):
    return shown(R.rolling_pair_corr(region_returns(spark, sf), 30).select("pair", "date", "corr"))


REGIME_SQL = f"""{REGION_RET_SQL}, {PAIR_RET}, {_tidy_sql(20)},
per AS (SELECT series_id, date, {roll('avg', 'ret', 20, 'date')} AS m, {roll('stddev_samp', 'ret', 20, 'date')} AS s FROM qret),
lvl AS (SELECT date, avg(m) AS avg_return, avg(s) AS avg_volatility FROM per GROUP BY date),
mk AS (SELECT date, avg(ret) AS ir, stddev_pop(ret) AS sp FROM qret GROUP BY date),
ml AS (SELECT *, array_agg(ir) FILTER (ir IS NOT NULL) OVER f AS l, count(ir) OVER f AS ni, CASE WHEN count(sp) OVER f >= 20 THEN avg(sp) OVER f END AS dispersion FROM mk
  WINDOW f AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
path AS (SELECT date, ni, dispersion, unnest(range(1, len(l) + 1)) AS i, l FROM ml WHERE ni >= 20),
lev AS (SELECT date, i, list_product(list_transform(l[1:i], lambda v: 1 + v)) AS level FROM path),
dds AS (SELECT date, level / max(level) OVER (PARTITION BY date ORDER BY i) - 1 AS dd FROM lev),
dd AS (SELECT date, min(dd) AS drawdown FROM dds GROUP BY date),
cc AS (SELECT date, avg(c) AS avg_pairwise_corr FROM rc WHERE c IS NOT NULL GROUP BY date),
regime AS (SELECT date, avg_return, avg_volatility, avg_pairwise_corr, dispersion, drawdown FROM lvl JOIN cc USING (date) JOIN ml USING (date) LEFT JOIN dd USING (date))"""


@query("regime_features", f"WITH {REGIME_SQL} SELECT {day('date', 'date')}, {nums(' '.join(R.REGIME_FEATURES))} FROM regime")
def regime_features(spark, sf):
    return shown(R.regime_features(region_returns(spark, sf), 20))


CLUSTER_SQL = f"""{REGIME_SQL}, asg AS (SELECT *, quarter(date) AS cluster FROM regime),
cen AS (SELECT cluster, avg(avg_return) AS avg_return, avg(avg_volatility) AS avg_volatility FROM asg GROUP BY cluster),
md AS (SELECT median(avg_return) AS r, median(avg_volatility) AS v FROM cen),
nm AS (SELECT cluster, CASE WHEN avg_return >= r AND avg_volatility < v THEN 'Bull Quiet' WHEN avg_return >= r THEN 'Bull Volatile'
  WHEN avg_volatility >= v THEN 'Bear Crash' ELSE 'Sideways / Consolidation' END AS l FROM cen, md),
lab AS (SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY l) > 1 THEN l || ' (' || row_number() OVER (PARTITION BY l ORDER BY cluster) || ')' ELSE l END AS regime_label FROM nm)"""


@query("regime_summary", f"""WITH {CLUSTER_SQL}
SELECT {big('cluster')}, regime_label, {big('count(*)', 'n_days')}, {', '.join(num(f'avg({c})', f'{c}_mean') for c in R.REGIME_FEATURES)},
  {num('round(100.0 * count(*) / sum(count(*)) OVER (), 1)', 'pct_days')} FROM asg JOIN lab USING (cluster) GROUP BY cluster, regime_label""")
def regime_summary(spark, sf):
    """Days grouped by quarter, named by return and volatility quadrant."""
    assigned = R.regime_features(region_returns(spark, sf), 20).withColumn("cluster", F.quarter("date"))
    assigned = materialised(assigned, "regimes")
    centroids = assigned.groupBy("cluster").agg(F.avg("avg_return").alias("avg_return"), F.avg("avg_volatility").alias("avg_volatility"))
    labels = R.label_regimes(centroids)
    return shown(R.attach_labels(R.regime_summary(assigned), labels))


@query("correlation_by_regime", f"""WITH {REGION_RET_SQL}, {PAIR_RET}, g AS (SELECT DISTINCT date, quarter(date) AS cluster FROM qret),
c AS (SELECT cluster, i, j, corr(y, x) AS v FROM pr JOIN g USING (date) WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY cluster, i, j)
SELECT {big('cluster')}, i, j, {num('v', 'value')}, {num('avg(v) OVER (PARTITION BY cluster)', 'mean_off_diagonal')} FROM c""")
def correlation_by_regime(spark, sf):
    ret = region_returns(spark, sf)
    days = ret.select("date", F.quarter("date").alias("cluster")).distinct()
    cells = R.correlation_by_group(ret, days)
    means = R.mean_correlation_by_group(ret, days)
    return shown(cells.join(means, "cluster"))


@query("regime_runs", f"""WITH {REGIME_SQL}, s AS (SELECT date, CASE WHEN avg_return > 0 THEN 'up' ELSE 'down' END AS regime FROM regime),
c AS (SELECT *, CASE WHEN regime <> lag(regime) OVER (ORDER BY date) THEN 1 ELSE 0 END AS ch FROM s), r AS (SELECT *, sum(ch) OVER (ORDER BY date) AS run FROM c)
SELECT 'all' AS market, {big('run')}, regime, {day('min(date)', 'start')}, {day('max(date)', 'end').replace(' end', ' "end"')}, {big('count(*)', 'n_rows')} FROM r GROUP BY run, regime""")
def regime_runs(spark, sf):
    """Contiguous stretches of rising and falling markets."""
    rows = R.regime_features(region_returns(spark, sf), 20).select(
        F.lit("all").alias("market"), "date", F.when(F.col("avg_return") > 0, "up").otherwise("down").alias("regime")
    )
    return shown(runs(rows, "regime", by=R.MARKET, ts="date"))


@query("index_level", f"""WITH {REGION_RET_SQL}, mk AS (SELECT date, avg(ret) AS ir FROM qret GROUP BY date)
SELECT {day('date', 'date')}, {num('100 * product(1 + ir) OVER (ORDER BY date)', 'index_level')} FROM mk""")
def index_level(spark, sf):
    return shown(R.index_level(region_returns(spark, sf)))


@query("detected_regimes")
def detected_regimes(spark, sf):
    """Clusters of market days: KMeans or mixture by silhouette, with labels and shares."""
    feats = materialised(R.regime_features(region_returns(spark, sf), 20).na.drop(), "regime-features")
    assigned, model = M.detect_regimes(feats, R.REGIME_FEATURES)
    centroids = assigned.groupBy("cluster").agg(F.avg("avg_return").alias("avg_return"), F.avg("avg_volatility").alias("avg_volatility"))
    out = R.attach_labels(R.regime_summary(assigned), R.label_regimes(centroids))
    return shown(out.withColumn("model", F.lit(model)))


@query("regime_agreement")
def regime_agreement(spark, sf):
    """Adjusted Rand index of the detected clusters and the quarters of the year, as known regimes."""
    feats = materialised(R.regime_features(region_returns(spark, sf), 20).na.drop(), "regime-features")
    assigned, model = M.detect_regimes(feats, R.REGIME_FEATURES)
    known = materialised(assigned.select("cluster", F.quarter("date").alias("known")), "regimes")
    return shown(adjusted_rand(known, "cluster", "known").withColumn("model", F.lit(model)))


@query("regime_silhouettes")
def regime_silhouettes(spark, sf):
    """Silhouette of KMeans for each number of clusters, the best of ten starts."""
    feats = materialised(R.regime_features(region_returns(spark, sf), 20).na.drop(), "regime-features")
    names = list(R.REGIME_FEATURES)
    (scaled,) = standardize(feats, cols=names)
    return shown(M.select_k(scaled, names)[2])


@query("regime_components")
def regime_components(spark, sf):
    """Market days on their first two principal components."""
    feats = materialised(R.regime_features(region_returns(spark, sf), 20).na.drop(), "regime-features")
    points, share = M.pca_2d(feats, R.REGIME_FEATURES, ["date"])
    return shown(points.withColumns({"share_1": F.lit(share[0]), "share_2": F.lit(share[1])}), 4)


@query("adjusted_rand", f"""WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
t AS (SELECT sum(n * (n - 1) / 2) AS hits, sum(n) AS n FROM c),
r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT {num('(hits - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2))', 'adjusted_rand')} FROM t, r, k""")
def adjusted_rand_index(spark, sf):
    return shown(adjusted_rand(V.table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber"))
