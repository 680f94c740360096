"""Correlation regimes: rolling cross-section features, labels and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators.bars import pair_panel
from tidemark.operators.panel import correlation, pair_moments
from tidemark.operators.ordering import window_drawdown
from tidemark.operators.attach import attach_row
from tidemark.operators.tiles import mean_rolling_correlation

REGIME_FEATURES = ("avg_return", "avg_volatility", "avg_pairwise_corr", "dispersion", "drawdown")
MARKET = ("market",)


def rolling_pair_corr(returns: DataFrame, n: int = 30, ts: str = "date", value: str = "ret") -> DataFrame:
    """Trailing correlation of every pair of series; warm-up rows are left out."""
    pairs = pair_panel(returns.filter(F.col(value).isNotNull()), value, ts=ts)
    out = pairs.withColumn("corr", S.rolling_corr("y", "x", n, by=("pair",), ts=ts))
    return out.select("pair", "y_id", "x_id", ts, "corr").filter(F.col("corr").isNotNull() & ~F.isnan("corr"))


def rolling_mean_corr(returns: DataFrame, n: int = 20, ts: str = "date", value: str = "ret") -> DataFrame:
    """Mean over all pairs of their trailing correlation, per date, without a row for a pair and a date."""
    return mean_rolling_correlation(returns, n, value, ts)


def market_rows(returns: DataFrame, ts: str = "date", value: str = "ret") -> DataFrame:
    """One row per date: equal-weight return and spread of returns across series."""
    return returns.groupBy(ts).agg(F.avg(value).alias("index_ret"), F.stddev_pop(value).alias("_spread")).withColumn(
        "market", F.lit("all")
    )


def dispersion(returns: DataFrame, n: int = 20, ts: str = "date", value: str = "ret") -> DataFrame:
    rows = market_rows(returns, ts, value)
    return rows.select(ts, S.rolling("_spread", "mean", n, by=MARKET, ts=ts).alias("dispersion"))


def index_level(returns: DataFrame, base: float = 100.0, ts: str = "date", value: str = "ret") -> DataFrame:
    """Equal-weight index; its windows hold one row per date."""
    rows = market_rows(returns, ts, value)
    level = base * F.product(1 + F.col("index_ret")).over(S.up_to_now(MARKET, ts))
    return rows.select(ts, level.alias("index_level"))


def regime_features(returns: DataFrame, n: int = 20, ts: str = "date", value: str = "ret") -> DataFrame:
    """Average return, volatility and correlation, dispersion and drawdown per date."""
    per_series = returns.withColumns(
        {"_mean": S.rolling(value, "mean", n, ts=ts), "_std": S.rolling(value, "std", n, ts=ts)}
    )
    level = per_series.groupBy(ts).agg(F.avg("_mean").alias("avg_return"), F.avg("_std").alias("avg_volatility"))
    market = market_rows(returns, ts, value).select(
        ts,
        S.rolling("_spread", "mean", n, by=MARKET, ts=ts).alias("dispersion"),
        window_drawdown(F.col("index_ret"), n, by=MARKET, ts=ts).alias("drawdown"),
    )
    corr = rolling_mean_corr(returns, n, ts, value)
    return level.join(market, ts).join(corr, ts).select(ts, *REGIME_FEATURES)


# Regime names by return and volatility against their medians.
BULL_QUIET = "Bull Quiet"
BULL_VOLATILE = "Bull Volatile"
BEAR_CRASH = "Bear Crash"
SIDEWAYS = "Sideways / Consolidation"


def label_regimes(centroids: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Name clusters by quadrant; names used twice get a running number."""
    mid = centroids.agg(
        F.percentile("avg_return", F.lit(0.5)).alias("_r"), F.percentile("avg_volatility", F.lit(0.5)).alias("_v")
    )
    up, loud = F.col("avg_return") >= F.col("_r"), F.col("avg_volatility") >= F.col("_v")
    name = F.when(up & ~loud, BULL_QUIET).when(up, BULL_VOLATILE).when(loud, BEAR_CRASH).otherwise(SIDEWAYS)
    named = attach_row(centroids, mid).withColumn("_name", name)
    same = Window.partitionBy("_name")
    number = F.row_number().over(same.orderBy(cluster))
    label = F.when(F.count(F.lit(1)).over(same) > 1, F.concat("_name", F.lit(" ("), number.cast("string"), F.lit(")")))
    return named.withColumn("regime_label", F.coalesce(label, "_name")).drop("_r", "_v", "_name")


def regime_summary(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Days, share of days and mean features per cluster."""
    rows = assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_days"), *[F.avg(c).alias(f"{c}_mean") for c in REGIME_FEATURES]
    )
    total = F.sum("n_days").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("pct_days", F.round(F.col("n_days") / total * 100, 1))


def correlation_by_group(returns: DataFrame, groups: DataFrame, cluster: str = "cluster", ts: str = "date", value: str = "ret") -> DataFrame:
    """Pair correlations pooled over each cluster's dates."""
    joined = returns.join(groups.select(ts, cluster), ts)
    cells = pair_moments(joined, value, [cluster], ts).filter(F.col("i") != F.col("j"))
    return cells.select(cluster, "i", "j", correlation().alias("value"))


def mean_correlation_by_group(returns: DataFrame, groups: DataFrame, cluster: str = "cluster", ts: str = "date", value: str = "ret") -> DataFrame:
    cells = correlation_by_group(returns, groups, cluster, ts, value)
    return cells.groupBy(cluster).agg(F.avg("value").alias("mean_off_diagonal"))


def attach_labels(assigned: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster names onto rows; the label table has one row per cluster."""
    return assigned.join(labels.select(cluster, "regime_label"), cluster)
