"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark import build_session
from tidemark.plans import load

HEADLINE = (
    "trade_bars", "depth_bars", "bars_with_book", "impact_features", "ohlcv_features", "rolling_statistics", "running_totals",
    "technical_signals", "compare_strategies", "hedge_ratios", "pair_backtest", "kalman_hedge", "pair_screening",
    "portfolio_performance", "regime_features", "book_features", "alert_budgets", "isolation_forest", "tfidf", "text_scores",
    "multiclass_metrics", "roc_auc", "ridge_horizons", "streamed_trade_bars",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:8.2f}s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
