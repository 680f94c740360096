

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kalman as K
from tidemark.operators.ordering import hysteresis
from tidemark.session import work_path
from tidemark.sources import history as H
from tidemark.sources import readers as R
from tidemark.sources import writers as W
from tidemark.streaming import bars as Sb
from tidemark.streaming.pairs import stream_kalman, stream_positions


def test_archives_with_both_epoch_units(spark):
    folder = work_path(spark, "k")
    ms = 1_704_067_200_000
    lines = [f"{ms},1,2,0.5,1.5,10,0,0,0,0,0,0", f"{(ms + 86_400_000) * 1000},2,3,1,2.5,11,0,0,0,0,0,0"]
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(folder)
    got = R.read_klines_archive(spark, folder).orderBy("ts").collect()
    assert [str(r["date"]) for r in got] == ["2024-01-01", "2024-01-02"] and got[1]["close"] == 2.5


def test_dedup_keeps_the_last_file(spark):
    rows = [("s", "2024-01-01", 1.0, "a", 1), ("s", "2024-01-01", 2.0, "b", 1), ("s", "2024-01-01", 3.0, "b", 2), ("s", "2024-01-02", 4.0, "a", 1)]
    df = spark.createDataFrame(rows, "series_id string, date string, close double, src string, open_time long")
    got = {(r["date"], r["close"]) for r in R.stitch_and_dedup(df).collect()}
    assert got == {("2024-01-01", 3.0), ("2024-01-02", 4.0)}


def test_history_appends_and_finds_the_latest(spark):
    table = work_path(spark, "h")
    for v in (0.1, 0.3, 0.2):
        W.append_run(spark.createDataFrame([("a", v), ("b", v / 2)], "strategy string, sharpe double"), table)
    rows = spark.read.parquet(table)
    assert rows.select("run_id").distinct().count() == 3
    assert {r["sharpe"] for r in H.latest_run(rows).collect()} == {0.2, 0.1}
    best = {r["run_id"]: (r["best_sharpe"], r["best_strategy"]) for r in H.best_by_run(rows, "sharpe").collect()}
    assert best[2] == (0.3, "a")
    assert W.append_run(spark.createDataFrame([("a", 1.0)], "strategy string, sharpe double"), work_path(spark, "u"), "uuid").isalnum()


def test_writers_at_the_same_time_get_different_run_ids(spark):
    from concurrent.futures import ThreadPoolExecutor

    table = work_path(spark, "shared-history")
    rows = spark.createDataFrame([("a", 1.0)], "strategy string, sharpe double")
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda _: W.append_run(rows, table), range(6)))
    assert sorted(ids) == [1, 2, 3, 4, 5, 6]
    assert sorted(r[0] for r in spark.read.parquet(table).select("run_id").collect()) == sorted(ids)
    # A number that was reserved by a writer that failed is not used again.
    assert W.reserve_run_id(spark, table) == 7 and W.append_run(rows, table) == 8


def test_late_rows_per_batch(spark):
    t0 = datetime(2024, 1, 1)
    folder, path, checkpoint = (work_path(spark, n) for n in ("late-in", "late-table", "late-check"))
    schema = "series_id string, ts timestamp"
    batches = [
        [("a", t0), ("a", t0 + timedelta(minutes=30)), ("b", t0 + timedelta(minutes=5))],
        [("a", t0 + timedelta(minutes=1)), ("a", t0 + timedelta(minutes=19)), ("a", t0 + timedelta(minutes=20)), ("b", t0)],
        [("b", t0 + timedelta(minutes=18, seconds=59))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        Sb.count_late_rows(stream, path, checkpoint, "1 minute", "10 minutes")
    found = {(r["series_id"], r["batch_id"]): (r["n_rows"], r["n_late"]) for r in spark.read.parquet(path).collect()}
    # The mark stands at 20 minutes after the first batch: windows that end by then are closed.
    assert found == {("a", 0): (2, 0), ("b", 0): (1, 0), ("a", 1): (3, 2), ("b", 1): (1, 1), ("b", 2): (1, 1)}


def test_a_stream_goes_on_from_another_streams_state(spark):
    """State is read back as a table and starts a new stream, which then equals one filter over everything."""
    from tidemark.streaming.pairs import NUMBERS, filter_numbers

    rng = np.random.default_rng(3)
    parts = []
    for name, n in (("p", 200), ("q", 170), ("short", 70)):
        x = np.cumsum(rng.normal(0, 0.02, n)) + 4
        parts.append(pd.DataFrame({"pair": name, "date": pd.date_range("2024-01-01", periods=n), "y": 1 + 0.5 * x + rng.normal(0, 0.02, n), "x": x}))
    pdf = pd.concat(parts)
    schema = "pair string, date timestamp, y double, x double"
    want = K.kalman_hedge(spark.createDataFrame(pdf, schema)).toPandas().sort_values(["pair", "date"])
    border = pd.Timestamp("2024-03-10")
    found, start = [], None
    for name, part in (("one", pdf[pdf["date"] < border]), ("two", pdf[pdf["date"] >= border])):
        folder, out, checkpoint = (work_path(spark, f"{name}-{k}") for k in ("in", "out", "state"))
        spark.createDataFrame(part, schema).repartition(3, "pair").write.parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        Sb.run_available(stream_kalman(stream, start=start), out, checkpoint)
        found.append(spark.read.parquet(out).toPandas())
        start = filter_numbers(spark, checkpoint)
        assert set(start.columns) == {"pair", *NUMBERS}
    assert start.count() == 3
    got = pd.concat(found).sort_values(["pair", "date"])
    np.testing.assert_allclose(got[list(K.OUTPUT)].to_numpy(), want[list(K.OUTPUT)].to_numpy(), rtol=1e-9, atol=1e-12)


def test_upsert_replaces_only_its_keys(spark):
    table = work_path(spark, "u")
    W.upsert_by_key(spark.createDataFrame([(1, 0.5), (5, 0.6)], "horizon int, rmse double"), table, ["horizon"])
    W.upsert_by_key(spark.createDataFrame([(5, 0.7)], "horizon int, rmse double"), table, ["horizon"])
    assert {(r["horizon"], r["rmse"]) for r in spark.read.parquet(table).collect()} == {(1, 0.5), (5, 0.7)}


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_reports_round_trip(spark, fmt):
    path = work_path(spark, "r")
    W.write_report(spark.createDataFrame([("x", 1.5)], "k string, v double"), path, fmt)
    got = spark.read.schema("k string, v double").option("header", True).format(fmt).load(path).first()
    assert (got["k"], got["v"]) == ("x", 1.5)


def write_batches(spark, folder, frames, schema):
    for pdf in frames:
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_trades_are_dropped_and_counted(spark):
    folder = work_path(spark, "ticks")
    schema = "series_id string, ts timestamp, price double, quantity double, is_buyer_maker boolean"
    t0 = pd.Timestamp("2024-01-01 10:00:00")

    def ticks(*minutes):
        return pd.DataFrame({"series_id": "s", "ts": [t0 + pd.Timedelta(minutes=m) for m in minutes], "price": 2.0, "quantity": 1.0, "is_buyer_maker": False})

    write_batches(spark, folder, [ticks(0, 1, 60)], schema)
    stream = spark.readStream.schema(schema).parquet(folder)
    out, checkpoint = work_path(spark, "bars"), work_path(spark, "cp")
    bars = Sb.flat_window(Sb.stream_trade_bars(stream, "1 minute", "5 minutes"))
    Sb.run_available(bars, out, checkpoint)
    write_batches(spark, folder, [ticks(0, 1, 120)], schema)
    query = Sb.run_available(bars, out, checkpoint)
    assert Sb.late_rows(query) == 2
    got = spark.read.parquet(out)
    assert got.count() == 3 and got.agg(F.max("trade_volume")).first()[0] == 1.0


def test_streams_equal_batch(spark):
    rng = np.random.default_rng(0)
    parts = []
    for name in ("p", "q"):
        x = np.cumsum(rng.normal(0, 0.02, 150)) + 4
        parts.append(pd.DataFrame({"pair": name, "date": pd.date_range("2024-01-01", periods=150), "y": 1 + 0.5 * x + rng.normal(0, 0.02, 150), "x": x}))
    pdf = pd.concat(parts)
    schema = "pair string, date timestamp, y double, x double"
    folder = work_path(spark, "pairs")
    days = sorted(pdf["date"].unique())
    for lo, hi in ((0, 40), (40, 90), (90, 150)):
        part = pdf[pdf["date"].isin(days[lo:hi])]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = work_path(spark, "filtered")
    Sb.run_available(stream_kalman(stream), out, work_path(spark, "cp"))
    order = ["pair", "date"]
    want = K.kalman_hedge(spark.createDataFrame(pdf, schema)).toPandas().sort_values(order)
    got = spark.read.parquet(out).toPandas().sort_values(order)
    np.testing.assert_allclose(got[list(K.OUTPUT)], want[list(K.OUTPUT)], rtol=1e-9)

    scores = spark.read.parquet(out)
    held = work_path(spark, "held")
    live = stream_positions(spark.readStream.schema(scores.schema).parquet(out), entry=1.0, exit=0.4)
    Sb.run_available(live, held, work_path(spark, "cp"))
    batch = hysteresis(scores, "zscore", 1.0, 0.4, by=("pair",), ts="date").toPandas().sort_values(order)
    assert spark.read.parquet(held).toPandas().sort_values(order)["position"].tolist() == batch["position"].tolist()


def test_streamed_depth_takes_the_last_snapshot_only(spark):
    from tidemark.operators.bars import depth_bars

    schema = "series_id string, ts timestamp, percentage int, depth double"
    t0 = pd.Timestamp("2024-01-01 10:00:00").to_pydatetime()
    full = [("s", t0, p, d) for p, d in ((-5, 5.0), (-1, 10.0), (1, 12.0), (5, 6.0))]
    part = [("s", t0 + timedelta(seconds=30), p, d) for p, d in ((-1, 7.0), (1, 9.0))]
    later = [("s", t0 + timedelta(hours=1), p, 1.0) for p in (-5, -1, 1, 5)]
    folder = work_path(spark, "depth")
    spark.createDataFrame([*full, *part, *later], schema).coalesce(1).write.parquet(folder)
    out = work_path(spark, "depth-bars")
    stream = Sb.flat_window(Sb.stream_depth_bars(spark.readStream.schema(schema).parquet(folder)))
    Sb.run_available(stream, out, work_path(spark, "cp"))
    first = spark.read.parquet(out).orderBy("bin").first()
    want = depth_bars(spark.createDataFrame([*full, *part], schema)).first()
    assert [first[c] for c in ("near_depth_imbalance", "far_depth_imbalance", "total_depth")] == [want[c] for c in ("near_depth_imbalance", "far_depth_imbalance", "total_depth")]
    assert first["far_depth_imbalance"] is None


def test_streamed_scores_equal_walk_forward(spark):
    from tidemark.operators.anomaly import walk_forward_scores
    from tidemark.streaming.anomaly import stream_scores

    rng = np.random.default_rng(6)
    parts = [pd.DataFrame({"series_id": s, "snapshot_id": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n)}) for s, n in (("x", 260), ("y", 90))]
    pdf, schema, folder = pd.concat(parts), "series_id string, snapshot_id long, a double, b double", work_path(spark, "rows")
    write_batches(spark, folder, [pdf[(pdf["snapshot_id"] >= lo) & (pdf["snapshot_id"] < hi)] for lo, hi in ((0, 70), (70, 130), (130, 131), (131, 260))], schema)
    settings = {"initial": 60, "refit": 25, "rolling": 80, "trees": 10, "sample": 32}
    sink = work_path(spark, "scores")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream_scores(stream, ["a", "b"], ["series_id"], sink, work_path(spark, "cp"), **settings)
    order = ["series_id", "snapshot_id"]
    got = spark.read.parquet(sink).toPandas().sort_values(order)
    want = walk_forward_scores(spark.createDataFrame(pdf, schema), ["a", "b"], **settings).toPandas().sort_values(order)
    assert got["model_id"].tolist() == want["streaming_model_id"].tolist()
    np.testing.assert_allclose(got["anomaly_score"], want["streaming_score"])
