import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import features as X
from tidemark.operators import ordering as O
from tidemark.streaming.pairs import next_position


def by_key(df, *cols):
    return df.toPandas().sort_values(["series_id", "ts"])[list(cols)].reset_index(drop=True)


def test_row_index_is_exact_over_slots(hot):
    pdf, df = hot
    got = by_key(O.row_index(df, slot_width=20 * 86_400, total="n"), "series_id", "row_idx", "n")
    want = pdf.sort_values(["series_id", "ts"])
    assert (got["row_idx"] == want.groupby("series_id").cumcount().to_numpy()).all()
    assert (got["n"] == want.groupby("series_id")["x"].transform("size").to_numpy()).all()


def test_blocks_equal_whole_series_windows(hot):
    _, df = hot

    def step(d, by):
        return d.withColumns({"m": S.rolling("x", "mean", 20, by=by), "s": S.rolling("x", "std", 20, by=by), "f": S.forward_return("price", 5, by=by)})

    plain = by_key(step(df, ["series_id"]), "m", "s", "f")
    blocked = by_key(O.in_blocks(df, step, 20, 5, block_rows=64, slot_width=30 * 86_400), "m", "s", "f")
    pd.testing.assert_frame_equal(plain, blocked, atol=1e-12, rtol=0)


def test_blocks_equal_plain_for_candle_features(hot):
    _, df = hot
    bars = df.select(
        "series_id", "ts", F.col("price").alias("open"), (F.col("price") * 1.01).alias("close"), (F.col("price") * 1.03).alias("high"),
        (F.col("price") * 0.97).alias("low"), (F.abs("x") + 1).alias("volume"),
    )
    plain = by_key(X.ohlcv_features(bars), *X.CANDLE_FEATURES)
    blocked = by_key(
        O.in_blocks(bars, lambda d, by: X.ohlcv_features(d, by), O.ewm_memory(2 / 13) + 1, 1, block_rows=100, slot_width=50 * 86_400), *X.CANDLE_FEATURES
    )
    pd.testing.assert_frame_equal(plain, blocked, atol=1e-9, rtol=1e-9)


def test_scans_carry_over_blocks(hot):
    _, df = hot
    outs = {"total": ("sum", "x"), "equity": ("product", 1 + F.col("x") / 100), "top": ("max", "x"), "low": ("min", "x")}
    plain = by_key(O.cumulative(df, outs), *outs)
    blocked = by_key(O.cumulative(df, outs, block_rows=50, slot_width=30 * 86_400), *outs)
    pd.testing.assert_frame_equal(plain, blocked, atol=1e-9, rtol=1e-9)


def test_scans_reuse_split_blocks(hot):
    _, df = hot
    split = O.split_blocks(df, block_rows=70)
    out = O.drawdown(O.cumulative(split, {"equity": ("product", 1 + F.col("x") / 100)}), "equity")
    plain = O.drawdown(O.cumulative(df, {"equity": ("product", 1 + F.col("x") / 100)}), "equity")
    pd.testing.assert_frame_equal(by_key(O.drop_blocks(out), "drawdown"), by_key(plain, "drawdown"), atol=1e-12, rtol=0)


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_equals_pandas(hot, adjust):
    pdf, df = hot
    got = by_key(O.ewm_mean(df, "x", "e", alpha=0.3, adjust=adjust, min_periods=5), "e")["e"]
    want = pdf.sort_values(["series_id", "ts"]).groupby("series_id")["x"].transform(lambda v: v.ewm(alpha=0.3, adjust=adjust, min_periods=5).mean())
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


@pytest.mark.parametrize("alpha", [0.5, 0.05])
@pytest.mark.parametrize("adjust", [True, False])
def test_smoothed_mean_over_gaps_equals_pandas(spark, adjust, alpha):
    values = [None, None, 1.0, 2.0, None, 4.0, None, None, 6.0] + [None] * 200 + [3.0, 5.0] + [float(i % 4) for i in range(200)] + [None, None]
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=len(values)), "x": pd.Series(values, dtype=float)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = [r["e"] for r in O.ewm_mean(df, "x", "e", alpha=alpha, adjust=adjust).orderBy("ts").collect()]
    want = pdf["x"].ewm(alpha=alpha, adjust=adjust).mean()
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(), atol=1e-12)


# Scores with their published positions.
Z_CASES = [
    ([0, 0.5, 2.5, 2.2, 1.8, 0.3, 0.1], [0, 0, -1, -1, -1, 0, 0]),
    ([0, -2.5, -2.1, -0.4], [0, 1, 1, 0]),
    ([None, None, 2.5, 0.1], [0, 0, -1, 0]),
]


@pytest.mark.parametrize("z,want", Z_CASES)
def test_band_positions(spark, z, want):
    df = spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(z)], "series_id string, ts long, z double")
    got = [r["position"] for r in O.hysteresis(df, "z").orderBy("ts").collect()]
    assert got == want


def test_band_over_blocks_equals_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for name in ("a", "b"):
        position = 0
        for i, v in enumerate(rng.normal(0, 1.6, 700)):
            z = None if rng.random() < 0.05 else float(v)
            position = next_position(position, z, 2.0, 0.2)
            rows.append((name, i, z))
            want.append(0 if z is None else position)
    df = spark.createDataFrame(rows, "series_id string, ts long, z double").repartition(4)
    for block_rows in (None, 37):
        got = [r["position"] for r in O.hysteresis(df, "z", exit=0.2, block_rows=block_rows).orderBy("series_id", "ts").collect()]
        assert got == want


def test_band_needs_exit_below_entry(hot):
    with pytest.raises(ValueError):
        O.hysteresis(hot[1], "x", entry=0.5, exit=0.5)


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.floats(-3, 3), min_size=1, max_size=40))
def test_running_product_property(spark, values):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series_id string, ts long, x double")
    got = [r["p"] for r in O.cumulative(df, {"p": ("product", 1 + F.col("x") / 10)}).orderBy("ts").collect()]
    np.testing.assert_allclose(got, np.cumprod(1 + np.array(values) / 10), rtol=1e-9)


def test_window_drawdown(spark):
    r = [0.1, -0.2, 0.05, 0.3, -0.1, -0.1]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(r)], "series_id string, ts long, r double")
    got = [x["d"] for x in df.select("ts", O.window_drawdown(F.col("r"), 3).alias("d")).orderBy("ts").collect()]
    want = [None, None]
    for t in range(2, len(r)):
        level = np.cumprod(1 + np.array(r[t - 2 : t + 1]))
        want.append(float((level / np.maximum.accumulate(level) - 1).min()))
    assert got[:2] == want[:2]
    np.testing.assert_allclose(got[2:], want[2:], atol=1e-12)


def test_evenly_spaced_and_kth(hot):
    pdf, df = hot
    got = by_key(O.evenly_spaced(df, 10), "series_id", "x")
    for name, part in pdf.groupby("series_id"):
        n = len(part)
        want = part["x"].to_numpy()[np.linspace(0, n - 1, min(10, n)).astype(int)]
        np.testing.assert_array_equal(got.loc[got["series_id"] == name, "x"].to_numpy(), want)
    assert O.every_kth(df, 10).count() == 90 + 12 + 1


def test_runs_and_tail(spark, hot):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyyx")], "series_id string, ts long, k string")
    got = [(r["k"], r["n_rows"]) for r in O.runs(df, "k").orderBy("start").collect()]
    assert got == [("x", 2), ("y", 3), ("x", 1)]
    assert O.tail(hot[1], 5).count() == 13


def test_sample_is_repeatable(hot):
    _, df = hot
    a = O.sample_n(df, 50, ["series_id", "ts"]).toPandas()
    b = O.sample_n(df.repartition(3), 50, ["series_id", "ts"]).toPandas()
    assert len(a) == 50 and set(a["x"]) == set(b["x"])


def test_streak_and_rsi_bounds(hot):
    _, df = hot
    out = df.withColumn("r", S.log_return("price")).select("r", S.rsi_sma("r").alias("rsi"), S.streak("r").alias("k")).toPandas()
    rsi = out["rsi"].dropna()
    assert rsi.between(0, 100).all() and out["k"].dropna().between(-5, 5).all()


def test_horizontal_mean_skips_nulls(spark):
    from tidemark.functions.shapes import horizontal_mean

    df = spark.createDataFrame([(1.0, 3.0, None), (None, None, None), (2.0, 4.0, 9.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(horizontal_mean("a", "b", "c")).collect()] == [2.0, None, 5.0]
