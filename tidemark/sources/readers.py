"""Market-data readers: explicit schemas, one scan for many files, no inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OHLCV = "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double"
# The twelve positional columns of an archived candle file.
KLINES = (
    "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, "
    "quote_volume double, n_trades bigint, taker_base double, taker_quote double, unused string"
)
DEPTH = "timestamp timestamp, percentage int, depth double, notional double"
AGG_TRADES = (
    "agg_trade_id bigint, price double, quantity double, first_trade_id bigint, last_trade_id bigint, "
    "transact_time bigint, is_buyer_maker boolean"
)
HEADLINES = "date date, ticker string, headline string, true_label string, volume double"
# Fixed value: epoch numbers above this are microseconds, others milliseconds.
MICROSECOND_FLOOR = 100_000_000_000_000


def epoch_time(t: Column) -> Column:
    return F.when(t > MICROSECOND_FLOOR, F.timestamp_micros(t)).otherwise(F.timestamp_millis(t))


def _csv(spark: SparkSession, path: str | Sequence[str], schema: str, header: bool, pattern: str | None = None) -> DataFrame:
    # A line that does not fit the schema fails the read; nulls in its place would go unseen.
    reader = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.csv(path if isinstance(path, str) else list(path))


def read_ohlcv(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Candles with a header row, or Parquet with the same columns."""
    if fmt == "parquet":
        raw = spark.read.schema(OHLCV).parquet(path)
    else:
        raw = _csv(spark, path, OHLCV, header=True)
    return raw.withColumnsRenamed({"timestamp": "ts", "symbol": "series_id"})


def read_klines_archive(spark: SparkSession, path: str | Sequence[str], series: Column | None = None) -> DataFrame:
    """Header-less candle archives; the epoch unit is told by its magnitude.

    The series is taken from the file name up to the first dash unless given.
    """
    raw = _csv(spark, path, KLINES, header=False)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    out = raw.withColumn("src", name)
    owner = series if series is not None else F.split("src", "-")[0]
    return out.select(
        owner.alias("series_id"), epoch_time(F.col("open_time")).alias("ts"), F.to_date(epoch_time(F.col("open_time"))).alias("date"),
        "open", "high", "low", "close", "volume", "open_time", "src",
    )


def read_depth(spark: SparkSession, folder: str) -> DataFrame:
    """All daily book-depth files of a folder in one scan."""
    raw = _csv(spark, folder, DEPTH, header=True, pattern="*.csv")
    return raw.withColumnRenamed("timestamp", "ts")


def read_agg_trades(spark: SparkSession, folder: str) -> DataFrame:
    """All aggregated-trade files of a folder in one scan, epoch milliseconds to time."""
    raw = _csv(spark, folder, AGG_TRADES, header=True, pattern="*.csv")
    return raw.withColumn("ts", F.timestamp_millis("transact_time")).drop("transact_time")


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(HEADLINES).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    return reader.csv(path)


def stitch_and_dedup(klines: DataFrame, keys: Sequence[str] = ("series_id", "date"), order: Sequence[str] = ("src", "open_time")) -> DataFrame:
    """One candle per key: the one of the last file, then of the last open time.

    A keyed aggregate keeps the winner, so copies are reduced before the
    shuffle and a heavily copied key is no burden.
    """
    rest = [c for c in klines.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return klines.groupBy(*keys).agg(best).select(*keys, "_best.*")
