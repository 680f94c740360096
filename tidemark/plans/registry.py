"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same rows in an independent engine."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Values such as 1/32 sit exactly between two 6-digit numbers, where engines
# round differently; a shift far below the last digit decides those the same way.
NUDGE = 3.1e-9


def snapped(c, digits: int = 6):
    return F.round(c + NUDGE, digits)


def snapped_sql(expr: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE + {NUDGE}, {digits})"


def _plain_zero(value):
    """Turn -0.0 into 0.0, which compare equal but print differently."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output form shared with the SQL: rounded doubles, text dates, 64-bit integers."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(c), snapped(c.cast("double"), digits))
            c = _plain_zero(value)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(cols)


def num(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of ``shown`` for one double column."""
    rounded = snapped_sql(expr, digits)
    return f"CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END AS {name or expr}"


def nums(names: str, digits: int = 6) -> str:
    return ", ".join(num(n, n, digits) for n in names.split())


def day(expr: str, name: str) -> str:
    """SQL twin of ``shown`` for one time column."""
    return f"strftime(({expr})::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS {name}"


def big(expr: str, name: str | None = None) -> str:
    return f"({expr})::BIGINT AS {name or expr}"
