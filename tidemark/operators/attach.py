"""Attach a whole-table aggregate to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate; its size does not depend on the data.

    ``one_row`` must come from an aggregate without keys, which has exactly one
    row, so sending it to every task is safe and no rows are multiplied.
    """
    return df.crossJoin(F.broadcast(one_row))
