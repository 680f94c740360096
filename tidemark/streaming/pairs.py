"""Online hedge ratios and positions: one small state per pair, in the stream's state store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.kalman import BURN_IN, DELTA, OUTPUT, R_LAMBDA, FilterState, burn_in_variance

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERS = ("alpha", "beta", "p_aa", "p_ab", "p_bb", "r")
NUMBERS_SCHEMA = ", ".join(f"{n} double" for n in NUMBERS)


def use_state_store(spark: SparkSession) -> None:
    """State in RocksDB, which arbitrary state needs and which keeps it off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _in_order(rows: Iterator[pd.DataFrame], ts: str) -> pd.DataFrame:
    """A key's rows of one trigger in time order; the trigger's size bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(ts, kind="stable")


class _HedgeFilter(StatefulProcessor):
    """Six numbers per pair as a value, the rows of its burn-in as a list."""

    def __init__(self, q: float, r_lambda: float, burn_in: int, columns: list[str], held_schema: str) -> None:
        self.q, self.r_lambda, self.burn_in, self.columns, self.held_schema = q, r_lambda, burn_in, columns, held_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", NUMBERS_SCHEMA)
        self.held = handle.getListState("held", self.held_schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """Go on from a batch filter: its last numbers stand for all rows before the stream."""
        self.numbers.update(tuple(float(v) for v in initialState[list(NUMBERS)].iloc[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *by, ts, y, x = self.columns
        fresh = list(_in_order(rows, ts)[[ts, y, x]].itertuples(index=False, name=None))
        if self.numbers.exists():
            state = FilterState(*self.numbers.get())
        else:
            waiting = [*self.held.get(), *fresh] if self.held.exists() else fresh
            if len(waiting) < self.burn_in:
                self.held.appendList(fresh)
                return
            first = waiting[: self.burn_in]
            state, fresh = FilterState(r=burn_in_variance([w[1] for w in first], [w[2] for w in first])), waiting
            self.held.clear()
        out = [(*key, *row, *state.advance(row[1], row[2], self.q, self.r_lambda)) for row in fresh]
        self.numbers.update((state.alpha, state.beta, state.p_aa, state.p_ab, state.p_bb, state.r))
        yield pd.DataFrame(out, columns=[*self.columns, *OUTPUT]).astype({c: float for c in OUTPUT})

    def close(self) -> None:
        pass


def stream_kalman(
    stream: DataFrame, delta: float = DELTA, burn_in: int = BURN_IN, r_lambda: float = R_LAMBDA,
    y: str = "y", x: str = "x", by: Sequence[str] = ("pair",), ts: str = "date", start: DataFrame | None = None,
) -> DataFrame:
    """The batch filter on a stream.

    Rows are sorted inside a trigger. The first ``burn_in`` rows of a pair wait
    in the state and come out together once the starting variance is known.
    ``start`` (by, and the columns of ``NUMBERS``) are the last numbers of a
    batch filter, with which its pairs go on without a burn-in.
    """
    use_state_store(stream.sparkSession)
    by = list(by)
    keep = [*by, ts, y, x]
    fields = {f.name: f.dataType.simpleString() for f in stream.select(*keep).schema.fields}
    schema = ", ".join(f"{n} {t}" for n, t in fields.items()) + "".join(f", {c} double" for c in OUTPUT)
    processor = _HedgeFilter(delta / (1.0 - delta), r_lambda, burn_in, keep, f"ts {fields[ts]}, y double, x double")
    first = None if start is None else start.select(*by, *[F.col(n).cast("double") for n in NUMBERS]).groupBy(*by)
    return stream.select(*keep).groupBy(*by).transformWithStateInPandas(processor, schema, "append", "none", first)


def filter_numbers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of ``stream_kalman`` as a table: one row of numbers for each pair past its burn-in."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "numbers").load()
    return rows.select("key.*", "value.*")


def next_position(position: int, z: float | None, entry: float, exit: float) -> int:
    """One step of the band: flat enters beyond ``entry``, a position leaves inside ``exit``."""
    if z is None or z != z:
        return position
    if position == 0:
        return -1 if z > entry else 1 if z < -entry else 0
    return 0 if abs(z) < exit else position


class _Band(StatefulProcessor):
    """The current position of a pair."""

    def __init__(self, columns: list[str], entry: float, exit: float) -> None:
        self.columns, self.entry, self.exit = columns, entry, exit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "position int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *by, ts, z = self.columns
        position = self.position.get()[0] if self.position.exists() else 0
        frame, out = _in_order(rows, ts), []
        for value in frame[z].to_numpy(dtype=float, na_value=float("nan")):
            position = next_position(position, value, self.entry, self.exit)
            out.append(0 if value != value else position)
        self.position.update((position,))
        yield frame[self.columns].assign(position=out)

    def close(self) -> None:
        pass


def stream_positions(
    stream: DataFrame, z: str = "zscore", entry: float = 2.0, exit: float = 0.5, by: Sequence[str] = ("pair",), ts: str = "date",
) -> DataFrame:
    """Band positions on a stream; the state is the current position."""
    use_state_store(stream.sparkSession)
    by = list(by)
    keep = [*by, ts, z]
    fields = stream.select(*keep).schema.fields
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", position int"
    return stream.select(*keep).groupBy(*by).transformWithStateInPandas(_Band(keep, entry, exit), schema, "append", "none")
