"""Time-varying hedge ratios by a two-state Kalman filter per pair."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.session import fan_out

# Filter settings.
DELTA = 1e-4
BURN_IN = 60
R_LAMBDA = 2.0 / 31.0
PRIOR_SCALE = 1e4
R_FLOOR = 1e-8

OUTPUT = ("alpha", "beta", "spread", "innovation_variance", "zscore")


def burn_in_variance(y: Sequence[float], x: Sequence[float]) -> float:
    """Residual variance (n - 2) of a straight-line fit over the burn-in rows."""
    y, x = np.asarray(y, dtype=float), np.asarray(x, dtype=float)
    known = np.isfinite(y) & np.isfinite(x)
    y, x = y[known], x[known]
    if not len(y):
        return R_FLOOR
    dx, dy = x - x.mean(), y - y.mean()
    sxx = float(dx @ dx)
    slope = float(dx @ dy) / sxx if sxx > 0 else 0.0
    resid = dy - slope * dx
    return max(float(resid @ resid) / max(len(y) - 2, 1), R_FLOOR)


@dataclass
class FilterState:
    """What one pair carries from row to row: six numbers and the burn-in rows."""

    alpha: float = 0.0
    beta: float = 0.0
    p_aa: float = PRIOR_SCALE
    p_ab: float = 0.0
    p_bb: float = PRIOR_SCALE
    r: float | None = None
    held_y: list[float] = field(default_factory=list)
    held_x: list[float] = field(default_factory=list)

    def advance(self, y: float, x: float, q: float, r_lambda: float) -> tuple[float | None, ...]:
        """Use one observation; the variance R is updated for the next one.

        A row without both prices only lets the uncertainty grow, and gives nulls.
        """
        p_aa, p_ab, p_bb = self.p_aa + q, self.p_ab, self.p_bb + q
        if y is None or x is None or not (math.isfinite(y) and math.isfinite(x)):
            self.p_aa, self.p_bb = p_aa, p_bb
            return (None,) * len(OUTPUT)
        err = y - (self.alpha + self.beta * x)
        g_a, g_b = p_aa + p_ab * x, p_ab + p_bb * x
        var = g_a + g_b * x + self.r
        k_a, k_b = g_a / var, g_b / var
        self.alpha += k_a * err
        self.beta += k_b * err
        self.p_aa, self.p_ab, self.p_bb = p_aa - k_a * g_a, p_ab - k_a * g_b, p_bb - k_b * g_b
        self.r = (1.0 - r_lambda) * self.r + r_lambda * err * err
        return self.alpha, self.beta, err, var, err / var**0.5


class FilterBank:
    """The filters of all pairs of a task as arrays, advanced together."""

    def __init__(self, q: float, r_lambda: float) -> None:
        self.q, self.r_lambda = q, r_lambda
        self.numbers: dict[tuple, int] = {}
        self.state = np.zeros((6, 0))

    def number(self, keys: list[tuple]) -> np.ndarray:
        """Numbers of pairs; new ones start from the prior, their variance not known."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self.numbers]
        self.numbers |= {k: len(self.numbers) + i for i, k in enumerate(fresh)}
        start = np.array([0.0, 0.0, PRIOR_SCALE, 0.0, PRIOR_SCALE, np.nan])
        self.state = np.concatenate([self.state, np.repeat(start[:, None], len(fresh), axis=1)], axis=1)
        return np.array([self.numbers[k] for k in keys], dtype=np.int64)

    def advance(self, at: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Use one observation of each of some pairs; the rows of ``OUTPUT``, NaN without both prices."""
        alpha, beta, p_aa, p_ab, p_bb, r = self.state[:, at]
        p_aa, p_bb = p_aa + self.q, p_bb + self.q
        known = np.isfinite(y) & np.isfinite(x)
        err = np.where(known, y - (alpha + beta * x), np.nan)
        g_a, g_b = p_aa + p_ab * x, p_ab + p_bb * x
        var = g_a + g_b * x + r
        with np.errstate(invalid="ignore"):
            k_a, k_b = g_a / var, g_b / var
            new = np.stack([alpha + k_a * err, beta + k_b * err, p_aa - k_a * g_a, p_ab - k_a * g_b, p_bb - k_b * g_b, (1.0 - self.r_lambda) * r + self.r_lambda * err * err])
            self.state[:, at] = np.where(known, new, np.stack([alpha, beta, p_aa, p_ab, p_bb, r]))
            return np.where(known, np.stack([new[0], new[1], err, var, err / np.sqrt(var)]), np.nan)


def kalman_hedge(
    pairs: DataFrame, delta: float = DELTA, burn_in: int = BURN_IN, r_lambda: float = R_LAMBDA,
    y: str = "y", x: str = "x", by: Sequence[str] = ("pair",), ts: str = "date",
) -> DataFrame:
    """Filtered alpha and beta, innovation, its variance and z-score for every pair.

    The variance update squares the innovation, so the recursion cannot be cut
    in parts; pairs run in parallel. Rows arrive in time order and stream through
    the task, which keeps six numbers for each of its pairs and advances all
    pairs by one observation at a time. Rows of the burn-in are held back until
    the starting variance is known (at most ``burn_in`` per pair).
    """
    by = list(by)
    keep = [*by, ts, y, x]
    q = delta / (1.0 - delta)
    fields = [f for f in pairs.select(*keep).schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema += "".join(f", {c} double" for c in OUTPUT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank, waiting = FilterBank(q, r_lambda), None

        def filtered(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            """Results of the pairs whose variance is known or can be now, and the rows that go on waiting."""
            kinds = rows[by].drop_duplicates()
            numbers = bank.number(list(kinds.itertuples(index=False, name=None)))
            at = rows[by].merge(kinds.assign(_n=numbers), on=by, how="left")["_n"].to_numpy()
            ys, xs = rows[y].to_numpy(dtype=float, na_value=np.nan), rows[x].to_numpy(dtype=float, na_value=np.nan)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            sizes = np.diff(np.append(starts, len(order)))
            place = np.empty(len(rows), dtype=np.int64)
            place[order] = np.arange(len(order)) - np.repeat(starts, sizes)
            for start, size in zip(starts, sizes):
                one = at[order[start]]
                if np.isnan(bank.state[5, one]) and (last or size >= burn_in):
                    first = order[start : start + burn_in]
                    bank.state[5, one] = burn_in_variance(ys[first], xs[first])
            ready = ~np.isnan(bank.state[5, at])
            out = np.full((len(OUTPUT), len(rows)), np.nan)
            # The k-th rows of all pairs are one step; a pair is in it once at most.
            steps = np.flatnonzero(ready)[np.argsort(place[ready], kind="stable")]
            cuts = np.flatnonzero(np.diff(place[steps])) + 1
            for step in np.split(steps, cuts) if len(steps) else []:
                out[:, step] = bank.advance(at[step], ys[step], xs[step])
            done = rows[ready].assign(**{c: v[ready] for c, v in zip(OUTPUT, out)})
            return done, rows[~ready]

        for pdf in batches:
            rows = pdf[keep] if waiting is None or not len(waiting) else pd.concat([waiting, pdf[keep]], ignore_index=True)
            done, waiting = filtered(rows.reset_index(drop=True), False)
            if len(done):
                yield done
        if waiting is not None and len(waiting):
            yield filtered(waiting.reset_index(drop=True), True)[0]

    rows = fan_out(pairs.select(*keep), *by).sortWithinPartitions(ts, *by)
    return rows.mapInPandas(run, schema)
