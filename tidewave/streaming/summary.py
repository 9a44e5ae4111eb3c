"""The stream summary as a Structured Streaming fold.

Chunks of a channel may come in any order and any number: the state of a channel is a
few numbers that merge (count, sums, extremes and how often they occur). There is no
notion of lateness, so no watermark; the fold gives what the batch summary gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "n long, s double, ss double, lo double, hi double, n_lo long, n_hi long, n_bad long"
RESULT = f"session long, channel string, {STATE}, rms double"


def merge(a: tuple, b: tuple) -> tuple:
    """Two states as one: an extreme's count is of the states that reach it."""
    lo, hi = min(a[3], b[3]), max(a[4], b[4])
    return (
        a[0] + b[0], a[1] + b[1], a[2] + b[2], lo, hi,
        a[5] * (a[3] == lo) + b[5] * (b[3] == lo), a[6] * (a[4] == hi) + b[6] * (b[4] == hi), a[7] + b[7],
    )


EMPTY = (0, 0.0, 0.0, math.inf, -math.inf, 0, 0, 0)


def summarize(values: pd.Series) -> tuple:
    """The state of some samples; non-finite ones are counted, not folded."""
    good = values[values.map(math.isfinite)]
    if good.empty:
        return (*EMPTY[:7], len(values))
    lo, hi = good.min(), good.max()
    return (
        len(good), float(good.sum()), float((good * good).sum()), float(lo), float(hi),
        int((good == lo).sum()), int((good == hi).sum()), len(values) - len(good),
    )


def fold_stream(samples: DataFrame) -> DataFrame:
    """samples (session, channel, value), streaming or not, folded per channel."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else EMPTY
        for rows in batches:
            now = merge(now, summarize(rows["value"]))
        state.update(tuple(now))
        rms = math.sqrt(now[2] / now[0]) if now[0] else None
        yield pd.DataFrame([(*key, *now, rms)], columns=[f.split()[0] for f in RESULT.split(", ")])

    return samples.select("session", "channel", "value").groupBy("session", "channel").applyInPandasWithState(
        run, RESULT, STATE, "update", GroupStateTimeout.NoTimeout
    )
