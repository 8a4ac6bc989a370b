"""Bars, returns and moves over a stream of ticks.

Bars are event-time windows with a watermark. A return needs the bar before, kept per instrument in state as two numbers; the
batch functions give the same rows on the same ticks, as long as none is later than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOVES = "inst string, ts timestamp, price double, x double, move string"


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """inst, ts (the bar's start), price: the mean of each closed bar. ticks: inst, ts (timestamp), price."""
    windowed = ticks.withWatermark("ts", late).groupBy("inst", F.window("ts", width).alias("w"))
    return windowed.agg(F.avg("price").alias("price")).select("inst", F.col("w.start").alias("ts"), "price")


def moves(bar_stream: DataFrame) -> DataFrame:
    """Percent change and move of each bar against the instrument's bar before; the first has neither.

    bar_stream: a stream over the table into which bars() writes (state may not follow an aggregation within one query).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(frames)).sort_values("ts")
        last = state.get[0] if state.exists else None
        prev = [last, *got["price"].tolist()[:-1]]
        x = [100 * (p / q - 1) if q else None for p, q in zip(got["price"], prev)]
        move = [None if v is None else "Up" if p > q else "Down" if p < q else "Stay" for p, q, v in zip(got["price"], prev, x)]
        state.update((float(got["price"].iloc[-1]),))
        yield pd.DataFrame({"inst": key[0], "ts": got["ts"].to_numpy(), "price": got["price"].to_numpy(), "x": pd.Series(x, dtype=float).to_numpy(), "move": move})

    return bar_stream.groupBy("inst").applyInPandasWithState(step, MOVES, "last double", "append", GroupStateTimeout.NoTimeout)
