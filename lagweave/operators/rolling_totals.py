"""Totals and means over trailing periods of days, days without activity included.

Method: binary doubling. Over a dense run of days the totals of 1, 2, 4, 8, ... days are built, each from two shifted
copies of the one before; a window of any length is the sum of the blocks of its binary digits, laid end to end
(7 = 4 + 2 + 1, 30 = 16 + 8 + 4 + 2). Only additions occur, so nothing cancels, and a window of w days costs log2(w) steps.

Scale: rows are reduced to one per source and day before any window; a source then holds as many rows as the calendar has
days between its first and last, however many readings it has. All doubling steps share one partitioning and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.instants import DAY_US, day_of, utc_text
from lagweave.functions.keys import decode_key
from lagweave.operators.readings import finite, readings


def trailing_sums(dense: DataFrame, key: str, day: str, values: list[str], windows: list[int]) -> DataFrame:
    """Adds {value}_{w}d for each value and window. dense: one row per key and day without holes; days before the first count as 0."""
    if any(w < 1 for w in windows):
        raise ValueError("windows are positive numbers of days")
    order = Window.partitionBy(key).orderBy(day)
    back = lambda name, n: F.coalesce(F.lag(name, n).over(order), F.lit(0)) if n else F.col(name)
    top = max(windows).bit_length()
    out = dense.select("*", *(F.coalesce(F.col(v), F.lit(0)).alias(f"_{v}_1") for v in values))
    for b in range(1, top):
        half = 1 << (b - 1)
        out = out.select("*", *((F.col(f"_{v}_{half}") + back(f"_{v}_{half}", half)).alias(f"_{v}_{2 * half}") for v in values))

    def total(v: str, w: int) -> Column:
        acc, done = None, 0
        for b in reversed(range(top)):
            if w >> b & 1:
                block = back(f"_{v}_{1 << b}", done)
                acc, done = block if acc is None else acc + block, done + (1 << b)
        return acc.alias(f"{v}_{w}d")

    return out.select(*dense.columns, *(total(v, w) for v in values for w in windows))


def rolling_totals(df: DataFrame, windows: tuple[int, ...] = (7, 30), **columns) -> DataFrame:
    """One row per source and UTC day, from the day of its first to that of its last reading.

    Columns: feed, day_utc (text), n_readings, then for each window w: sum_wd, mean_wd over the finite values of the w days ending
    that day (NULL if there are none) and n_wd, their number. NULL sources form a source of their own; rows without a readable
    time or with NULL value take no part; NaN and infinite readings make their day active but add nothing; repeated deliveries
    count once. An empty table gives no rows.
    """
    got = readings(df, **columns)
    ok = finite(F.col("x"))
    daily = got.groupBy("k", day_of(F.col("us")).alias("day")).agg(F.count(F.lit(1)).alias("n_readings"), F.count_if(ok).alias("n"), F.sum(F.when(ok, F.col("x"))).alias("sum"))
    order = Window.partitionBy("k").orderBy("day")
    spans = daily.withColumn("end", F.coalesce(F.lead("day").over(order), F.col("day") + 1))
    dense = spans.select("k", F.col("day").alias("active"), "n_readings", "n", "sum", F.explode(F.sequence(F.col("day"), F.col("end") - 1)).alias("day"))
    own = F.col("day") == F.col("active")
    dense = dense.select("k", "day", *(F.when(own, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("n_readings", "n", "sum")))
    out = trailing_sums(dense, "k", "day", ["n", "sum"], list(windows))
    cols = []
    for w in windows:
        some = F.col(f"n_{w}d") > 0
        cols += [F.when(some, F.col(f"sum_{w}d")).alias(f"sum_{w}d"), F.when(some, F.col(f"sum_{w}d") / F.col(f"n_{w}d")).alias(f"mean_{w}d"), F.col(f"n_{w}d").cast("long").alias(f"n_{w}d")]
    return out.select(decode_key(F.col("k")).alias("feed"), utc_text(F.col("day") * F.lit(DAY_US), "date").alias("day_utc"), F.col("n_readings").cast("long").alias("n_readings"), *cols)
