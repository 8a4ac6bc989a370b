"""Irregular readings onto a regular grid, gaps filled by a seasonal regression with bridged residuals.

Each source has a bar width in minutes; its periods are aligned to 1970-01-01 00:00 UTC and run from the period of its
first to that of its last reading. The value of a period is the mean of its finite readings.

Method. Per source, x ~ 1 + trend + daily and weekly harmonics, fitted by normal equations: sums of products, first per source
and time block (on the map side and where the block's rows meet anyway), then per source; a solver sees one small matrix per
source. A period without a value gets the fitted value plus the residual, interpolated linearly between the nearest valued
periods around it; before the first or after the last of these the nearest residual.

Scale. Rows meet in (source, time block), never in a whole source. What crosses blocks (the nearest valued periods, the
next block's first period, the coefficients) travels in one row per source and block, whose number is bounded by the
calendar. The model is evaluated at gaps and at their two ends alone. Gaps are unrolled in chunks, so that no array grows with a gap.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lagweave.functions.instants import step_of, utc_text
from lagweave.functions.keys import decode_key
from lagweave.operators.readings import beside, finite, readings

WEEK_MIN = 10_080
BLOCK_PERIODS = 256
GAP_CHUNK = 4_096


def _harmonics(minute_of_week: Column, daily: int, weekly: int) -> list[Column]:
    """1, then sine and cosine of each harmonic of the day and the week; those above the first by the angle sum, which costs no further sine."""
    out = [F.lit(1.0)]
    for length, count in ((1_440, daily), (WEEK_MIN, weekly)):
        angle = minute_of_week * F.lit(2 * math.pi / length)
        s1, c1 = F.sin(angle), F.cos(angle)
        s, c = s1, c1
        for j in range(count):
            if j:
                s, c = s * c1 + c * s1, c * c1 - s * s1
            out += [s, c]
    return out


def _solver(n: int):
    """Least squares from the upper triangle of X'X and from X'y; the last unknown is the trend. Degenerate directions get 0."""

    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        a = np.zeros((len(xtx), n, n))
        i, j = np.triu_indices(n)
        a[:, i, j] = np.stack(xtx.to_numpy())
        a[:, j, i] = a[:, i, j]
        b = np.stack(xty.to_numpy()).astype(float)
        # Centre and scale the trend: its raw sums are days since 2000.
        count = a[:, 0, 0]
        mean = a[:, 0, -1] / count
        spread = np.sqrt(np.maximum(a[:, -1, -1] / count - mean**2, 0))
        scale = np.where(spread > 1e-6, spread, 1.0)
        to = np.broadcast_to(np.eye(n), a.shape).copy()
        to[:, 0, -1] = -mean / scale
        to[:, -1, -1] = 1 / scale
        c = np.swapaxes(to, 1, 2) @ a @ to
        beta = np.linalg.pinv(c, rcond=1e-9, hermitian=True) @ (np.swapaxes(to, 1, 2) @ b[:, :, None])
        return pd.Series(list((to @ beta)[:, :, 0]))

    return solve


def _with_regressors(df: DataFrame, p: Column, bar: Column, prefix: str, daily: int, weekly: int) -> DataFrame:
    """Adds the regressors of period p as columns: each harmonic is worked out once, whatever reads it."""
    h = _harmonics(F.pmod(p * bar, F.lit(WEEK_MIN)), daily, weekly)[1:]
    return df.select("*", *(c.alias(f"{prefix}{i}") for i, c in enumerate(h, 1)), (p * bar / F.lit(1_440.0) - F.lit(10_957.0)).alias(f"{prefix}t"))


def _regressors(prefix: str, daily: int, weekly: int) -> list[Column]:
    return [F.lit(1.0), *(F.col(f"{prefix}{i}") for i in range(1, 2 * (daily + weekly) + 1)), F.col(f"{prefix}t")]


def _value(prefix: str, daily: int, weekly: int) -> Column:
    return reduce(lambda a, b: a + b, (c * F.get("beta", F.lit(i)) for i, c in enumerate(_regressors(prefix, daily, weekly))))


def _sums(daily: int, weekly: int) -> list[Column]:
    """X'X (upper triangle, row by row) and X'y over the rows with a value."""
    r, x, some = _regressors("h", daily, weekly), F.col("x"), F.col("x").isNotNull()
    sums = [F.sum(F.when(some, a * b)) for i, a in enumerate(r) for b in r[i:]] + [F.sum(a * x) for a in r]
    return [c.alias(f"s{i}") for i, c in enumerate(sums)]


def fit_seasonal(sums: DataFrame, daily: int = 2, weekly: int = 2) -> DataFrame:
    """k, beta: coefficients of the harmonics, then of the trend per day, from the sums of a source's parts; a source without a value has no row."""
    n = 2 * (daily + weekly) + 2
    pairs = n * (n + 1) // 2
    whole = sums.groupBy("k").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(pairs + n))).where("s0 > 0")
    solve = F.pandas_udf(_solver(n), ArrayType(DoubleType()))
    return whole.select("k", solve(F.array(*(f"s{i}" for i in range(pairs))), F.array(*(f"s{i}" for i in range(pairs, pairs + n)))).alias("beta"))


def regular_grid(df: DataFrame, daily: int = 2, weekly: int = 2, block_periods: int = BLOCK_PERIODS, gap_chunk: int = GAP_CHUNK, least: float | None = None, **columns) -> DataFrame:
    """One row per source and period.

    least: values below it are impossible and count as not finite, neither fitted nor bridged from.

    Columns: feed, bar_minutes, period_us, period_start (text, UTC), status, n_readings, x, x_fitted.
    status: observed (mean of finite readings), repaired (readings, none of them finite; x is filled), filled (no reading,
    x is filled), missing (no reading and the source has no finite value at all, x is NULL).
    NULL sources form a source of their own. Rows with NULL or unreadable time, NULL value, or a bar that is NULL or not positive
    take no part; repeated rows count once; an empty table gives an empty grid. columns: names as in readings().
    """
    got = readings(df, bars=True, **columns)
    period = step_of(F.col("us"), F.col("bar") * 60_000_000)
    value = F.when(finite(F.col("x")) & (F.lit(True) if least is None else F.col("x") >= least), F.col("x"))
    got = got.select("k", "bar", step_of(F.col("us"), F.col("bar") * F.lit(60_000_000 * block_periods)).alias("block"), period.alias("p"), value.alias("x"))
    periods = got.repartition("k", "bar", "block").groupBy("k", "bar", "block", "p").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))

    valued = F.when(F.col("x").isNotNull(), F.col("p"))
    ends = [F.min("p").alias("first_p"), F.min(valued).alias("pa"), F.min_by("x", valued).alias("xa"), F.max(valued).alias("pb"), F.max_by("x", valued).alias("xb")]
    blocks = _with_regressors(periods, F.col("p"), F.col("bar"), "h", daily, weekly).groupBy("k", "bar", "block").agg(*ends, *_sums(daily, weekly))
    beta = fit_seasonal(blocks, daily, weekly)
    order = Window.partitionBy("k", "bar").orderBy("block")
    point = lambda p, x: F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("p"), F.col(x).alias("x")))
    carried = blocks.select("k", "bar", "block", "first_p", point("pa", "xa").alias("first_at"), point("pb", "xb").alias("last_at")).select(
        "k", "bar", "block", F.lead("first_p").over(order).alias("next_p"),
        beside("lag", "last_at", ["k", "bar"], "block").alias("left_at"), beside("lead", "first_at", ["k", "bar"], "block").alias("right_at"),
    ).join(beta, "k", "left")

    inside = Window.partitionBy("k", "bar", "block").orderBy("p")
    runs = periods.withColumn("at", F.when(F.col("x").isNotNull(), F.struct("p", "x"))).select(
        "k", "bar", "block", "p", "n", "x", "at", F.lead("p").over(inside).alias("following"),
        beside("lag", "at", ["k", "bar", "block"], "p").alias("here"), beside("lead", "at", ["k", "bar", "block"], "p").alias("there"),
    ).join(carried, ["k", "bar", "block"], "left")
    runs = runs.select("k", "bar", "p", "n", "x", "beta", F.coalesce("following", "next_p", F.col("p") + 1).alias("end"), F.coalesce("at", "here", "left_at").alias("a"), F.coalesce("there", "right_at").alias("b"))

    # A period with a value and no gap behind it is finished; all others take the residuals at both ends, then their own fit.
    gap = (F.col("end") > F.col("p") + 1) | F.col("x").isNull()
    own = runs.where(F.col("x").isNotNull()).select("k", "bar", F.col("p").alias("q"), "n", "x", "beta")
    gaps = runs.where(gap).select("k", "bar", F.when(F.col("x").isNull(), F.col("p")).otherwise(F.col("p") + 1).alias("from_q"), F.col("p").alias("own_p"), "n", "beta", "end", "a.p", "a.x", F.col("b.p").alias("pb"), F.col("b.x").alias("xb"))
    gaps = _with_regressors(_with_regressors(gaps, F.col("p"), F.col("bar"), "a", daily, weekly), F.col("pb"), F.col("bar"), "b", daily, weekly)
    gaps = gaps.select("k", "bar", "from_q", "own_p", "n", "beta", "end", F.col("p").alias("pa"), "pb", (F.col("x") - _value("a", daily, weekly)).alias("ra"), (F.col("xb") - _value("b", daily, weekly)).alias("rb"))
    chunks = gaps.select("*", F.explode(F.sequence("from_q", F.col("end") - 1, F.lit(gap_chunk).cast("long"))).alias("chunk"))
    cells = chunks.select("*", F.explode(F.sequence("chunk", F.least(F.col("chunk") + gap_chunk, F.col("end")) - 1)).alias("q"))
    cells = _with_regressors(cells, F.col("q"), F.col("bar"), "q", daily, weekly).withColumn("fit", _value("q", daily, weekly))
    between = F.col("ra") + (F.col("rb") - F.col("ra")) * (F.col("q") - F.col("pa")) / (F.col("pb") - F.col("pa"))
    bridge = F.when(F.col("ra").isNull(), F.col("rb")).when(F.col("rb").isNull(), F.col("ra")).otherwise(between)
    repaired = F.col("q") == F.col("own_p")
    filled = F.col("fit") + bridge
    status = F.when(repaired, "repaired").when(filled.isNotNull(), "filled").otherwise("missing")
    out = cells.select("k", "bar", "q", status.alias("status"), F.when(repaired, F.col("n")).otherwise(F.lit(0)).alias("n_readings"), filled.alias("x"), F.col("fit").alias("x_fitted"))
    seen = _with_regressors(own, F.col("q"), F.col("bar"), "q", daily, weekly)
    seen = seen.select("k", "bar", "q", F.lit("observed").alias("status"), F.col("n").alias("n_readings"), "x", _value("q", daily, weekly).alias("x_fitted"))
    start = F.col("q") * F.col("bar") * F.lit(60_000_000)
    return out.unionByName(seen).select(
        decode_key(F.col("k")).alias("feed"), F.col("bar").cast("int").alias("bar_minutes"), start.alias("period_us"), utc_text(start, "time").alias("period_start"), "status", "n_readings", "x", "x_fitted",
    )
