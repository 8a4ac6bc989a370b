"""Percentiles per group over very large columns: exact by bisection, or bounded from summaries of days.

Method. For each group and wanted rank an interval of values is kept. Each pass counts the rows below the points that
divide the interval into `splits` parts (2 is plain bisection; 64 takes a sixth of the passes) and goes on with the part
that holds the rank, shrunk to the least and greatest value in it, until the interval is a single value. The first pass
divides the whole range of doubles at fixed points, the cells of the day summaries; from then on only values inside an
open interval are read, each with its count, from a table.

Error. exact_percentiles: none. From merged day summaries: the true order statistic lies within [lower, upper], the least
and greatest value of one cell, less than 1.1 % apart; merging adds counts, so the bound is the same for any number of days.

Scale. Every pass combines counts on the map side; a group's cells are bounded by the range of doubles. No group is ever
gathered: a hot group is spread over its cells, and equal values over one row with a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions.keys import decode_key
from lagweave.operators.narrowing import FEW, values_at
from lagweave.operators.readings import finite
from lagweave.operators.spikes import cell_of, merge, ranked, sketch
from lagweave.session import discard, stored

#: Up to this many open cells (about 40 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_CELLS = 20_000


def day_summary(rows: DataFrame, day: str) -> DataFrame:
    """k, day, cell, n, lo, hi: mergeable summary of the finite x of each group and day."""
    return sketch(rows.where(finite(F.col("x"))), ["k", day])


def merged_percentiles(summary: DataFrame, ps: list[float]) -> DataFrame:
    """k, p, n, lower, upper from summaries of any days: bounds of the value at rank floor((n - 1) p)."""
    r = ranked(merge(summary, ["k"]), ["k"], ["cell"])
    r = r.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps)))).withColumn("r", F.floor((F.col("total") - 1) * F.col("p")))
    r = r.where((F.col("below") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("n")))
    return r.select("k", "p", F.col("total").alias("n"), F.col("lo").alias("lower"), F.col("hi").alias("upper"))


def exact_percentiles(rows: DataFrame, ps: list[float], splits: int = 64, few: int = FEW) -> DataFrame:
    """k, p, n, lower_value, upper_value, value of the finite x in rows (k, x); n is their number.

    lower_value and upper_value are the values at ranks floor and ceiling of (n - 1) p, value interpolates between them. NULL,
    NaN and infinite x are left out; a group without a finite value has no row; -0.0 counts as 0.0. Runs one job per pass, as many as
    the logarithm to the base `splits` of the distinct values in a cell; once open intervals hold no more than `few` distinct values, they are ranked at once.
    """
    if splits < 2 or not ps or any(not 0 <= p <= 1 for p in ps):
        raise ValueError("splits is at least 2 and each p within 0 and 1")
    good = rows.where(finite(F.col("x"))).select("k", (F.col("x") + F.lit(0.0)).alias("x"))
    r = ranked(sketch(good, ["k"]), ["k"], ["cell"])
    rank = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("total") - 1) * p), F.ceil((F.col("total") - 1) * p)) for p in map(float, ps))))))
    first = r.withColumn("r", rank).where((F.col("below") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("n")))
    state = stored(first.select("k", "total", "cell", "r", "below", "lo", "hi"))
    totals = state.groupBy("k").agg(F.max("total").alias("n"))
    cells = state.where("lo < hi").select("k", "cell").distinct()
    wanted = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    inside = good.withColumn("cell", cell_of(F.col("x"))).join(wanted, ["k", "cell"])
    counts = stored(inside.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")))
    done = stored(values_at(counts, state.select("k", "r", "below", "lo", "hi"), splits, few))
    discard(counts)
    out = totals.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps)))).withColumn("place", (F.col("n") - 1) * F.col("p"))
    side = lambda f, name: done.select("k", F.col("r").alias(f), F.col("v").alias(name))
    out = out.withColumn("ra", F.floor("place")).withColumn("rb", F.ceil("place")).join(side("ra", "lower_value"), ["k", "ra"]).join(side("rb", "upper_value"), ["k", "rb"])
    value = F.col("lower_value") + (F.col("upper_value") - F.col("lower_value")) * (F.col("place") - F.col("ra"))
    return out.select("k", "p", "n", "lower_value", "upper_value", value.alias("value"))


def decode(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, decode_key(F.col("k"))).drop("k")
