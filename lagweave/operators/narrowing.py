"""Values at given ranks of many groups, by narrowing intervals of values until each is one value.

Each pass divides every open interval into `splits` parts, counts the rows in each part (on the map side first) and goes on with
the part that holds the rank, shrunk to the least and greatest value in it. No pass sorts or gathers a group: a window sees one
row per part. Once few distinct values are left in all open intervals together, they are ranked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.session import stored

#: So many distinct values, over all groups, are few: one task ranks them in well under a second.
FEW = 50_000
#: Up to this many intervals (some 50 bytes each) are broadcast.
BROADCAST_INTERVALS = 20_000
SPREAD = 16
KEYS = ["k", "lo", "hi"]


def holds(rank: str | Column, below: str = "below", n: str = "n"):
    """Whether rows number below, below + 1, ..., below + n - 1 include the rank."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return (F.col(below) <= r) & (r < F.col(below) + F.col(n))


def _pick(parts: DataFrame, state: DataFrame) -> DataFrame:
    """state with the part of its interval that holds the rank."""
    run = Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    at = parts.withColumn("before", F.sum("n").over(run) - F.col("n"))
    got = state.join(at, KEYS).withColumn("below", F.col("below") + F.col("before"))
    return got.where(holds("r")).select("k", "r", "below", F.col("least").alias("lo"), F.col("most").alias("hi"))


def _inside(counts: DataFrame, state: DataFrame) -> DataFrame:
    """The values within open intervals, with their interval. Few intervals are broadcast; of many, each meets the values of its group in several parts."""
    intervals = state.select(*KEYS).distinct()
    if intervals.count() <= BROADCAST_INTERVALS:
        met = counts.join(F.broadcast(intervals), "k")
    else:
        each = intervals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        met = counts.withColumn("_part", F.pmod(F.xxhash64("x"), F.lit(SPREAD)).cast("int")).join(each, ["k", "_part"]).drop("_part")
    return met.where(F.col("x").between(F.col("lo"), F.col("hi")))


def values_at(counts: DataFrame, state: DataFrame, splits: int = 64, few: int = FEW) -> DataFrame:
    """k, r, v: the value at each rank.

    counts: (k, x, n), each value of the groups' open intervals and how often it occurs. state: (k, r, below, lo, hi), the
    wanted ranks, each with its interval [lo, hi], ends that occur, and the number of the group's rows below lo; different
    intervals of a group don't overlap. Both are read several times: hand in tables. k must not be NULL, x finite. A rank that is none has no row.
    """
    found = [state.where("lo = hi").select("k", "r", F.col("lo").alias("v"))]
    state, used = state.where("lo < hi"), None
    while True:
        met = _inside(counts, state)
        left = met.count()
        if left <= few:
            if left:
                values = met.select(*KEYS, F.col("x").alias("part"), "n", F.col("x").alias("least"), F.col("x").alias("most"))
                found.append(_pick(values, state).select("k", "r", F.col("lo").alias("v")))
            return reduce(DataFrame.unionByName, found)
        part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * splits), F.lit(splits - 1))
        parts = met.groupBy(*KEYS, part.alias("part")).agg(F.sum("n").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        state = stored(_pick(parts, state))
        found.append(state.where("lo = hi").select("k", "r", F.col("lo").alias("v")))
        state = state.where("lo < hi")
        counts = stored(_inside(counts, state).select("k", "x", "n"), done=[used] if used else [])
        used = counts
