"""Exact interpolated quantiles of any number of groups and values, without gathering a group.

A sketch in logarithmic cells tells which cells hold the wanted ranks; only the distinct values of these are sorted, cell by cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators.readings import finite
from lagweave.operators.spikes import cell_of, ranked, sketch


def quantiles(rows: DataFrame, by: list[str], x: str, ps: list[float]) -> DataFrame:
    """by, p, value: linear interpolation between the values at floor and ceiling of (n - 1) p. NULL, NaN and infinite x are left out; by must not be NULL."""
    good = rows.where(finite(F.col(x))).select(*by, F.col(x).alias("x"))
    r = ranked(sketch(good, by), by, ["cell"])
    place = (F.col("total") - 1) * F.col("p")
    wanted = r.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps)))).withColumn("place", place)
    wanted = wanted.withColumn("rank", F.explode(F.array(F.floor("place"), F.ceil("place")))).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
    cells = wanted.select(*by, "cell").distinct()
    counts = good.withColumn("cell", cell_of(F.col("x"))).join(cells, [*by, "cell"]).groupBy(*by, "cell", "x").agg(F.count(F.lit(1)).alias("m"))
    run = Window.partitionBy(*by, "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("m").over(run))
    met = wanted.select(*by, "cell", "p", "place", "rank", "below").join(counts, [*by, "cell"])
    start = F.col("below") + F.col("upto") - F.col("m")
    hit = met.where((start <= F.col("rank")) & (F.col("rank") < start + F.col("m")))
    ends = hit.groupBy(*by, "p", "place").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return ends.select(*by, "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("value"))
