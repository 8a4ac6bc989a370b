"""From prices to aligned, filled, standardized and discretized series.

Prices are long: inst, ts, price. All instruments share one ordinal axis i (0, 1, ...) over the distinct times, so a delay
is a number of rows. Windows run per instrument, whose length is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM_KINDS = ("Up", "Stay", "Down")


def series(order: str = "i") -> Window:
    return Window.partitionBy("inst").orderBy(order)


def instruments(prices: DataFrame) -> list[str]:
    """The instruments of a panel that is to be wide: each becomes a column, so there are no more than a table can have."""
    return sorted(r[0] for r in prices.select("inst").where("inst IS NOT NULL").distinct().collect())


def ordinals(times: DataFrame, ts: str = "ts", block: str = "month") -> DataFrame:
    """ts, i: the rank of each distinct time. Times are ranked within blocks and blocks added up, so no task sorts them all."""
    distinct = times.select(ts).where(F.col(ts).isNotNull()).distinct().withColumn("_b", F.date_trunc(block, ts))
    per = distinct.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("_b", F.coalesce(offset, F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(ts)) - 1
    return distinct.join(starts, "_b").select(ts, (inside + F.col("_o")).cast("long").alias("i"))


def dense_grid(prices: DataFrame, chunk: int = 4_096) -> DataFrame:
    """inst, i, ts, price for every instrument at every time of the panel (outer alignment); price is NULL where there is none.

    An instrument's ordinals are unrolled in chunks and meet times and prices by equal keys; no name or time comes to the driver.
    """
    times = ordinals(prices)
    known = prices.where("inst IS NOT NULL").groupBy("inst", "ts").agg(F.max("price").alias("price"))
    n = times.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(chunk).cast("long")))
    own = known.select("inst").distinct().withColumn("one", F.lit(1)).join(n, "one").select("inst", "n", starts.alias("s"))
    cells = own.select("inst", F.explode(F.sequence("s", F.least(F.col("s") + chunk, F.col("n")) - 1)).alias("i"))
    return cells.join(times, "i").join(known, ["inst", "ts"], "left").select("inst", "i", "ts", "price")


def forward_fill(grid: DataFrame, col: str = "price") -> DataFrame:
    return grid.withColumn(col, F.last(col, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0)))


def fill_both_ways(grid: DataFrame, col: str = "price") -> DataFrame:
    """Forward, then backward for leading gaps."""
    after = F.first(col, ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing))
    before = F.last(col, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn(col, F.coalesce(before, after))


def with_returns(filled: DataFrame) -> DataFrame:
    """Adds prev and x, the percent change; NULL at the start and after a price of 0."""
    prev = F.lag("price").over(series())
    return filled.withColumn("prev", prev).withColumn("x", 100 * (F.try_divide(F.col("price"), F.col("prev")) - 1))


def movement(threshold: float = 0.0) -> list[Column]:
    """Up, Stay, Down as booleans; with threshold 0 prices are compared, not floating-point returns. NULL moves are none of them."""
    if threshold:
        x = F.col("x")
        tests = (x > threshold, x.between(-threshold, threshold), x < -threshold)
    else:
        tests = (F.col("price") > F.col("prev"), F.col("price") == F.col("prev"), F.col("price") < F.col("prev"))
    return [F.coalesce(t & F.col("x").isNotNull(), F.lit(False)).alias(k) for t, k in zip(tests, ITEM_KINDS)]


def discretize(returns: DataFrame, threshold: float = 0.0) -> DataFrame:
    return returns.select("*", *(m.cast("int").alias(k) for m, k in zip(movement(threshold), ITEM_KINDS)))


def items(returns: DataFrame, threshold: float = 0.0) -> DataFrame:
    """i, attr: the cells that are 1, attr being instrument_Up, _Stay or _Down."""
    which = F.when(F.col("Up"), "_Up").when(F.col("Stay"), "_Stay").when(F.col("Down"), "_Down")
    return returns.select("inst", "i", *movement(threshold)).select("i", F.concat("inst", which).alias("attr")).where("attr IS NOT NULL")


def z_score(returns: DataFrame, col: str = "x") -> DataFrame:
    """Adds z: centred and scaled by the sample deviation; a deviation of 0 only centres."""
    w = Window.partitionBy("inst")
    centred = F.col(col) - F.avg(col).over(w)
    sd = F.stddev_samp(col).over(w)
    return returns.withColumn("z", F.when(sd > 0, centred / sd).otherwise(centred))


def rolling_z(returns: DataFrame, width: int = 20, col: str = "x") -> DataFrame:
    """Adds z over the trailing rows; 0 where it is undefined."""
    w = series().rowsBetween(1 - width, 0)
    sd = F.nullif(F.stddev_samp(col).over(w), F.lit(0.0))
    return returns.withColumn("z", F.coalesce((F.col(col) - F.avg(col).over(w)) / sd, F.lit(0.0)))


def rank_scale(returns: DataFrame, col: str = "x") -> DataFrame:
    """Adds z: the average rank, scaled to (-1, 1]; NULLs have none."""
    known = returns.withColumn("_u", F.col(col).isNull())
    order = Window.partitionBy("inst", "_u").orderBy(col)
    ties = F.count(F.lit(1)).over(Window.partitionBy("inst", "_u", col))
    rank = F.rank().over(order) + (ties - 1) / 2
    n = F.count(F.lit(1)).over(Window.partitionBy("inst", "_u"))
    return known.withColumn("z", F.when(~F.col("_u"), (rank / n - 0.5) * 2)).drop("_u")


def extremes(returns: DataFrame, threshold: float) -> DataFrame:
    """Rows at or beyond the threshold, with side positive or negative."""
    side = F.when(F.col("x") >= threshold, "positive").when(F.col("x") <= -threshold, "negative")
    return returns.withColumn("side", side).where("side IS NOT NULL")


def targets(returns: DataFrame, horizons: int = 2, col: str = "x") -> DataFrame:
    """inst, i, ts, n, x0 (the row's own), x1, x2, ...: the future values by lead, NULL past the end."""
    n = F.count(F.lit(1)).over(Window.partitionBy("inst"))
    return returns.select("inst", "i", "ts", n.alias("n"), F.col(col).alias("x0"), *(F.lead(col, k).over(series()).alias(f"x{k}") for k in range(1, horizons + 1)))
