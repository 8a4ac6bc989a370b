"""Profiles of series and of matches: rolling windows, calendar, bins, tests.

Windows run per instrument; a series has as many rows as its calendar has steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators.prep import series


def full(value: Column, width: int, window) -> Column:
    """NULL until the frame holds width values."""
    return F.when(F.count("x").over(window) >= width, value)


def correlation(a: str, b: str, window=None) -> Column:
    """Pearson's r over rows where both are known; NULL where a deviation is nothing but rounding (the built-in one fails there)."""
    over = lambda c: c if window is None else c.over(window)
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    sx, sy = over(F.stddev_pop(x)), over(F.stddev_pop(y))
    varied = (sx > 1e-9 * (1 + F.abs(over(F.avg(x))))) & (sy > 1e-9 * (1 + F.abs(over(F.avg(y)))))
    return F.when(varied, F.try_divide(over(F.covar_pop(x, y)), sx * sy))


def rolling(returns: DataFrame, width: int, centred: bool = False) -> DataFrame:
    """Adds roll_mean, roll_sd and roll_sharpe over a full trailing (or centred) frame."""
    w = series().rowsBetween(-(width // 2), width - width // 2 - 1) if centred else series().rowsBetween(1 - width, 0)
    mean, sd = F.avg("x").over(w), F.stddev_samp("x").over(w)
    return returns.select("*", full(mean, width, w).alias("roll_mean"), full(sd, width, w).alias("roll_sd"), full(mean / (sd + 1e-6), width, w).alias("roll_sharpe"))


def rolling_corr(pairs: DataFrame, a: str, b: str, width: int) -> DataFrame:
    w = series().rowsBetween(1 - width, 0)
    both = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).over(w)
    return pairs.withColumn("roll_corr", F.when(both >= width, correlation(a, b, w)))


def growth(returns: DataFrame) -> DataFrame:
    """Adds growth: the product of 1 + x/100 up to the row, kept as sign and logarithm, so that it neither overflows nor fails at 0 or below."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    f = 1 + F.coalesce(F.col("x"), F.lit(0.0)) / 100
    zero, minus = F.count_if(f == 0).over(w), F.count_if(f < 0).over(w)
    size = F.exp(F.sum(F.when(f != 0, F.log(F.abs(f))).otherwise(0.0)).over(w))
    return returns.withColumn("growth", F.when(zero > 0, 0.0).otherwise(F.when(minus % 2 == 1, -size).otherwise(size)))


def autocorrelation(flags: DataFrame, col: str, lags: list[int], by: list[str]) -> DataFrame:
    """by, lag, value: correlation of a flag with itself lag rows before, along i in each group."""
    w = Window.partitionBy(*by).orderBy("i")
    lagged = flags.select(*by, "i", F.col(col).cast("double").alias("v"), *(F.lag(F.col(col).cast("double"), k).over(w).alias(f"v{k}") for k in lags))
    wide = lagged.groupBy(*by).agg(*(correlation("v", f"v{k}").alias(f"c{k}") for k in lags))
    return wide.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("value")) for k in lags))).alias("e")).select(*by, "e.lag", "e.value")


def equal_width_bins(rows: DataFrame, by: list[str], at: str, bins: int) -> DataFrame:
    """Adds bin 1..bins over the group's range of at, right-closed, the least value in the first."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(at).over(w), F.max(at).over(w)
    share = (F.col(at) - lo) * bins / F.nullif(hi - lo, F.lit(0))
    return rows.withColumn("bin", F.greatest(F.lit(1), F.least(F.lit(bins), F.coalesce(F.ceil(share), F.lit(1)))).cast("int"))


def contiguous_splits(rows: DataFrame, by: list[str], at: str, parts: int) -> DataFrame:
    """Adds part 0..parts-1 of equal length, the remainder in the last."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    size = F.greatest(F.floor(n / parts), F.lit(1))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1
    return rows.withColumn("part", F.least(F.floor(place / size), F.lit(parts - 1)).cast("int"))


def moments(rows: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """n, mean, population skewness and excess kurtosis."""
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))


def anova(rows: DataFrame, by: list[str], group: str, x: str) -> DataFrame:
    """by, f, d1, d2 of the one-way analysis of variance over groups, from per-group sums."""
    g = rows.where(F.col(x).isNotNull()).groupBy(*by, group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("ss"))
    total = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy(*by)))
    s = total.groupBy(*by).agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("between"), F.sum("ss").alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return s.select(*by, F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), f).alias("f"), (F.col("k") - 1).alias("d1"), (F.col("n") - F.col("k")).alias("d2"))


def density(rows: DataFrame, by: list[str], x: str, points: int = 64) -> DataFrame:
    """Gaussian kernel density at equally spaced points of each group (bandwidth by Scott's rule).

    Values are first counted in 2048 bins of the group's range, so each point sums over a bounded number of bins.
    """
    w = rows.where(F.col(x).isNotNull()).select(*by, x)
    s = w.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"))
    bins = 2_048
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(x) - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))
    counted = w.join(s, by).where("sd > 0").groupBy(*by, "n", "lo", "hi", "sd", at.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.avg(x).alias("v"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    one = counted.select("*", h.alias("h"), grid.alias("point")).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1))
    z = (F.col("at") - F.col("v")) / F.col("h")
    return one.groupBy(*by, "point", "at").agg((F.sum(F.col("c") * F.exp(-z * z / 2) / F.col("h")) / F.max("n") / 2.5066282746310002).alias("density"))
