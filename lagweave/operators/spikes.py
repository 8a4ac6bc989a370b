"""Implausible spikes, stuck values and impossible readings, judged per source.

Method. A mergeable quantile sketch per source and hour of the day: counts in logarithmic cells (64 to the octave, under
1.1 % wide) with the least and greatest value of each; partitions and days merge by adding counts. Rows outside the hour's
expanded interquartile fences, with an implausible rate of change, or in a run of equal values (zero variance) are flagged.
The hours' sketches merged give each source's median and median absolute deviation (MAD) within bounds. These bounds decide
for almost every row whether it lies further out than 15 MADs; only sources that have a row between them are settled by the
exact median and MAD, found by narrowing within the few cells that the merged sketch leaves open.

Scale. Rows meet in (source, time block), never in a whole source; statistics reach them by one row per source and block.
Sketches combine on the map side. Windows over a source run over its cells or blocks, whose numbers are bounded by the
range of doubles and by the calendar; no window or sort runs over a source's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.instants import DAY_US, step_of
from lagweave.functions.keys import encode_key
from lagweave.operators.narrowing import BROADCAST_INTERVALS, FEW, values_at
from lagweave.operators.readings import beside, finite, readings
from lagweave.session import stored

CELLS_PER_OCTAVE = 64
FAR = 15.0
FENCE = 3.0
RATE = 20.0
STUCK = 6
#: The greatest double.
MOST = 1.7976931348623157e308


def cell_of(x: Column, per_octave: int = CELLS_PER_OCTAVE) -> Column:
    """Number of the logarithmic cell of a finite value; cells ascend with the values. 0 has a cell of its own."""
    size = F.floor(F.log2(F.abs(x)) * per_octave).cast("int") + F.lit(1_200 * per_octave)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def sketch(values: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """by..., cell, n, lo, hi of finite values; merge() of sketches of parts is the sketch of the whole."""
    return values.groupBy(*by, cell_of(F.col(x)).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def ranked(cells: DataFrame, by: list[str], order: list[str], total: str = "total", below: str = "below") -> DataFrame:
    """Adds the number of rows of the group, and of those in cells before this one."""
    whole = Window.partitionBy(*by)
    run = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(total, F.sum("n").over(whole)).withColumn(below, F.sum("n").over(run) - F.col("n"))


def _holds(rank: Column) -> Column:
    return (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))


def hour_fences(hours: DataFrame, fence: float = FENCE) -> DataFrame:
    """k, hour, low, high from the sketch by (k, hour): the quartiles' cells, expanded by fence interquartile ranges."""
    r = ranked(hours, ["k", "hour"], ["cell"])
    at = lambda p, side: F.max(F.when(_holds(F.floor((F.col("total") - 1) * p)), F.col(side)))
    q = r.groupBy("k", "hour").agg(at(0.25, "lo").alias("q1"), at(0.75, "hi").alias("q3"))
    width = F.col("q3") - F.col("q1")
    return q.select("k", "hour", (F.col("q1") - fence * width).alias("low"), (F.col("q3") + fence * width).alias("high"), width.alias("iqr"))


def median_bounds(cells: DataFrame) -> DataFrame:
    """k, total, med_lo, med_hi from the sketch by k: the ends of the cells that hold the middle ranks."""
    r = ranked(cells, ["k"], ["cell"])
    first, last = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return r.groupBy("k").agg(F.max("total").alias("total"), F.max(F.when(_holds(first), F.col("lo"))).alias("med_lo"), F.max(F.when(_holds(last), F.col("hi"))).alias("med_hi"))


def _distance_cells(cells: DataFrame, centre: DataFrame, lo: str, hi: str) -> DataFrame:
    """cells with the least (dl) and greatest (du) distance of their values from the centre interval of their source."""
    c = cells.join(centre, "k")
    dl = F.greatest(F.lit(0.0), F.col("lo") - F.col(hi), F.col(lo) - F.col("hi"))
    return c.withColumn("dl", dl).withColumn("du", F.greatest(F.abs(F.col("hi") - F.col(lo)), F.abs(F.col("lo") - F.col(hi))))


def source_bounds(cells: DataFrame) -> DataFrame:
    """k, total, med_lo, med_hi, mad_lo, mad_hi: certain bounds of the median and of the MAD, from the sketch by k."""
    m = median_bounds(cells)
    d = _distance_cells(cells, m.drop("total"), "med_lo", "med_hi")
    first, last = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    low = ranked(d, ["k"], ["dl", "cell"]).groupBy("k").agg(F.max(F.when(_holds(first), F.col("dl"))).alias("mad_lo"))
    high = ranked(d, ["k"], ["du", "cell"]).groupBy("k").agg(F.max(F.when(_holds(last), F.col("du"))).alias("mad_hi"))
    return m.join(low, "k").join(high, "k")


def _open_values(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """k, x, n, and the other columns of cells: each value of those cells and how often it occurs. Few cells are broadcast; the join by (k, cell) spreads a source."""
    few = cells.select("k", "cell").distinct().count() <= BROADCAST_INTERVALS
    keep = [c for c in cells.columns if c != "cell"]
    met = rows.select("k", "x", cell_of(F.col("x")).alias("cell")).join(F.broadcast(cells) if few else cells, ["k", "cell"])
    return met.groupBy(*keep, "x").agg(F.count(F.lit(1)).alias("n"))


def _middle_ranks() -> Column:
    return F.explode(F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))))


def exact_median_mad(rows: DataFrame, cells: DataFrame, few: int = FEW) -> DataFrame:
    """k, med, mad, exact, with the two middle values averaged.

    rows: (k, x), finite; cells: their sketch by k, a table. Values of cells that cannot hold a middle rank are never looked at.
    """
    r = ranked(cells, ["k"], ["cell"]).withColumn("r", _middle_ranks()).where(_holds(F.col("r")))
    state = stored(r.select("k", "cell", "r", "below", "lo", "hi"))
    open_cells = state.where("lo < hi").select("k", "cell").distinct()
    med = values_at(stored(_open_values(rows, open_cells)), state.drop("cell"), few=few).groupBy("k").agg(F.avg("v").alias("med"))
    med = stored(med)

    d = _distance_cells(cells, med, "med", "med")
    first, last = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    for edge, rank in (("dl", first), ("du", last)):  # the least and greatest that the MAD can be
        d = ranked(d, ["k"], [edge, "cell"]).withColumn(f"mad_{edge}", F.max(F.when(_holds(rank), F.col(edge))).over(Window.partitionBy("k"))).drop("below")
    apart = F.col("du") < F.col("mad_dl")
    d = d.withColumn("below", F.coalesce(F.sum(F.when(apart, F.col("n"))).over(Window.partitionBy("k")), F.lit(0)))
    wanted = d.where(~apart & (F.col("dl") <= F.col("mad_du"))).select("k", "cell", "med", "below", "total")
    away = F.least(F.abs(F.col("x") - F.col("med")), F.lit(MOST))
    far = stored(_open_values(rows, wanted).groupBy("k", "below", "total", away.alias("x")).agg(F.sum("n").alias("n")))
    state = stored(far.groupBy("k", "below", "total").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("r", _middle_ranks()).drop("total"))
    mad = values_at(far.select("k", "x", "n"), state, few=few).groupBy("k").agg(F.avg("v").alias("mad"))
    return med.join(mad, "k")


def impossible(x: Column, least: float) -> Column:
    return ~finite(x) | (x < least)


def statistics(rows: DataFrame, least: float, fence: float, far: float, few: int = FEW) -> DataFrame:
    """Per source k: med_lo, med_hi, mad_lo, mad_hi from the merged sketch, equal where the source had to be settled exactly, and the fences of each hour as a map.

    rows is a table; it is read once for the sketch and once for the values of open cells.
    """
    fine = rows.where(~impossible(F.col("x"), least))
    hours = stored(sketch(fine, ["k", "hour"]))
    fences = hour_fences(hours, fence).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("hour", F.struct("low", "high")))).alias("fences"), F.max("iqr").alias("iqr"))
    cells = stored(merge(hours, ["k"]))
    bounds = stored(source_bounds(cells).join(fences, "k", "left"), done=[hours])
    # A source is open if a value of one of its cells may or may not be far: the cell's ends tell.
    c = cells.select("k", "lo", "hi").join(bounds, "k")
    unsure = lambda x: _reach_most(F.col(x)) > far * F.col("mad_lo"), lambda x: _reach_least(F.col(x)) <= far * F.col("mad_hi")
    maybe = (unsure[0]("lo") | unsure[0]("hi")) & (unsure[1]("lo") | unsure[1]("hi"))
    open_k = stored(c.where(maybe).select("k").distinct())
    if open_k.isEmpty():
        return bounds
    # Sources are many at most; rows of open ones are picked by their cells, so only the cells are joined here.
    exact = exact_median_mad(fine.select("k", "x"), stored(cells.join(open_k, "k", "left_semi")), few)
    settled = bounds.join(exact, "k", "left")
    one = lambda side, value: F.coalesce(value, side).alias(side)
    return stored(settled.select("k", "total", one("med_lo", "med"), one("med_hi", "med"), one("mad_lo", "mad"), one("mad_hi", "mad"), "fences", "iqr"))


def _reach_most(x: Column) -> Column:
    return F.greatest(F.abs(x - F.col("med_lo")), F.abs(x - F.col("med_hi")))


def _reach_least(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.col("med_lo") - x, x - F.col("med_hi"))


def flag_values(rows: DataFrame, least: float = -100.0, fence: float = FENCE, far: float = FAR, order: str | None = None, rate: float = RATE, stuck: int = STUCK, few: int = FEW) -> DataFrame:
    """Flags rows (k, block, hour, id, x) against their source; order: a column of microseconds for rate and stuck runs.

    Adds impossible (NaN, infinite or below least), fenced (outside the hour's fences), far (further than far MADs from the median,
    exactly), rate (change per hour, or in less, since the reading before, if that is finite, greater than rate times
    the source's widest interquartile range) and stuck (in a run of at least `stuck` equal values other than zero). Rows must be unique;
    a NULL x is in no case; a source without a finite value has none but impossible ones. block spreads the rows of a source.
    """
    rows = stored(rows)
    stats = statistics(rows, least, fence, far, few)
    seen = _runs(rows.repartition("k", "block"), order) if order else rows
    info = _edges(seen, order) if order else rows.groupBy("k", "block").agg(F.count(F.lit(1)).alias("in_block"))
    got = seen.join(info.join(stats, "k", "left"), ["k", "block"], "left")
    x, bad = F.col("x"), impossible(F.col("x"), least)
    good = x.isNotNull() & ~bad
    band = F.col("fences")[F.col("hour")]
    flags = {
        "impossible": bad & x.isNotNull(),
        "fenced": good & ((x < band["low"]) | (x > band["high"])),
        # Between the bounds nothing is left: they are equal in any source that has a row there.
        "far": good & (_reach_least(x) > far * F.col("mad_hi")),
        "rate": F.lit(False),
        "stuck": F.lit(False),
    }
    if order:
        hours = (F.col(order) - F.coalesce("before_us", "left_us")) / F.lit(3_600_000_000)
        before = F.coalesce("before_x", "left_x")
        flags["rate"] = good & finite(before) & (F.abs(x - before) / F.greatest(hours, F.lit(1.0)) > rate * F.col("iqr"))
        more = F.when(F.col("start") == 1, F.col("first_more")).otherwise(0) + F.when(F.col("end") == F.col("in_block"), F.col("last_more")).otherwise(0)
        flags["stuck"] = good & (x != 0) & (F.col("end") - F.col("start") + 1 + more >= stuck)
    return got.select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))


def _runs(rows: DataFrame, order: str) -> DataFrame:
    """Adds before_x, before_us (the row before in the block) and start, end (places in the block at which the row's run of equal values begins and ends), in_block."""
    by = ["k", "block"]
    w = Window.partitionBy(*by).orderBy(order)
    r = rows.select("*", F.lag("x").over(w).alias("before_x"), F.lag(order).over(w).alias("before_us"), F.row_number().over(w).alias("place"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("in_block"))
    change = (F.col("place") == 1) | ~F.col("before_x").eqNullSafe(F.col("x"))
    r = r.withColumn("change", F.when(change, F.col("place")))
    start = F.max("change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = r.select("*", start.alias("start"), F.coalesce(beside("lead", "change", by, order) - 1, F.col("in_block")).alias("end"))
    return r.drop("change")


def _edges(seen: DataFrame, order: str) -> DataFrame:
    """Per (k, block): rows equal to the block's first (last) value that directly precede (follow) it in other blocks, and the reading before the block.

    Each block gives its first and its last run of equal values; runs that touch across blocks are joined in a window over
    the source's blocks, of which there are as many as the calendar allows.
    """
    first, last = F.col("start") == 1, F.col("end") == F.col("in_block")
    b = seen.groupBy("k", "block", "in_block").agg(
        F.count_if(first).alias("n1"), F.count_if(last).alias("n2"), F.max(F.when(first, F.col("x"))).alias("x1"), F.max(F.when(last, F.col("x"))).alias("x2"), F.max(order).alias("us2"), F.max(F.when(first, F.col(order))).alias("us1"),
    )
    piece = lambda at, k: F.struct(F.lit(at).alias("at"), F.col(f"n{k}").alias("n"), F.col(f"x{k}").alias("x"), F.col(f"us{k}").alias("us"))
    single = F.col("n1") == F.col("in_block")
    pieces = b.select("k", "block", "in_block", F.explode(F.when(single, F.array(piece(2, 1))).otherwise(F.array(piece(1, 1), piece(3, 2)))).alias("e")).select("k", "block", "in_block", "e.*")
    line = Window.partitionBy("k").orderBy("block", "at")
    joins = (F.col("at") != 3) & F.lag("x").over(line).eqNullSafe(F.col("x")) & F.lag("at").over(line).isNotNull()
    p = pieces.withColumn("left_x", F.lag("x").over(line)).withColumn("left_us", F.lag("us").over(line)).withColumn("g", F.when(joins, 0).otherwise(1))
    p = p.withColumn("g", F.sum("g").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("more", F.sum("n").over(Window.partitionBy("k", "g")) - F.col("n"))
    return p.groupBy("k", "block", "in_block").agg(
        F.max(F.when(F.col("at") != 3, F.col("more")).otherwise(0)).alias("first_more"),
        F.max(F.when(F.col("at") == 3, F.col("more")).otherwise(0)).alias("last_more"),
        F.max(F.when(F.col("at") != 3, F.col("left_x"))).alias("left_x"),
        F.max(F.when(F.col("at") != 3, F.col("left_us"))).alias("left_us"),
    ).drop("in_block")


def feed_rows(df: DataFrame, block_us: int = 16 * DAY_US, **columns) -> DataFrame:
    """Readings of feeds as rows for flag_values."""
    got = readings(df, ids=True, **columns)
    return got.select("k", step_of(F.col("us"), F.lit(block_us)).alias("block"), F.floor(F.pmod(F.col("us"), F.lit(DAY_US)) / F.lit(3_600_000_000)).cast("int").alias("hour"), "id", "x", "us")


def measure_rows(df: DataFrame, source: str, measures: list[str], row_id: str, at: str, spread: int = 32) -> DataFrame:
    """Each measure of each row as a row of its own for flag_values, with the measure in the source's key; block is a hash of the id."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures)))
    long = df.select(encode_key(F.col(source)).alias("s"), F.col(row_id).alias("id"), F.coalesce(F.hour(F.col(at).cast("timestamp_ntz")), F.lit(-1)).alias("hour"), each.alias("e"))
    return long.where("e.x IS NOT NULL").select(F.concat("e.measure", F.lit("|"), "s").alias("k"), F.pmod(F.xxhash64("id"), F.lit(spread)).alias("block"), "hour", "id", F.col("e.x").alias("x"))
