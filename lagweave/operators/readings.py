"""Readings: the valid, newest delivery of each source and instant.

The columns are those of the feed tables. A reading is a row whose time text names an instant and whose
value is not NULL (NaN and infinity count). Of several with one source and instant, the one with the latest
arrival, then the greatest id, is the reading; a NULL arrival or id is the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions.instants import with_instant_us
from lagweave.functions.keys import encode_key


def finite(c):
    """True for a number that is neither NULL, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def beside(which: str, col: str, by: list[str], order: str) -> Column:
    """The nearest value of col that is not NULL before (lag) or after (lead) the row; one pass, where a frame to the end would take a pass per row."""
    return F.expr(f"{which}({col}) IGNORE NULLS OVER (PARTITION BY {', '.join(by)} ORDER BY {order})")


def readings(df: DataFrame, ids: bool = False, bars: bool = False, source: str = "feed", time: str = "t", value: str = "x", arrived: str = "arrived_at", row_id: str = "row_id", bar: str = "bar_minutes") -> DataFrame:
    """Columns k (encoded source), us, x, with bars also bar, with ids also id; one row per reading.

    Deliveries of one source and instant meet in an aggregate with a map-side part, so a flood of them, whatever its size, leaves each input
    task as one row. With bars, a bar that is NULL or not positive takes the row out. Other columns are not read.
    """
    cols = [encode_key(F.col(source)).alias("k"), F.col(value).cast("double").alias("x"), F.col(arrived).cast("timestamp_ntz").alias("arrived"), F.col(row_id).alias("id"), F.col(time).alias("us_text")]
    rows = df.where(F.col(value).isNotNull())
    if bars:
        rows, cols = rows.where(F.col(bar) > 0), [*cols, F.col(bar).cast("long").alias("bar")]
    rows = with_instant_us(rows.select(*cols), "us_text", "us").drop("us_text")
    # NULL instants go by their value, NULL too: a filter on the key would sink below the aggregate and parse every text twice. In a struct NULL comes before any value.
    keys = ["k", *(["bar"] if bars else []), "us"]
    value_of = F.struct(F.when(F.col("us").isNotNull(), F.col("x")).alias("x"), *(["id"] if ids else []))
    got = rows.groupBy(*keys).agg(F.max_by(value_of, F.struct("arrived", "id")).alias("r"))
    return got.select(*keys, "r.*").where("x IS NOT NULL")
