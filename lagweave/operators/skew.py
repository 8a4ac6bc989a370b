"""Joins of many rows with one row per group, safe when a few groups hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, row_id: str, hot: int = 1_000, least: int = 10_000, spread: int = 64) -> DataFrame:
    """Inner join on keys; groups has one row per key and the number of its rows in weight. Keys must not be NULL.

    The `hot` heaviest groups (at most that many rows are broadcast, whatever the data) are met in `spread` parts; any
    other group holds less than 1 in `hot` of all rows, or fewer than `least` rows. row_id spreads the rows.
    """
    top = F.broadcast(groups.where(F.col(weight) >= least).orderBy(F.col(weight).desc()).limit(hot).select(*keys, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(row_id), F.lit(spread)).cast("int")).otherwise(0)
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(top, keys, "left").withColumn("_part", part).drop("_hot")
    right = groups.join(top, keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_part"]).drop("_part")
