"""Queries of series preparation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.operators import prep
from lagweave.operators.panels import EVENTS_SQL, PANEL_SQL, event_prices, event_returns, order_prices, order_returns

KEY = ["inst", "i", "ts"]


def prep_grid_ffill(spark, d):
    return prep.forward_fill(prep.dense_grid(order_prices(spark, d)))


def prep_ffill_bfill(spark, d):
    return prep.fill_both_ways(prep.dense_grid(event_prices(spark, d))).select(*KEY, F.round("price", 6).alias("price"))


def prep_returns(spark, d):
    return order_returns(spark, d).select(*KEY, F.round("x", 6).alias("x"), F.bround("x", 2).alias("x_two"))


def prep_discretize(spark, d):
    return prep.discretize(order_returns(spark, d)).select(*KEY, "Up", "Stay", "Down")


def prep_discretize_theta(spark, d):
    return prep.discretize(event_returns(spark, d), 5.0).select(*KEY, "Up", "Stay", "Down")


def prep_zscore(spark, d):
    return prep.z_score(order_returns(spark, d)).select(*KEY, F.round("z", 6).alias("z"))


def prep_rolling_z(spark, d):
    return prep.rolling_z(order_returns(spark, d)).select(*KEY, F.round("z", 5).alias("z"))


def prep_rank_norm(spark, d):
    return prep.rank_scale(order_returns(spark, d)).select(*KEY, F.round("z", 6).alias("z"))


def prep_items(spark, d):
    return prep.items(order_returns(spark, d))


def prep_extreme_split(spark, d):
    got = prep.extremes(order_returns(spark, d), 1.0)
    return got.groupBy("inst", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 5).alias("mean_x"), F.round(F.min("x"), 5).alias("min_x"), F.round(F.max("x"), 5).alias("max_x"))


def dataset_stats(spark, d):
    x = F.col("x")
    return order_returns(spark, d).groupBy("inst").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(x > 0).alias("n_positive"), F.count_if(x < 0).alias("n_negative"), F.count_if(x == 0).alias("n_zero"))


def availability_check(spark, d):
    got = order_prices(spark, d).groupBy("inst").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("price").alias("n"))
    return got.where("n >= 100")


def prep_wide(spark, d):
    """The mining table of one target: own attributes first, then the others, X, T."""
    got = prep.discretize(order_returns(spark, d))
    insts = prep.instruments(order_prices(spark, d))
    kinds = [F.max(k).alias(k) for k in prep.ITEM_KINDS]
    wide = got.groupBy("i", "ts").pivot("inst", insts).agg(*kinds, F.max("x").alias("X"))
    target = insts[0]
    attrs = [F.col(f"`{a}_{k}`") for a in insts for k in prep.ITEM_KINDS]
    return wide.where("i >= 1").select((F.col("i") - 1).alias("i"), *attrs, F.bround(F.col(f"`{target}_X`"), 2).alias("X"), F.date_format("ts", "yyyy-MM-dd").alias("T"))


QUERIES = {f.__name__: f for f in (prep_grid_ffill, prep_ffill_bfill, prep_returns, prep_discretize, prep_discretize_theta, prep_zscore, prep_rolling_z, prep_rank_norm, prep_items, prep_extreme_split, dataset_stats, availability_check, prep_wide)}

_FLAGS = "({0})::INT AS Up, ({1})::INT AS Stay, ({2})::INT AS Down"
_MOVES = _FLAGS.format("coalesce(x IS NOT NULL AND price > prev, false)", "coalesce(x IS NOT NULL AND price = prev, false)", "coalesce(x IS NOT NULL AND price < prev, false)")
_INSTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

ORACLE = {
    "prep_grid_ffill": PANEL_SQL + "SELECT * FROM filled",
    "prep_ffill_bfill": EVENTS_SQL + "SELECT inst, i, ts, round(coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY inst ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(price IGNORE NULLS) OVER (PARTITION BY inst ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS price FROM grid",
    "prep_returns": PANEL_SQL + "SELECT inst, i, ts, round(x, 6) AS x, round_even(x, 2) AS x_two FROM rets",
    "prep_discretize": PANEL_SQL + f"SELECT inst, i, ts, {_MOVES} FROM rets",
    "prep_discretize_theta": EVENTS_SQL + "SELECT inst, i, ts, " + _FLAGS.format("coalesce(x > 5, false)", "coalesce(x BETWEEN -5 AND 5, false)", "coalesce(x < -5, false)") + " FROM rets",
    "prep_zscore": PANEL_SQL + "SELECT inst, i, ts, round((x - avg(x) OVER (PARTITION BY inst)) / coalesce(nullif(stddev_samp(x) OVER (PARTITION BY inst), 0), 1), 6) AS z FROM rets",
    "prep_rolling_z": PANEL_SQL + "SELECT inst, i, ts, round(coalesce((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 0), 5) AS z FROM rets WINDOW w AS (PARTITION BY inst ORDER BY i ROWS 19 PRECEDING)",
    "prep_rank_norm": PANEL_SQL
    + """SELECT inst, i, ts, CASE WHEN x IS NOT NULL THEN round(((rank() OVER (PARTITION BY inst, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY inst, x) - 1) / 2)
  / count(*) OVER (PARTITION BY inst, x IS NULL) - 0.5) * 2, 6) END AS z FROM rets""",
    "prep_items": PANEL_SQL + "SELECT * FROM items",
    "prep_extreme_split": PANEL_SQL + "SELECT inst, CASE WHEN x >= 1 THEN 'positive' ELSE 'negative' END AS side, count(*) AS n, round(avg(x), 5) AS mean_x, round(min(x), 5) AS min_x, round(max(x), 5) AS max_x FROM rets WHERE abs(x) >= 1 GROUP BY ALL",
    "dataset_stats": PANEL_SQL + "SELECT inst, count(*) AS n_rows, count(*) FILTER (x > 0) AS n_positive, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x = 0) AS n_zero FROM rets GROUP BY inst",
    "availability_check": PANEL_SQL + "SELECT inst, min(ts) AS first_ts, max(ts) AS last_ts, count(price) AS n FROM prices GROUP BY inst HAVING count(price) >= 100",
    "prep_wide": PANEL_SQL
    + f", f AS (SELECT inst, i, ts, x, {_MOVES} FROM rets) SELECT i - 1 AS i, "
    + ", ".join(f"max({k}) FILTER (inst = '{a}') AS \"{a}_{k}\"" for a in _INSTS for k in prep.ITEM_KINDS)
    + ", round_even(max(x) FILTER (inst = '1-URGENT'), 2) AS X, strftime(ts, '%Y-%m-%d') AS T FROM f WHERE i >= 1 GROUP BY i, ts",
}
