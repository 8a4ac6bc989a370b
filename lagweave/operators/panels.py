"""Price panels of the star schema, for the rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators.prep import dense_grid, forward_fill, with_returns
from lagweave.session import table


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily: total price of the orders of each priority. Sums are decimal, so that equal prices are equal whatever the order."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL")
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return o.groupBy(F.col("o_orderpriority").alias("inst"), F.col("o_orderdate").alias("ts")).agg(price.alias("price"))


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars: mean value of the events of each type."""
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL AND ts IS NOT NULL")
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return e.groupBy(F.col("event_type").alias("inst"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg((total / F.count("value")).alias("price"))


def order_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_returns(forward_fill(dense_grid(order_prices(spark, sf_dir))))


def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_returns(forward_fill(dense_grid(event_prices(spark, sf_dir))))


PANEL_SQL = """
WITH prices AS (
  SELECT o_orderpriority AS inst, o_orderdate AS ts, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS price
  FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL),
times AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM prices)),
grid AS (
  SELECT a.inst, t.i, t.ts, p.price FROM (SELECT DISTINCT inst FROM prices) a CROSS JOIN times t LEFT JOIN prices p USING (inst, ts)),
filled AS (SELECT inst, i, ts, last_value(price IGNORE NULLS) OVER (PARTITION BY inst ORDER BY i ROWS UNBOUNDED PRECEDING) AS price FROM grid),
prevs AS (SELECT *, lag(price) OVER (PARTITION BY inst ORDER BY i) AS prev FROM filled),
rets AS (SELECT *, 100 * (price / nullif(prev, 0) - 1) AS x FROM prevs),
items AS (
  SELECT i, inst || CASE WHEN price > prev THEN '_Up' WHEN price = prev THEN '_Stay' ELSE '_Down' END AS attr FROM rets WHERE x IS NOT NULL),
series AS (
  SELECT inst, i, ts, count(*) OVER (PARTITION BY inst) AS n, x AS x0,
         lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM rets WINDOW w AS (PARTITION BY inst ORDER BY i))
"""

EVENTS_SQL = PANEL_SQL.replace(
    """SELECT o_orderpriority AS inst, o_orderdate AS ts, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS price
  FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL""",
    """SELECT event_type AS inst, date_trunc('hour', ts) AS ts, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE / count(value) AS price
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""",
)
