"""Writers of the text formats. Typed Parquet stays the primary output; these are for readers of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators.rules import write_rule


def write_wide(wide: DataFrame, path: str, by: str | None = None) -> None:
    """Mining tables as CSV, one folder per instrument."""
    w = wide.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def pool_text(rules: DataFrame, horizons: int = 2) -> DataFrame:
    """The pool's columns as formatted text: slots, statistics with three decimals, rates with four."""
    r = write_rule(rules)
    three = lambda c, name: F.format_string("%.3f", F.col(c)).alias(name)
    stats = [three(f"x{k}_{s}", f"X(t+{k})_{s}") for k in range(1, horizons + 1) for s in ("mean", "sigma", "min", "max")]
    return r.select(*(F.col(f"attr{i}").alias(f"Attr{i}") for i in range(1, 9)), *stats, F.col("support_count").cast("string").alias("support_count"), F.format_string("%.4f", F.col("support_rate")).alias("support_rate"), F.col("quadrant").alias("Quadrant"), three("concentration", "Concentration"), F.col("k").cast("string").alias("NumAttr"))


def write_pool(rules: DataFrame, path: str, horizons: int = 2) -> None:
    pool_text(rules, horizons).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_matches(verification: DataFrame, path: str) -> None:
    """Matches partitioned by rule, so that one rule is one folder."""
    verification.repartition("rule_id").write.mode("overwrite").partitionBy("rule_id").parquet(path)


def write_ranked(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_match_files(verification: DataFrame, path: str) -> None:
    """The same as text with a header, '-' where a future value is absent."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) if c.startswith("X(") else F.col(c) for c in verification.columns]
    verification.select(*cells).repartition("rule_id").write.mode("overwrite").partitionBy("rule_id").option("header", True).csv(path)


def pool_summary(rules: DataFrame, n: int = 10) -> DataFrame:
    """place, line: a line of totals (place 0), then the first n rules as lines of text."""
    top = rules.orderBy(F.desc("support_count"), "rule_id").limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("support_count"), "rule_id")))
    line = F.format_string("Rule %s: support %s (%.4f), concentration %.3f, %s", F.col("rule_id").cast("string"), F.col("support_count").cast("string"), F.col("support_rate"), F.col("concentration"), F.col("quadrant"))
    total = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("support_count"), F.lit(0)).alias("m"))
    head = total.select(F.lit(0).alias("place"), F.format_string("Rules: %s, greatest support %s", F.col("n").cast("string"), F.col("m").cast("string")).alias("line"))
    return head.unionByName(top.select("place", line.alias("line")))
