"""Exhaustive mining, level by level: the deterministic counterpart of the evolutionary search.

Level 1 holds the items moved by each delay. The candidates of level k are the rules of k conditions all of whose parts of k - 1
conditions have the least support; they come from joining level k - 1 with level 1 on t, attributes ascending, so every rule
appears once. Support is anti-monotone, as all levels share one range [max_delay, n - span), so no rule that has it is
missed. Matches of a time are bounded by frequent items, hence by instruments x delays, not by rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.quadrants import concentration, deviation_ok
from lagweave.params import MiningParams


def lagged(items: DataFrame, n: int, p: MiningParams) -> DataFrame:
    """attr, delay, t within the common range."""
    delays = F.explode(F.array(*(F.lit(d) for d in range(p.max_delay + 1))))
    return items.select("attr", "i", delays.alias("delay")).select("attr", "delay", (F.col("i") + F.col("delay")).alias("t")).where(F.col("t").between(p.max_delay, n - p.future_span - 1))


def _keys(parts: list[int], names: list[int] | None = None) -> list:
    """Columns a, d of the conditions numbered parts, called as those numbered names."""
    return [F.col(f"{c}{i}").alias(f"{c}{j}") for i, j in zip(parts, names or parts) for c in ("a", "d")]


def level(items: DataFrame, n: int, k: int, p: MiningParams) -> DataFrame:
    """Columns a1, d1, ..., ak, dk, t: the matches of all candidates of k conditions on different attributes."""
    least = p.min_support * (n - p.max_delay - p.future_span)

    def frequent(got: DataFrame, j: int) -> DataFrame:
        return got.groupBy(*_keys([*range(1, j + 1)])).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")

    got = one = lagged(items, n, p).select(F.col("attr").alias("a1"), F.col("delay").alias("d1"), "t")
    if k > 1:
        one = one.join(frequent(one, 1), ["a1", "d1"])
        got = one
    for j in range(2, k + 1):
        last = one.select(*_keys([1], [j]), "t")
        pairs = got.join(last, "t").where(F.col(f"a{j}") > F.col(f"a{j - 1}"))
        if j > 2:  # the parts that hold the new condition; the one without it is frequent already
            for out in range(1, j):
                kept = [i for i in range(1, j + 1) if i != out]
                pairs = pairs.join(part.select(*_keys([*range(1, j)], kept)), [f"{c}{i}" for i in kept for c in "ad"], "left_semi")
        got = pairs
        if j < k:
            part = frequent(got, j)
            got = got.join(part, [f"{c}{i}" for i in range(1, j + 1) for c in "ad"])
    return got


def rule_key(k: int):
    """Text of a rule from its columns."""
    return F.concat_ws(" & ", *(F.concat(f"a{i}", F.lit("(t-"), F.col(f"d{i}").cast("string"), F.lit(")")) for i in range(1, k + 1)))


def mined(items: DataFrame, series: DataFrame, n: int, k: int, p: MiningParams) -> DataFrame:
    """All candidates of k conditions per target of series, with statistics, concentration (convention b) and the first failed gate."""
    keys = [c for i in range(1, k + 1) for c in (f"a{i}", f"d{i}")]
    got = level(items, n, k, p).join(series.select("inst", F.col("i").alias("t"), "x1", "x2"), "t").where("x1 IS NOT NULL AND x2 IS NOT NULL")
    by = ["inst", *keys]
    stats = [f(f"x{h}").alias(f"x{h}_{name}") for h in (1, 2) for name, f in (("mean", F.avg), ("sigma", F.stddev_pop), ("min", F.min), ("max", F.max))]
    quads = concentration(got, by, "b")
    out = quads.join(got.groupBy(*by).agg(*stats), by)
    deepest = F.greatest(*(F.col(f"d{i}") for i in range(1, k + 1))) if k > 1 else F.col("d1")
    out = out.withColumn("max_d", deepest).withColumn("support_rate", F.col("n") / (n - p.max_delay - p.future_span))
    return with_gate(out.withColumn("rule", rule_key(k)), p)


def with_gate(rules: DataFrame, p: MiningParams) -> DataFrame:
    """Adds reject_reason: the first gate that fails in the order concentration, deviation, support; passed otherwise."""
    calm = deviation_ok(F.col("quadrant"), F.col("x1_min"), F.col("x1_max"), F.col("x2_min"), F.col("x2_max"), p.max_deviation)
    reason = F.when(F.col("concentration") < p.min_concentration, "concentration").when(~calm, "deviation").when(F.col("support_rate") < p.min_support, "support").otherwise("passed")
    high = F.col("support_rate") >= p.high_support_multiplier * p.min_support
    low = F.greatest("x1_sigma", "x2_sigma") <= p.low_variance_multiplier * p.max_sigma
    return rules.withColumn("reject_reason", reason).withColumn("high_support", high).withColumn("low_variance", low)


def with_strict_gate(rules: DataFrame, p: MiningParams, k: int, min_count: int = 5, min_mean: float = 0.07, min_conditions: int = 2) -> DataFrame:
    """Adds reject_reason by the alternative gate: support, conditions, count, strength of both means, deviation of both values."""
    weak = (F.abs("x1_mean") < min_mean) | (F.abs("x2_mean") < min_mean)
    reason = F.when(F.col("support_rate") < p.min_support, "support").when(F.lit(k < min_conditions), "conditions").when(F.col("n") < min_count, "count").when(weak, "mean")
    return rules.withColumn("reject_reason", reason.when(F.greatest("x1_sigma", "x2_sigma") > p.max_sigma, "sigma").otherwise("passed"))


def gate_report(rules: DataFrame) -> DataFrame:
    """Per target and reason: rules, percent, and whether it is the most frequent reason to reject (ties: first by name)."""
    got = rules.groupBy("inst", "reject_reason").agg(F.count(F.lit(1)).alias("rules"))
    total = got.groupBy("inst").agg(F.sum("rules").alias("total"), F.min(F.when(F.col("reject_reason") != "passed", F.struct(-F.col("rules"), "reject_reason"))).alias("top"))
    out = got.join(total, "inst")
    return out.select("inst", "reject_reason", "rules", (100 * F.col("rules") / F.col("total")).alias("percent"), F.coalesce(F.col("top.reject_reason") == F.col("reject_reason"), F.lit(False)).alias("bottleneck"))


def dedupe(rules: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first rule of each key."""
    return rules.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
