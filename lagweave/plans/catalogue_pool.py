"""Queries over the rule pool and the experiment runs: scores, rankings, summaries, sweeps, and their SQL."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagweave.functions import scores as sc
from lagweave.functions.quadrants import deviation_ok
from lagweave.operators import matching as mt
from lagweave.operators.profiles import correlation
from lagweave.operators.quantiles import quantiles
from lagweave.operators.readings import finite
from lagweave.operators.rules import attribute_summary, condition_key, parse_rules
from lagweave.plans.catalogue_rules import _M1, _SET, PARAMS, _level_sql, _matches, _mined, _normal_sql, _rounded
from lagweave.session import table


def _c(name):
    return F.col(name)


def pool(spark, d):
    """The rule pool with its instrument, numbers that are not finite as NULL."""
    p = table(spark, d, "zrp01a")
    doubles = [n for n, t in p.dtypes if t == "double"]
    clean = {n: F.when(finite(F.col(n)), F.col(n)) for n in doubles}
    return p.withColumns(clean).withColumn("symbol", F.upper(F.split_part("pool_id", F.lit("_"), F.lit(1))))


def _means():
    return _c("x_mean"), _c("x2_mean"), _c("x_sigma"), _c("x2_sigma")


def with_scores(p):
    m1, m2, s1, s2 = _means()
    return p.withColumns({"score_2d": sc.score_2d(_c("support_rate"), m1, m2, s1, s2, _c("concentration")), "score_t1": sc.score_one(_c("support_rate"), m1, s1), "score_t2": sc.score_one(_c("support_rate"), m2, s2)})


def score_2d(spark, d):
    return with_scores(pool(spark, d)).select("rule_id", "score_2d", "score_t1", "score_t2")


def score_cluster_quality(spark, d):
    m1, m2, s1, s2 = _means()
    q = sc.cluster_quality(m1, m2, s1, s2, _c("support_count"))
    return pool(spark, d).select("rule_id", *(c.alias(n) for n, c in q.items()))


def _deviation():
    return (F.greatest(F.abs("x_min"), F.abs("x_max")) + F.greatest(F.abs("x2_min"), F.abs("x2_max"))) / 2


def score_rule(spark, d):
    m1, m2, s1, s2 = _means()
    conc = sc.estimated_concentration(s1, s2)
    got = pool(spark, d).select("rule_id", sc.mean_quadrant(m1, m2).alias("mean_quadrant"), conc.alias("estimate"), _deviation().alias("deviation"), sc.rule_score(_c("support_rate"), conc, _deviation()).alias("score"))
    return _rounded(got, 8)


def score_views(spark, d):
    """The pool under its thresholds: support at least, deviation at most; best 100 of each by score."""
    m1, m2, s1, s2 = _means()
    score = sc.rule_score(_c("support_rate"), sc.estimated_concentration(s1, s2), _deviation())
    p = pool(spark, d).select("rule_id", "support_rate", _deviation().alias("deviation"), score.alias("score")).where("score IS NOT NULL")
    views = [("support", p.where("support_rate >= 0.005")), ("deviation", p.where("deviation <= 5.0"))]
    tops = [v.orderBy(F.col("score").desc(), "rule_id").limit(100).select(F.lit(n).alias("view"), "rule_id", F.round("score", 8).alias("score")) for n, v in views]
    return tops[0].unionByName(tops[1])


def score_composite(spark, d):
    t, n = _c("t_statistic"), _c("support_count")
    chi = sc.chi_bonus(_c("support_rate"), n, t * t)
    got = pool(spark, d).select("rule_id", sc.composite(t, n).alias("composite"), sc.expected_value(_c("x_mean"), n, t).alias("expected_value"), sc.quality(_c("x_mean"), _c("x_sigma")).alias("quality"), chi.alias("chi_score"))
    return _rounded(got, 6)


def score_isotropic(spark, d):
    s = [_c("x_sigma"), _c("x2_sigma")]
    return _rounded(pool(spark, d).select("rule_id", sc.isotropic(_c("support_count"), s).alias("isotropic"), sc.product_score(_c("support_rate"), s).alias("product_score")), 6)


def score_normalized(spark, d):
    """Logarithm of the support over the min-max normalized deviations; the extremes are one row, met by a constant key."""
    p = pool(spark, d).withColumn("one", F.lit(1))
    e = p.groupBy("one").agg(*(f(c).alias(f"{n}_{c}") for c in ("x_sigma", "x2_sigma") for n, f in (("lo", F.min), ("hi", F.max))))
    got = p.join(F.broadcast(e), "one")
    norm = lambda c: F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    return _rounded(got.select("rule_id", (F.log1p("support_count") / (norm("x_sigma") + norm("x2_sigma") + 0.01)).alias("score")), 6)


def global_top_rules(spark, d):
    """The ten best rules by each of three scores, and how many conditions they have, however written."""
    p = with_scores(pool(spark, d))
    kinds = ("score_2d", "score_t1", "score_t2")
    tops = []
    for k in kinds:
        best = p.where(F.col(k).isNotNull()).orderBy(F.col(k).desc(), "rule_id").limit(10)
        tops.append(best.select(F.lit(k).alias("kind"), "rule_id", "pool_id", *(f"attr{i}" for i in range(1, 9)), F.col(k).alias("score")))
    got = tops[0].unionByName(tops[1]).unionByName(tops[2])
    parsed = parse_rules(got.select("rule_id", *(f"attr{i}" for i in range(1, 9))).dropDuplicates(["rule_id"]), [f"attr{i}" for i in range(1, 9)], any_writing=True)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "rule_id"))
    return got.join(parsed, "rule_id").select("kind", rank.alias("place"), "rule_id", "pool_id", F.size("conds").alias("conditions"), F.round("score", 8).alias("score"))


def conditions_summary(spark, d):
    p = parse_rules(table(spark, d, "zrp01a"), [f"attr{i}" for i in range(1, 9)], stop_at_gap=True, any_writing=True)
    return p.select("rule_id", "k", attribute_summary(F.col("conds")).alias("summary"))


def instrument_summary(spark, d):
    m1, m2, s1, s2 = _means()
    big = F.greatest(F.abs(m1), F.abs(m2))
    got = pool(spark, d).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rules"), F.avg("support_count").alias("mean_support"), F.max("support_count").alias("max_support"), F.min("support_count").alias("min_support"),
        F.avg(F.abs(m1)).alias("mean_abs_m1"), F.avg(F.abs(m2)).alias("mean_abs_m2"), F.max(F.abs(m1)).alias("max_abs_m1"), F.max(F.abs(m2)).alias("max_abs_m2"),
        F.avg(s1).alias("mean_s1"), F.avg(s2).alias("mean_s2"), F.min(s1).alias("min_s1"), F.min(s2).alias("min_s2"), F.avg("concentration").alias("mean_concentration"),
        F.count_if(big >= 0.5).alias("n_strong"), F.count_if((s1 < 0.3) & (s2 < 0.3)).alias("n_calm"), F.count_if(F.col("support_count") >= 50).alias("n_supported"),
    )
    all_rows = Window.partitionBy(F.lit(1))
    ratio = lambda c: F.try_divide(F.col(c), F.max(c).over(all_rows))
    composite = (ratio("n_rules") * 0.2 + ratio("mean_support") * 0.3 + ratio("n_strong") * 0.2 + ratio("n_calm") * 0.3) * 100
    place = lambda *o: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*o, "symbol"))
    got = got.select("*", composite.alias("composite"), place(F.desc("n_rules")).alias("by_rules"), place(F.desc("max_abs_m1")).alias("by_mean"), place("min_s1").alias("by_sigma"), place(F.desc("max_support")).alias("by_support"))
    return _rounded(got, 6)


def top3_by_instrument(spark, d):
    p = pool(spark, d).where("concentration IS NOT NULL").select("symbol", "rule_id", "concentration", "support_count")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("concentration"), "rule_id"))
    return p.withColumn("place", rank).where("place <= 3")


def top_comparison(spark, d):
    """The ten rules with most support beside each other: ratio to the greatest, and min-max normalized strength."""
    p = pool(spark, d).where("x_mean IS NOT NULL AND x_sigma > 0").orderBy(F.desc("support_count"), "rule_id").limit(10)
    w = Window.partitionBy(F.lit(1))
    sharpe = F.col("x_mean") / (F.col("x_sigma") + 1e-6)
    p = p.withColumn("sharpe", sharpe)
    out = p.select("rule_id", "support_count", "sharpe", (F.col("support_count") / F.max("support_count").over(w)).alias("support_ratio"), F.try_divide(F.col("sharpe") - F.min("sharpe").over(w), F.max("sharpe").over(w) - F.min("sharpe").over(w)).alias("sharpe_scaled"))
    return _rounded(out, 6)


def head_then_filter(spark, d):
    """The first rules of the pool, and of these the concentrated ones: the order of the two steps matters."""
    return pool(spark, d).orderBy("rule_id").limit(500).where("concentration >= 0.40").select("rule_id", "concentration")


def derived_ratios(spark, d):
    """Sharpe ratios, the second value's excess over the first, the ratio of deviations, and a score against the widest deviation of the pool, 1.5 times the greatest local one."""
    m1, m2, s1, s2 = _means()
    p = pool(spark, d).withColumn("one", F.lit(1))
    widest = p.groupBy("one").agg((1.5 * F.max("x_sigma")).alias("assumed"))
    got = p.join(F.broadcast(widest), "one")
    sharpe = m1 / (s1 + 1e-6)
    return got.select("rule_id", sharpe.alias("sharpe1"), (m2 / (s2 + 1e-6)).alias("sharpe2"), ((m2 - m1) / (s2 + 1e-6)).alias("information"), (m2 - m1).alias("excess"), F.try_divide(s2, s1).alias("volatility_ratio"), (sharpe * F.log1p("support_count")).alias("risk_adjusted"), (1 - s1 / F.col("assumed")).alias("reduction"))


def instrument_top10(spark, d):
    """The ten rules with most support of each instrument."""
    p = pool(spark, d).select("symbol", "rule_id", "support_count", "support_rate", "x_mean", "x_sigma").where("support_count IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("support_count"), "rule_id"))
    return p.withColumn("place", rank).where("place <= 10")


FEATURES = ["x_mean", "x_sigma", "x2_mean", "x2_sigma", "support_rate", "concentration", "t_statistic"]


def _long(p):
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in FEATURES)))
    return p.select("symbol", "rule_id", each.alias("e")).select("symbol", "rule_id", "e.feature", "e.v").where("v IS NOT NULL")


def outliers_z3(spark, d):
    long = _long(pool(spark, d))
    s = long.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("v").alias("n"))
    got = long.join(F.broadcast(s), "feature").groupBy("feature", "m", "s", "n").agg(F.count_if(F.abs(F.col("v") - F.col("m")) > 3 * F.col("s")).alias("outliers"))
    return _rounded(got.withColumn("percent", 100 * F.col("outliers") / F.col("n")), 9)


def pool_percentiles(spark, d):
    return _rounded(quantiles(_long(pool(spark, d)), ["feature"], "v", [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]), 6)


def pool_describe(spark, d):
    got = _long(pool(spark, d)).groupBy("symbol", "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))
    return _rounded(got, 6)


def pool_correlations(spark, d):
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
    wide = pool(spark, d).agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs)))
    return _rounded(wide.select(each.alias("e")).select("e.*"), 6)


def significance_bins(spark, d):
    """Right-closed bins of |t|, 0 left out, and the share of significant rules by support."""
    t = F.abs("t_statistic")
    edges = [0, 1, 1.96, 2, 2.58, 3]
    label = F.when(t <= 0, None)
    for a, b in zip(edges, edges[1:]):
        label = label.when(t <= b, f"({a}, {b}]")
    label = label.otherwise("(3, inf]")
    n = F.col("support_count")
    support = F.when(n <= 0, None)
    for a, b in zip((0, 50, 100, 200, 500), (50, 100, 200, 500, 1000)):
        support = support.when(n <= b, f"({a}, {b}]")
    support = support.otherwise("(1000, inf]")
    got = pool(spark, d).where("t_statistic IS NOT NULL").select(label.alias("t_bin"), support.alias("support_bin"), (t > 1.96).cast("int").alias("sig"))
    return _rounded(got.where("t_bin IS NOT NULL AND support_bin IS NOT NULL").groupBy("t_bin", "support_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("sig").alias("significant_share")), 6)


def snr_confidence(spark, d):
    """Per instrument: ratio of mean to deviation, rules under the lower quartile of deviation, and directions."""
    p = pool(spark, d).where("x_sigma IS NOT NULL")
    q = quantiles(p, ["symbol"], "x_sigma", [0.25]).select("symbol", F.col("value").alias("q25"))
    snr = F.try_divide(F.abs("x_mean"), F.col("x_sigma"))
    got = p.join(q, "symbol").groupBy("symbol").agg(F.avg(snr).alias("mean_snr"), F.max(snr).alias("max_snr"), F.count_if(F.col("x_sigma") <= F.col("q25")).alias("confident"), F.count_if(F.col("x_mean") > 0).alias("n_up"), F.count_if(F.col("x_mean") < 0).alias("n_down"))
    return _rounded(got, 6)


def distribution_bands(spark, d):
    m1, m2, s1, s2 = _means()
    wide, strong, n = (s1 + s2) / 2, sc.mean_strength(m1, m2), F.col("support_count")
    return pool(spark, d).groupBy("symbol").agg(
        F.count_if(wide <= 0.35).alias("tight"), F.count_if((wide > 0.35) & (wide <= 0.45)).alias("medium"), F.count_if(wide > 0.45).alias("wide"),
        F.count_if(strong >= 0.3).alias("strong"), F.count_if((strong >= 0.2) & (strong < 0.3)).alias("fair"), F.count_if(strong < 0.2).alias("weak"),
        F.count_if(n == 10).alias("support_10"), F.count_if(n.between(11, 15)).alias("support_11_15"), F.count_if(n >= 16).alias("support_16"),
        *(F.count_if(F.col("numattr") == k).alias(f"conditions_{k}") for k in range(3, 7)),
        F.count_if(m1 > 0).alias("m1_up"), F.count_if(m1 < 0).alias("m1_down"), F.count_if(m2 > 0).alias("m2_up"), F.count_if(m2 < 0).alias("m2_down"),
    )


def insight_counts(spark, d):
    m1, m2, s1, s2 = _means()
    q = sc.cluster_quality(m1, m2, s1, s2, F.col("support_count"))["quality"]
    strong, wide = sc.mean_strength(m1, m2), (s1 + s2) / 2
    got = pool(spark, d).withColumn("q", q).groupBy("symbol").agg(
        F.count_if(F.col("q") >= 80).alias("grade_a"), F.count_if((F.col("q") >= 65) & (F.col("q") < 80)).alias("grade_b"), F.count_if((m1 > 0) == (m2 > 0)).alias("same_sign"), F.count_if((m1 > 0) != (m2 > 0)).alias("opposite_sign"),
        F.count_if(strong < 0.25).alias("near_threshold"), F.count_if(wide > 0.40).alias("high_variance"), F.avg("q").alias("mean_quality"),
    )
    return _rounded(got, 6)


def dedupe_first_three(spark, d):
    """One rule per first three conditions: the best by score, then the first."""
    p = with_scores(pool(spark, d)).where("score_2d IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("attr1", "attr2", "attr3").orderBy(F.desc("score_2d"), "rule_id"))
    return p.withColumn("rn", rank).where("rn = 1").select("rule_id", "score_2d")


def dedupe_across_trials(spark, d):
    """One rule per instrument and set of conditions, however written, delays counting: the one mined first."""
    p = pool(spark, d).withColumn("key", condition_key([f"attr{i}" for i in range(1, 9)]))
    first = p.groupBy("symbol", "key").agg(F.min(F.struct("mined_at", "rule_id")).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select(F.col("f.rule_id").alias("rule_id"), "symbol", "n")


def directional_bias(spark, d):
    """Rules of the match queries by bias, from their win rate and profit factor."""
    m = _matches(spark, d)
    s = m.groupBy("inst", "rule_id").agg(F.avg("x1").alias("m"), F.stddev_samp("x1").alias("s"))
    got = mt.directional_stats(m).join(s, ["inst", "rule_id"])
    return got.select("inst", "rule_id", sc.directional_bias(F.col("m"), F.col("s"), F.col("win_rate"), F.col("profit_factor")).alias("bias"))


def rule_sort_views(spark, d):
    """The reader's sort options, 20 rules each."""
    p = pool(spark, d)
    by = {"support": F.col("support_count").cast("double"), "strength": F.abs("x_mean"), "snr": F.try_divide(F.abs("x_mean"), F.col("x_sigma")), "t": F.abs("t_statistic"), "composite": sc.composite(F.col("t_statistic"), F.col("support_count")), "discovery": -F.col("rule_id").cast("double")}
    out = None
    for n, c in by.items():
        top = p.select("rule_id", c.alias("v")).where("v IS NOT NULL").orderBy(F.desc("v"), "rule_id").limit(20).select(F.lit(n).alias("sort_by"), "rule_id")
        out = top if out is None else out.unionByName(top)
    return out


PARAMETERS = ["max_time_delay", "minsup", "min_concentration", "max_deviation"]


def sweep_summary(spark, d):
    """Rules found by each value of each parameter, in one pass over grouping sets."""
    t = table(spark, d, "experiment_runs").select(*PARAMETERS, "rules_discovered")
    got = t.groupingSets([[p] for p in PARAMETERS], *PARAMETERS).agg(F.avg("rules_discovered").alias("mean"), F.stddev_samp("rules_discovered").alias("sd"), F.min("rules_discovered").alias("least"), F.max("rules_discovered").alias("most"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    top = 1 << len(PARAMETERS)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, p in enumerate(PARAMETERS):
        own = F.col("g") == top - 1 - (1 << (len(PARAMETERS) - 1 - i))
        name, value = F.when(own, p).otherwise(name), F.when(own, F.col(p).cast("double")).otherwise(value)
    return _rounded(got.select(name.alias("parameter"), value.alias("value"), "mean", "sd", "least", "most", "n"), 6)


def sweep_pivot(spark, d):
    """Mean rules by both parameters of a pair, one row per cell: delay by support, concentration by deviation. Long, so that any value has its place."""
    t = table(spark, d, "experiment_runs")
    cells = [("max_time_delay", "minsup"), ("min_concentration", "max_deviation")]
    got = [t.groupBy(F.lit(f"{a} x {b}").alias("pivot"), F.col(a).cast("double").alias("row"), F.col(b).alias("col")).agg(F.avg("rules_discovered").alias("mean")) for a, b in cells]
    return _rounded(got[0].unionByName(got[1]), 6)


def sweep_best(spark, d):
    """Ten runs with most and ten with fewest rules, and the run with most rules of each instrument (ties: the first by setting)."""
    t = table(spark, d, "experiment_runs").where("rules_discovered IS NOT NULL").dropDuplicates()
    keys = ["experiment", "max_time_delay", "minsup", "min_concentration", "max_deviation"]
    top = t.orderBy(F.desc("rules_discovered"), *keys).limit(10).select(F.lit("most").alias("side"), *keys, "rules_discovered")
    low = t.orderBy("rules_discovered", *keys).limit(10).select(F.lit("fewest").alias("side"), *keys, "rules_discovered")
    best = t.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("rules_discovered"), *keys))).where("rn = 1").select(F.concat(F.lit("best of "), "symbol").alias("side"), *keys, "rules_discovered")
    return top.unionByName(low).unionByName(best)


def experiment_totals(spark, d):
    t = table(spark, d, "experiment_runs")
    got = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"), F.sum("rules_discovered").alias("rules"), F.count_if(F.col("exit_code") != 0).alias("failed"), F.sum("duration_sec").alias("seconds"), F.max("rules_discovered").alias("best"))
    return got


SWEEP = {"max_delay": (3, 4, 5), "min_support": (0.02, 0.03, 0.05), "min_concentration": (0.30, 0.40, 0.45), "max_deviation": (1_000.0, 5_000.0, 20_000.0)}


def sweep_from_matches(spark, d):
    """81 parameter settings per target: rules that pass each. One mining for each greatest delay, which sets range and denominator, at the least
    support of all settings; the other settings filter its rules, instead of 81 runs.
    """
    cells = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(list(SWEEP)[1:], g))) for g in product(*list(SWEEP.values())[1:]))))
    out = None
    for delay in SWEEP["max_delay"]:
        rules = _mined(spark, d, 2, replace(PARAMS, max_delay=delay, min_support=min(SWEEP["min_support"])))
        each = rules.select("*", cells.alias("g")).select("*", "g.*")
        calm = deviation_ok(F.col("quadrant"), F.col("x1_min"), F.col("x1_max"), F.col("x2_min"), F.col("x2_max"), F.col("max_deviation"))
        ok = (F.col("support_rate") >= F.col("min_support")) & (F.col("concentration") >= F.col("min_concentration")) & calm
        got = each.groupBy("inst", F.lit(delay).alias("max_delay"), *list(SWEEP)[1:]).agg(F.count_if(ok).alias("rules"))
        out = got if out is None else out.unionByName(got)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        score_2d, score_cluster_quality, score_rule, score_views, score_composite, score_isotropic, score_normalized, global_top_rules, conditions_summary, instrument_summary, top3_by_instrument, top_comparison, head_then_filter, derived_ratios, instrument_top10,
        outliers_z3, pool_percentiles, pool_describe, pool_correlations, significance_bins, snr_confidence, distribution_bands, insight_counts, dedupe_first_three, dedupe_across_trials, directional_bias, rule_sort_views,
        sweep_summary, sweep_pivot, sweep_best, experiment_totals, sweep_from_matches,
    )
}

_DOUBLES = ["x_mean", "x_sigma", "x_min", "x_max", "x2_mean", "x2_sigma", "x2_min", "x2_max", "support_rate", "concentration", "t_statistic"]
_P = f"""
WITH pool AS (SELECT * REPLACE ({", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in _DOUBLES)}), upper(split_part(pool_id, '_', 1)) AS symbol FROM zrp01a)
"""
_SCORED = _P + """, scored AS (SELECT *, CASE WHEN (x_sigma + x2_sigma) / 2 > 0 THEN support_rate * ((abs(x_mean) + abs(x2_mean)) / 2) * concentration / ((x_sigma + x2_sigma) / 2) ELSE 0 END AS score_2d,
  CASE WHEN x_sigma > 0 THEN support_rate * abs(x_mean) / x_sigma ELSE 0 END AS score_t1, CASE WHEN x2_sigma > 0 THEN support_rate * abs(x2_mean) / x2_sigma ELSE 0 END AS score_t2 FROM pool)
"""
_DEV = "(greatest(abs(x_min), abs(x_max)) + greatest(abs(x2_min), abs(x2_max))) / 2"
_EST = "CASE WHEN (x_sigma + x2_sigma) / 2 < 0.01 THEN 0.9 ELSE 1 / (1 + 2 * ((x_sigma + x2_sigma) / 2)) END"
_QUALITY = """, parts AS (SELECT *, CASE WHEN (x_sigma + x2_sigma) / 2 <= 0.30 THEN 40 WHEN (x_sigma + x2_sigma) / 2 <= 0.35 THEN 35 WHEN (x_sigma + x2_sigma) / 2 <= 0.40 THEN 25 ELSE 10 END AS tightness,
  CASE WHEN (abs(x_mean) + abs(x2_mean)) / 2 >= 0.35 THEN 40 WHEN (abs(x_mean) + abs(x2_mean)) / 2 >= 0.30 THEN 35 WHEN (abs(x_mean) + abs(x2_mean)) / 2 >= 0.25 THEN 25 WHEN (abs(x_mean) + abs(x2_mean)) / 2 >= 0.20 THEN 15 ELSE 5 END AS direction,
  CASE WHEN support_count >= 15 THEN 20 WHEN support_count >= 12 THEN 15 WHEN support_count >= 10 THEN 10 ELSE 5 END AS reliability FROM pool)
"""
_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT symbol, rule_id, '{f}' AS feature, {f} AS v FROM pool WHERE {f} IS NOT NULL" for f in FEATURES) + ")"
_SORTS = {"support": "support_count::DOUBLE", "strength": "abs(x_mean)", "snr": "abs(x_mean) / nullif(x_sigma, 0)", "t": "abs(t_statistic)", "composite": "abs(t_statistic) * ln(1 + support_count)", "discovery": "-rule_id::DOUBLE"}
_KEYS = "experiment, max_time_delay, minsup, min_concentration, max_deviation"
_CALM = "CASE quadrant WHEN 'Q1' THEN x1_min >= -{0} AND x2_min >= -{0} WHEN 'Q2' THEN x1_max <= {0} AND x2_min >= -{0} WHEN 'Q3' THEN x1_max <= {0} AND x2_max <= {0} WHEN 'Q4' THEN x1_min >= -{0} AND x2_max <= {0} ELSE false END".format("max_deviation")


def _band(c, edges, tail):
    return "CASE WHEN " + c + " <= 0 THEN NULL " + " ".join(f"WHEN {c} <= {b} THEN '({a}, {b}]'" for a, b in zip(edges, edges[1:])) + f" ELSE '({tail}, inf]' END"


ORACLE = {
    "score_2d": _SCORED + "SELECT rule_id, score_2d, score_t1, score_t2 FROM scored",
    "score_cluster_quality": _P + _QUALITY + "SELECT rule_id, tightness, direction, reliability, tightness + direction + reliability AS quality FROM parts",
    "score_rule": _P + f"""SELECT rule_id, CASE WHEN x_mean >= 0 AND x2_mean >= 0 THEN 'Q1(++)' WHEN x_mean >= 0 THEN 'Q4(+-)' WHEN x2_mean >= 0 THEN 'Q2(-+)' ELSE 'Q3(--)' END AS mean_quadrant, round({_EST}, 8) AS estimate, round({_DEV}, 8) AS deviation,
  round(support_rate * ({_EST}) / greatest({_DEV}, 0.1), 8) AS score FROM pool""",
    "score_views": _P + f""", s AS (SELECT rule_id, support_rate, {_DEV} AS deviation, support_rate * ({_EST}) / greatest({_DEV}, 0.1) AS score FROM pool)
(SELECT 'support' AS view, rule_id, round(score, 8) AS score FROM s WHERE score IS NOT NULL AND support_rate >= 0.005 ORDER BY s.score DESC, rule_id LIMIT 100)
UNION ALL (SELECT 'deviation', rule_id, round(score, 8) FROM s WHERE score IS NOT NULL AND deviation <= 5.0 ORDER BY s.score DESC, rule_id LIMIT 100)""",
    "score_composite": _P + """SELECT rule_id, round(abs(t_statistic) * ln(1 + support_count), 6) AS composite, round(abs(x_mean) * support_count * CASE WHEN t_statistic IS NULL THEN 1 ELSE least(abs(t_statistic) / 2, 1) END, 6) AS expected_value, round(abs(x_mean) / nullif(x_sigma, 0), 6) AS quality,
  round(support_rate * support_count * (1 + t_statistic * t_statistic / 10), 6) AS chi_score FROM pool""",
    "score_isotropic": _P + """, v AS (SELECT *, (x_sigma + x2_sigma) / 2 AS m FROM pool) SELECT rule_id, round(CASE WHEN m > 1e-10 THEN support_count / (m * (1 + ((x_sigma - m) * (x_sigma - m) + (x2_sigma - m) * (x2_sigma - m)) / 2)) ELSE 0 END, 6) AS isotropic,
  round(CASE WHEN x_sigma * x2_sigma > 1e-10 THEN support_rate / (x_sigma * x2_sigma) ELSE 0 END, 6) AS product_score FROM v""",
    "score_normalized": _P + "SELECT rule_id, round(ln(1 + support_count) / ((x_sigma - min(x_sigma) OVER ()) / (max(x_sigma) OVER () - min(x_sigma) OVER ()) + (x2_sigma - min(x2_sigma) OVER ()) / (max(x2_sigma) OVER () - min(x2_sigma) OVER ()) + 0.01), 6) AS score FROM pool",
    "global_top_rules": _SCORED
    + f", c AS (SELECT *, len(list_filter({_normal_sql()}, lambda a: a NOT IN ('', '0')))::INT AS conditions FROM scored) "
    + " UNION ALL ".join(f"(SELECT '{k}' AS kind, row_number() OVER (ORDER BY {k} DESC, rule_id)::INT AS place, rule_id, pool_id, conditions, round({k}, 8) AS score FROM c WHERE {k} IS NOT NULL ORDER BY {k} DESC, rule_id LIMIT 10)" for k in ("score_2d", "score_t1", "score_t2")),
    "conditions_summary": f"""WITH t AS (SELECT rule_id, list_transform({_normal_sql()}, lambda a: CASE WHEN a NOT IN ('', '0') THEN CASE WHEN regexp_matches(a, '^.+t[0-9]+$') THEN regexp_extract(a, '^(.+)t([0-9]+)$', 1) || '(t-' || regexp_extract(a, '^(.+)t([0-9]+)$', 2)::INT || ')' ELSE a END END) AS l FROM zrp01a),
g AS (SELECT rule_id, l, coalesce(list_position(list_transform(l, lambda a: a IS NULL), true), 9) - 1 AS k FROM t), h AS (SELECT rule_id, k, CASE WHEN k > 0 THEN l[1:least(k, 3)] ELSE [] END AS s FROM g)
SELECT rule_id, k::INT AS k, array_to_string(s, ', ') || CASE WHEN k > 3 THEN ' ... (+' || (k - 3) || ')' ELSE '' END AS summary FROM h""",
    "instrument_summary": _P + """, g AS (SELECT symbol, count(*) AS n_rules, avg(support_count) AS mean_support, max(support_count) AS max_support, min(support_count) AS min_support, avg(abs(x_mean)) AS mean_abs_m1, avg(abs(x2_mean)) AS mean_abs_m2, max(abs(x_mean)) AS max_abs_m1, max(abs(x2_mean)) AS max_abs_m2,
  avg(x_sigma) AS mean_s1, avg(x2_sigma) AS mean_s2, min(x_sigma) AS min_s1, min(x2_sigma) AS min_s2, avg(concentration) AS mean_concentration, count(*) FILTER (greatest(abs(x_mean), abs(x2_mean)) >= 0.5) AS n_strong, count(*) FILTER (x_sigma < 0.3 AND x2_sigma < 0.3) AS n_calm, count(*) FILTER (support_count >= 50) AS n_supported FROM pool GROUP BY symbol)
SELECT symbol, n_rules, round(mean_support, 6) AS mean_support, max_support, min_support, round(mean_abs_m1, 6) AS mean_abs_m1, round(mean_abs_m2, 6) AS mean_abs_m2, max_abs_m1, max_abs_m2, round(mean_s1, 6) AS mean_s1, round(mean_s2, 6) AS mean_s2, min_s1, min_s2, round(mean_concentration, 6) AS mean_concentration, n_strong, n_calm, n_supported,
  round(100 * (n_rules / max(n_rules) OVER () * 0.2 + mean_support / max(mean_support) OVER () * 0.3 + n_strong / nullif(max(n_strong) OVER (), 0) * 0.2 + n_calm / nullif(max(n_calm) OVER (), 0) * 0.3), 6) AS composite,
  row_number() OVER (ORDER BY n_rules DESC, symbol) AS by_rules, row_number() OVER (ORDER BY max_abs_m1 DESC, symbol) AS by_mean, row_number() OVER (ORDER BY min_s1, symbol) AS by_sigma, row_number() OVER (ORDER BY max_support DESC, symbol) AS by_support FROM g""",
    "top3_by_instrument": _P + "SELECT symbol, rule_id, concentration, support_count, row_number() OVER (PARTITION BY symbol ORDER BY concentration DESC, rule_id) AS place FROM pool WHERE concentration IS NOT NULL QUALIFY place <= 3",
    "top_comparison": _P + """, t AS (SELECT *, x_mean / (x_sigma + 1e-6) AS sh FROM pool WHERE x_mean IS NOT NULL AND x_sigma > 0 ORDER BY support_count DESC, rule_id LIMIT 10)
SELECT rule_id, support_count, round(sh, 6) AS sharpe, round(support_count / max(support_count) OVER (), 6) AS support_ratio, round((sh - min(sh) OVER ()) / nullif(max(sh) OVER () - min(sh) OVER (), 0), 6) AS sharpe_scaled FROM t""",
    "derived_ratios": _P + """SELECT rule_id, x_mean / (x_sigma + 1e-6) AS sharpe1, x2_mean / (x2_sigma + 1e-6) AS sharpe2, (x2_mean - x_mean) / (x2_sigma + 1e-6) AS information, x2_mean - x_mean AS excess, x2_sigma / nullif(x_sigma, 0) AS volatility_ratio,
  x_mean / (x_sigma + 1e-6) * ln(1 + support_count) AS risk_adjusted, 1 - x_sigma / (1.5 * max(x_sigma) OVER ()) AS reduction FROM pool""",
    "instrument_top10": _P + "SELECT symbol, rule_id, support_count, support_rate, x_mean, x_sigma, row_number() OVER (PARTITION BY symbol ORDER BY support_count DESC, rule_id) AS place FROM pool WHERE support_count IS NOT NULL QUALIFY place <= 10",
    "head_then_filter": _P + "SELECT rule_id, concentration FROM (SELECT * FROM pool ORDER BY rule_id LIMIT 500) WHERE concentration >= 0.40",
    "outliers_z3": _P + _LONG + """, s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s, count(v) AS n FROM long GROUP BY feature)
SELECT feature, round(m, 9) AS m, round(s, 9) AS s, n, count(*) FILTER (abs(v - m) > 3 * s) AS outliers, round(100 * count(*) FILTER (abs(v - m) > 3 * s) / n, 9) AS percent FROM long JOIN s USING (feature) GROUP BY feature, m, s, n""",
    "pool_percentiles": _P + _LONG + ", p AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS p, unnest(range(1, 10)) AS k), q AS (SELECT feature, quantile_cont(v, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS l FROM long GROUP BY feature) SELECT feature, p, round(l[k], 6) AS value FROM q, p",
    "pool_describe": _P + _LONG + "SELECT symbol, feature, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS least, max(v) AS most FROM long GROUP BY ALL",
    "pool_correlations": _P + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM pool" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]),
    "significance_bins": _P + f"SELECT {_band('abs(t_statistic)', [0, 1, 1.96, 2, 2.58, 3], 3)} AS t_bin, {_band('support_count', [0, 50, 100, 200, 500, 1000], 1000)} AS support_bin, count(*) AS n, round(avg((abs(t_statistic) > 1.96)::INT), 6) AS significant_share FROM pool WHERE t_statistic IS NOT NULL AND t_statistic <> 0 AND support_count > 0 GROUP BY ALL",
    "snr_confidence": _P + """, q AS (SELECT symbol, quantile_cont(x_sigma, 0.25) AS q25 FROM pool GROUP BY symbol)
SELECT symbol, round(avg(abs(x_mean) / nullif(x_sigma, 0)), 6) AS mean_snr, round(max(abs(x_mean) / nullif(x_sigma, 0)), 6) AS max_snr, count(*) FILTER (x_sigma <= q25) AS confident, count(*) FILTER (x_mean > 0) AS n_up, count(*) FILTER (x_mean < 0) AS n_down FROM pool JOIN q USING (symbol) WHERE x_sigma IS NOT NULL GROUP BY symbol""",
    "distribution_bands": _P + ", v AS (SELECT *, (x_sigma + x2_sigma) / 2 AS w, (abs(x_mean) + abs(x2_mean)) / 2 AS st FROM pool) SELECT symbol, "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in {"tight": "w <= 0.35", "medium": "w > 0.35 AND w <= 0.45", "wide": "w > 0.45", "strong": "st >= 0.3", "fair": "st >= 0.2 AND st < 0.3", "weak": "st < 0.2", "support_10": "support_count = 10", "support_11_15": "support_count BETWEEN 11 AND 15", "support_16": "support_count >= 16", **{f"conditions_{k}": f"numattr = {k}" for k in range(3, 7)}, "m1_up": "x_mean > 0", "m1_down": "x_mean < 0", "m2_up": "x2_mean > 0", "m2_down": "x2_mean < 0"}.items())
    + " FROM v GROUP BY symbol",
    "insight_counts": _P + _QUALITY + """, q AS (SELECT *, tightness + direction + reliability AS q FROM parts)
SELECT symbol, count(*) FILTER (q >= 80) AS grade_a, count(*) FILTER (q >= 65 AND q < 80) AS grade_b, count(*) FILTER ((x_mean > 0) = (x2_mean > 0)) AS same_sign, count(*) FILTER ((x_mean > 0) <> (x2_mean > 0)) AS opposite_sign, count(*) FILTER ((abs(x_mean) + abs(x2_mean)) / 2 < 0.25) AS near_threshold, count(*) FILTER ((x_sigma + x2_sigma) / 2 > 0.40) AS high_variance, round(avg(q), 6) AS mean_quality FROM q GROUP BY symbol""",
    "dedupe_first_three": _SCORED + "SELECT rule_id, score_2d FROM scored WHERE score_2d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY attr1, attr2, attr3 ORDER BY scored.score_2d DESC, rule_id) = 1",
    "dedupe_across_trials": _P + f""", k AS (SELECT rule_id, symbol, mined_at, {_SET} AS key FROM pool)
SELECT rule_id, symbol, count(*) OVER (PARTITION BY symbol, key) AS n FROM k QUALIFY row_number() OVER (PARTITION BY symbol, key ORDER BY mined_at NULLS FIRST, rule_id) = 1""",
    "directional_bias": _M1
    + """, s AS (SELECT inst, rule_id, avg(x1) AS mu, stddev_samp(x1) AS sd, count(*) FILTER (x1 > 0) / nullif(count(*) FILTER (x1 <> 0), 0) AS wr, sum(x1) FILTER (x1 > 0) / nullif(-sum(x1) FILTER (x1 < 0), 0) AS pf FROM m GROUP BY ALL)
SELECT inst, rule_id, CASE WHEN sd > 0.5 AND mu > 0.1 AND wr >= 0.52 AND pf >= 1.1 THEN 'positive' WHEN sd > 0.5 AND mu < -0.1 AND wr <= 0.48 AND pf <= 0.9 THEN 'negative' ELSE 'neutral' END AS bias FROM s""",
    "rule_sort_views": _P + " UNION ALL ".join(f"(SELECT '{n}' AS sort_by, rule_id FROM pool WHERE {c} IS NOT NULL ORDER BY {c} DESC, rule_id LIMIT 20)" for n, c in _SORTS.items()),
    "sweep_summary": " UNION ALL ".join(f"SELECT '{p}' AS parameter, {p}::DOUBLE AS value, round(avg(rules_discovered), 6) AS mean, round(stddev_samp(rules_discovered), 6) AS sd, min(rules_discovered) AS least, max(rules_discovered) AS most, count(*) AS n FROM experiment_runs GROUP BY {p}" for p in PARAMETERS),
    "sweep_pivot": " UNION ALL ".join(f"SELECT '{a} x {b}' AS pivot, {a}::DOUBLE AS row, {b} AS col, round(avg(rules_discovered), 6) AS mean FROM experiment_runs GROUP BY ALL" for a, b in (("max_time_delay", "minsup"), ("min_concentration", "max_deviation"))),
    "sweep_best": f"""WITH t AS (SELECT DISTINCT * FROM experiment_runs WHERE rules_discovered IS NOT NULL) (SELECT 'most' AS side, {_KEYS}, rules_discovered FROM t ORDER BY rules_discovered DESC, {_KEYS} LIMIT 10) UNION ALL (SELECT 'fewest', {_KEYS}, rules_discovered FROM t ORDER BY rules_discovered, {_KEYS} LIMIT 10)
UNION ALL (SELECT 'best of ' || symbol, {_KEYS}, rules_discovered FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rules_discovered DESC, {_KEYS}) = 1)""",
    "experiment_totals": "SELECT symbol, count(*) AS runs, sum(rules_discovered) AS rules, count(*) FILTER (exit_code <> 0) AS failed, sum(duration_sec) AS seconds, max(rules_discovered) AS best FROM experiment_runs GROUP BY symbol",
    # Each greatest delay is mined on its own; the other settings are counted over all rules, without any cut by support.
    "sweep_from_matches": " UNION ALL ".join(
        f"SELECT * FROM ({_level_sql(2, replace(PARAMS, max_delay=delay, min_support=0.0))}" + f""", g AS (SELECT * FROM (VALUES (0.02::DOUBLE), (0.03), (0.05)) b(min_support), (VALUES (0.30::DOUBLE), (0.40), (0.45)) c(min_concentration), (VALUES (1000.0::DOUBLE), (5000.0), (20000.0)) e(max_deviation))
SELECT inst, {delay} AS max_delay, min_support, min_concentration, max_deviation, count(*) FILTER (support_rate >= min_support AND concentration >= min_concentration AND {_CALM}) AS rules FROM g, mined GROUP BY ALL)"""
        for delay in (3, 4, 5)
    ),
}
