"""Queries of profiles: windows, calendar, tests, over the orders panel and its matches, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagweave.functions.distributions import f_p_value, normal_cdf, t_p_value
from lagweave.functions.scores import localization, score_temporal
from lagweave.operators import profiles
from lagweave.operators.panels import EVENTS_SQL, PANEL_SQL, event_returns, order_returns
from lagweave.operators.quantiles import quantiles
from lagweave.plans.catalogue_rules import _M1, _matches, _panel, _rounded, rules_of

BY = ["inst", "rule_id"]


def volatility_ranking(spark, d):
    x = F.col("x")
    r = order_returns(spark, d)
    near = [F.avg((F.abs(x) <= k).cast("double")).alias(f"within_{k}") for k in (1, 2, 5)]
    s = r.groupBy("inst").agg(F.stddev_samp("x").alias("volatility"), F.avg("x").alias("mean_x"), F.avg(F.abs(x)).alias("abs_mean_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), (F.max("x") - F.min("x")).alias("range_x"), F.count("x").alias("n"), *near)
    q = quantiles(r, ["inst"], "x", [0.25, 0.5, 0.75]).groupBy("inst").pivot("p", [0.25, 0.5, 0.75]).agg(F.max("value"))
    q = q.toDF("inst", "q25", "median_x", "q75")
    out = s.where("n >= 100").join(q, "inst").withColumn("place", F.row_number().over(Window.orderBy(F.col("volatility").desc(), "inst")))
    return _rounded(out)


def rolling_stats(spark, d):
    return _rounded(profiles.rolling(order_returns(spark, d), 20).select("inst", "i", "roll_mean", "roll_sd", "roll_sharpe"), 3)


def rolling_centred(spark, d):
    return _rounded(profiles.rolling(order_returns(spark, d), 10, centred=True).select("inst", "i", "roll_mean"), 4)


def rolling_corr(spark, d):
    got = order_returns(spark, d).withColumn("p", F.col("price"))
    return _rounded(profiles.rolling_corr(got, "p", "prev", 20).select("inst", "i", "roll_corr"), 5)


def cum_return(spark, d):
    g = F.col("growth")
    got = profiles.growth(event_returns(spark, d))
    return got.select("inst", "i", F.round(F.when(F.abs(g) > 1e-9, F.log(F.abs(g))), 6).alias("log_growth"), F.signum(g).cast("int").alias("sign"))


def _flags(spark, d):
    """Every row of the series for every rule, hit or not."""
    _, s = _panel(spark, d)
    m = _matches(spark, d).select("inst", "rule_id", F.col("t").alias("i"), F.lit(1).alias("hit"))
    each = s.select("inst", "i").crossJoin(rules_of(spark).select("rule_id"))
    return each.join(m, ["inst", "rule_id", "i"], "left").select("inst", "rule_id", "i", F.coalesce("hit", F.lit(0)).alias("hit"))


def autocorr(spark, d):
    return _rounded(profiles.autocorrelation(_flags(spark, d), "hit", list(range(1, 31)), BY), 6)


def time_bins(spark, d):
    got = profiles.equal_width_bins(_matches(spark, d), BY, "t", 10).groupBy(*BY, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("x1").alias("mean_x1"))
    return _rounded(got)


def period_splits(spark, d):
    got = profiles.contiguous_splits(_matches(spark, d), BY, "t", 4).groupBy(*BY, "part").agg(F.count(F.lit(1)).alias("n"), F.avg("x1").alias("mean_x1"), F.min("t").alias("first_t"))
    return _rounded(got)


def match_intervals(spark, d):
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*BY).orderBy("t"))
    got = _matches(spark, d).withColumn("gap", gap).groupBy(*BY).agg(F.avg("gap").alias("interval_mean"), F.stddev_samp("gap").alias("interval_sd"), F.avg("t").alias("t_mean"), F.stddev_samp("t").alias("t_sd"))
    return _rounded(got)


def moments_var_cvar(spark, d):
    m = _matches(spark, d)
    var = quantiles(m, BY, "x1", [0.05]).select(*BY, F.col("value").alias("var95"))
    tail = m.join(var, BY).where("x1 <= var95").groupBy(*BY).agg(F.avg("x1").alias("cvar95"))
    return _rounded(profiles.moments(m, BY, "x1").join(var, BY).join(tail, BY))


def ecdf(spark, d):
    w = Window.partitionBy(*BY)
    rank = F.row_number().over(w.orderBy("x1", "t"))
    return _matches(spark, d).where("x1 IS NOT NULL").select(*BY, "t", F.round(rank / F.count(F.lit(1)).over(w), 6).alias("ecdf"))


def ks_statistic(spark, d):
    """Greatest distance between the empirical distribution of matched values and the normal one of the same mean and deviation."""
    w = Window.partitionBy(*BY)
    m = _matches(spark, d).where("x1 IS NOT NULL")
    n, place = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("x1", "t"))
    m = m.select(*BY, n.alias("n"), place.alias("k"), F.try_divide(F.col("x1") - F.avg("x1").over(w), F.stddev_samp("x1").over(w)).alias("z"))
    cdf = normal_cdf(F.col("z"))
    return _rounded(m.groupBy(*BY).agg(F.max(F.greatest(F.col("k") / F.col("n") - cdf, cdf - (F.col("k") - 1) / F.col("n"))).alias("ks")), 6)


def trend(spark, d):
    got = _matches(spark, d).groupBy(*BY).agg(F.regr_slope("x1", "t").alias("slope"), F.regr_intercept("x1", "t").alias("intercept"))
    return _rounded(got)


def anova_month(spark, d):
    got = profiles.anova(_matches(spark, d).withColumn("month", F.month("ts")), BY, "month", "x1")
    return _rounded(got, 5)


def anova_weekday(spark, d):
    got = profiles.anova(_matches(spark, d).withColumn("day", F.weekday("ts")), BY, "day", "x1")
    return _rounded(got, 5)


def anova_p_value(spark, d):
    got = profiles.anova(_matches(spark, d).withColumn("month", F.month("ts")), BY, "month", "x1")
    return _rounded(got.withColumn("p", f_p_value(F.col("f"), F.col("d1"), F.col("d2"))), 4)


def calendar_profile(spark, d):
    """Matches and mean by month, quarter and weekday (Monday is 1), months and days without matches included."""
    m = _matches(spark, d)
    parts = {"month": (F.month("ts"), 12), "quarter": (F.quarter("ts"), 4), "weekday": (F.weekday("ts") + 1, 7)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), v.alias("value")) for k, (v, _) in parts.items())))
    got = m.select(*BY, "x1", each.alias("e")).groupBy(*BY, "e.part", "e.value").agg(F.count(F.lit(1)).alias("n"), F.avg("x1").alias("mean_x1"))
    slots = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.lit(v).alias("value")) for k, (_, top) in parts.items() for v in range(1, top + 1))))
    frame = m.select(*BY).distinct().select(*BY, slots.alias("e")).select(*BY, "e.part", "e.value")
    return _rounded(frame.join(got, [*BY, "part", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0))))


def pivot_month_day(spark, d):
    m = _matches(spark, d).select(*BY, F.month("ts").alias("month"), F.concat(F.lit("d"), (F.weekday("ts") + 1).cast("string")).alias("day"), "x1")
    got = m.groupBy(*BY, "month").pivot("day", [f"d{i}" for i in range(1, 8)]).agg(F.count("x1"))
    return got.select(*BY, "month", *(F.coalesce(f"d{i}", F.lit(0)).alias(f"d{i}") for i in range(1, 8)))


def rule_compare(spark, d):
    """Match rate and the month and weekday with most matches (ties: the least)."""
    m = _matches(spark, d)
    def top(c, name):
        got = m.groupBy(*BY, c.alias(name)).agg(F.count(F.lit(1)).alias("c"))
        return got.groupBy(*BY).agg(F.min(F.struct(-F.col("c"), name)).alias("b")).select(*BY, F.col(f"b.{name}").alias(f"mode_{name}"))
    s = m.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("total")).withColumn("match_rate", F.col("n") / F.col("total"))
    return _rounded(s.join(top(F.month("ts"), "month"), BY).join(top(F.weekday("ts") + 1, "weekday"), BY), 6)


def match_years(spark, d):
    return _matches(spark, d).groupBy(*BY, F.year("ts").alias("year"), F.weekday("ts").alias("weekday0")).agg(F.count(F.lit(1)).alias("n"))


def five_numbers(spark, d):
    """Five-number summaries of the whole series in those months in which a rule matched."""
    months = _matches(spark, d).select(*BY, F.month("ts").alias("month")).distinct()
    _, s = _panel(spark, d)
    q = quantiles(s.withColumn("month", F.month("ts")), ["inst", "month"], "x0", [0, 0.25, 0.5, 0.75, 1]).groupBy("inst", "month").pivot("p", [0.0, 0.25, 0.5, 0.75, 1.0]).agg(F.max("value"))
    q = q.toDF("inst", "month", "p0", "p25", "p50", "p75", "p100")
    return _rounded(months.join(q, ["inst", "month"]))


def series_correlation(spark, d):
    m = _matches(spark, d)
    return _rounded(m.groupBy(*BY).agg(profiles.correlation("x1", "x2").alias("r"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.stddev_samp("x1").alias("s1"), F.stddev_samp("x2").alias("s2")), 5)


def extreme_signals(spark, d):
    """Strength, ratio to noise, extremeness, t statistic and tail rate of each rule's values against the whole series."""
    return _rounded(_extreme(spark, d), 5)


def _extreme(spark, d):
    _, s = _panel(spark, d)
    g = s.groupBy("inst").agg(F.stddev_samp("x0").alias("g_sd"))
    m = _matches(spark, d, "m4").where("x0 IS NOT NULL").join(g, "inst")
    got = m.groupBy(*BY, "g_sd").agg(F.count(F.lit(1)).alias("n"), F.avg("x0").alias("m"), F.coalesce(F.stddev_samp("x0"), F.lit(0.0)).alias("s"), F.avg((F.abs("x0") > 2 * F.col("g_sd")).cast("double")).alias("tail_rate"))
    t = F.when(F.col("n") > 1, F.try_divide(F.col("m"), F.col("s") / F.sqrt("n"))).otherwise(0.0)
    return got.select(*BY, "n", F.abs("m").alias("strength"), (F.abs("m") / (F.col("s") + 1e-6)).alias("snr"), F.try_divide(F.abs("m"), F.col("g_sd")).alias("extremeness"), t.alias("t_stat"), "tail_rate")


def extreme_ranking(spark, d):
    """Rules strong enough, with p-value and the weighted score."""
    got = _extreme(spark, d).withColumn("p", F.when(F.col("n") > 1, t_p_value(F.col("t_stat"), F.col("n") - 1)).otherwise(1.0))
    score = 10 * F.col("strength") + 5 * F.col("snr") + 3 * F.col("extremeness") + 2 * (1 - F.col("p")) + 5 * F.col("tail_rate")
    kept = got.withColumn("score", score).where("strength >= 0.3 AND snr >= 0.3 AND n >= 30 AND p < 0.05")
    return _rounded(kept.orderBy(F.col("score").desc(), *BY).limit(20), 4)


def _spread(df, by, prefix):
    """Of the values v by group: number, mean, variance, and mean and sum of squares of their distances from the median."""
    med = quantiles(df, by, "v", [0.5]).select(*by, F.col("value").alias("med"))
    dev = df.join(med, by).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    stats = {"n": F.count("v"), "mean": F.avg("v"), "var": F.var_samp("v"), "dm": F.avg("dev"), "ss": F.var_pop("dev") * F.count("v")}
    return dev.groupBy(*by).agg(*(c.alias(f"{prefix}_{n}") for n, c in stats.items()))


def _levene(spark, d):
    """Per rule: the matched values against the whole series, which is summed up once per instrument, by the analysis of variance of their distances from their medians."""
    _, s = _panel(spark, d)
    local = _spread(_matches(spark, d).select(*BY, F.col("x1").alias("v")).where("v IS NOT NULL"), BY, "l")
    got = local.join(_spread(s.select("inst", F.col("x0").alias("v")).where("v IS NOT NULL"), ["inst"], "g"), "inst")
    n = F.col("l_n") + F.col("g_n")
    mean = (F.col("l_n") * F.col("l_dm") + F.col("g_n") * F.col("g_dm")) / n
    between = F.col("l_n") * (F.col("l_dm") - mean) * (F.col("l_dm") - mean) + F.col("g_n") * (F.col("g_dm") - mean) * (F.col("g_dm") - mean)
    return got.withColumn("f", F.try_divide(between, (F.col("l_ss") + F.col("g_ss")) / (n - 2))).withColumn("d1", F.lit(1)).withColumn("d2", n - 2)


def _welch():
    return F.try_divide(F.col("l_mean") - F.col("g_mean"), F.sqrt(F.col("l_var") / F.col("l_n") + F.col("g_var") / F.col("g_n")))


def local_distribution(spark, d):
    """Variance reduction, Levene statistic, Welch statistic and variance ratio of matched values against the series."""
    out = _levene(spark, d).select(*BY, F.col("l_n").alias("n"), (1 - F.sqrt("l_var") / F.sqrt("g_var")).alias("reduction"), F.col("f").alias("levene"), _welch().alias("welch_t"), F.try_divide(F.col("g_var"), F.col("l_var")).alias("f_ratio"))
    return _rounded(out.where("n >= 30"), 5)


def local_significance(spark, d):
    """The p-values of these, of the two-sided test of both variances, the effect size, and whether the variance is significantly reduced; under 30 matches there is no test."""
    a, b = F.col("l_var") / F.col("l_n"), F.col("g_var") / F.col("g_n")
    freedom = F.try_divide((a + b) * (a + b), a * a / (F.col("l_n") - 1) + b * b / (F.col("g_n") - 1))
    got = _levene(spark, d).withColumn("ratio", F.try_divide(F.col("g_var"), F.col("l_var"))).withColumn("welch", _welch()).withColumn("freedom", freedom)
    got = got.withColumn("levene_p", f_p_value(F.col("f"), F.col("d1"), F.col("d2"))).withColumn("welch_p", t_p_value(F.col("welch"), F.col("freedom"))).withColumn("upper", f_p_value(F.col("ratio"), F.col("g_n") - 1, F.col("l_n") - 1))
    enough = F.col("l_n") >= 30
    of = lambda c, n: F.when(enough, F.round(c, 4)).alias(n)
    sure = (F.col("levene_p") < 0.05) & (F.col("ratio") > 1.5)
    effect = (F.col("g_mean") - F.col("l_mean")) / F.sqrt((F.col("g_var") + F.col("l_var")) / 2)
    return got.select(*BY, F.col("l_n").alias("n"), F.when(~enough, "insufficient").when(sure, "reduced").otherwise("not reduced").alias("verdict"), of(F.col("levene_p"), "levene_p"), of(F.col("welch_p"), "welch_p"), of(2 * F.least(F.col("upper"), 1 - F.col("upper")), "f_p"), F.round(effect, 4).alias("cohens_d"))


def localization_score(spark, d):
    got = _levene(spark, d).withColumn("p", f_p_value(F.col("f"), F.col("d1"), F.col("d2")))
    reduction = (1 - F.col("l_var") / F.col("g_var")) * 100
    return _rounded(got.select(*BY, F.col("l_n").alias("n"), reduction.alias("reduction"), "p", localization(reduction, F.col("l_n"), F.col("p")).alias("score")), 4)


def score_temporal_rules(spark, d):
    got = _matches(spark, d).groupBy(*BY, "n").agg(F.count(F.lit(1)).alias("c"), F.avg("x1").alias("m"), F.stddev_samp("x1").alias("s"), F.count_if(F.col("x1") > 0).alias("pos"), F.count_if(F.col("x1") < 0).alias("neg"))
    score = score_temporal(F.col("c") / F.col("n"), F.col("m"), F.col("s"), F.col("pos"), F.col("neg"), F.col("c"))
    return _rounded(got.select(*BY, F.col("c").alias("matches"), F.coalesce(score, F.lit(0.0)).alias("score")), 5)


def background_population(spark, d):
    """All matches of all rules, duplicates kept, as the background of each rule's own."""
    m = _matches(spark, d)
    pooled = m.groupBy("inst").agg(F.count(F.lit(1)).alias("pooled_n"), F.avg("x1").alias("pooled_m1"), F.avg("x2").alias("pooled_m2"))
    own = m.groupBy(*BY).agg(F.count(F.lit(1)).alias("own_n"), F.avg("x1").alias("own_m1"), F.avg("x2").alias("own_m2"))
    return _rounded(own.join(pooled, "inst"))


def density_x1(spark, d):
    return profiles.density(_matches(spark, d), BY, "x1").select(*BY, "point", F.round("at", 4).alias("at"), F.round("density", 8).alias("density"))


def win_table(spark, d):
    """Counts of better or worse than the series' mean by sign."""
    _, s = _panel(spark, d)
    g = s.groupBy("inst").agg(F.avg("x0").alias("g"))
    m = _matches(spark, d).where("x1 IS NOT NULL").join(g, "inst")
    return m.groupBy(*BY, (F.col("x1") > F.col("g")).cast("int").alias("better"), (F.col("x1") > 0).cast("int").alias("positive")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        volatility_ranking, rolling_stats, rolling_centred, rolling_corr, cum_return, autocorr, time_bins, period_splits, match_intervals, moments_var_cvar, ecdf, ks_statistic, trend, anova_month, anova_weekday, anova_p_value,
        calendar_profile, pivot_month_day, rule_compare, match_years, five_numbers, series_correlation, extreme_signals, extreme_ranking, local_distribution, local_significance, localization_score, score_temporal_rules, background_population, density_x1, win_table,
    )
}

_ROLL = "CASE WHEN count(x) OVER w >= {k} THEN {e} END"
_SQ = "quantile_cont(x1, 0.05)"
_FRAME = " UNION ALL ".join(f"SELECT '{p}' AS part, unnest(range(1, {n + 1}))::INT AS value" for p, n in (("month", 12), ("quarter", 4), ("weekday", 7)))



def f_upper_sql(f, d1, d2, steps=2000):
    """P(F >= f) by Simpson's rule over the beta density, after the substitution of a square that takes away its pole at 0."""
    a, b = f"(({d1}) / 2.0)", f"(({d2}) / 2.0)"
    end = f"sqrt(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    at = f"({end} * k / {steps})"
    log = f"(2 * {a} - 1) * ln({at}) + ({b} - 1) * ln(1 - {at} * {at})"
    value = f"CASE WHEN k = 0 THEN CASE WHEN {a} = 0.5 THEN 1 ELSE 0 END ELSE exp({log} - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) END"
    first = f"CASE WHEN k = 0 AND {a} = 0.5 THEN exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) ELSE 1 END"
    total = f"list_sum(list_transform(range(0, {steps + 1}), lambda k: (CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * ({first}) * ({value})))"
    return f"(CASE WHEN ({f}) <= 0 THEN 1.0 ELSE greatest(0, 1 - 2 * {total} * {end} / {steps} / 3) END)"


_ANOVA = """, g AS (SELECT inst, rule_id, {0} AS mo, count(x1) AS n, avg(x1) AS mu, var_pop(x1) * count(x1) AS ss FROM m GROUP BY ALL),
t AS (SELECT *, sum(n * mu) OVER w / sum(n) OVER w AS gm FROM g WINDOW w AS (PARTITION BY inst, rule_id)),
s AS (SELECT inst, rule_id, sum(n * (mu - gm) * (mu - gm)) AS b, sum(ss) AS wi, count(*) AS k, sum(n) AS n FROM t GROUP BY ALL),
a AS (SELECT inst, rule_id, CASE WHEN k > 1 AND n > k THEN (b / (k - 1)) / nullif(wi / (n - k), 0) END AS f, k - 1 AS d1, n - k AS d2 FROM s)
"""
_LEVENE = """, b AS (SELECT inst, rule_id, x1 AS v, 'local' AS side FROM m UNION ALL SELECT s.inst, rule_id, x0, 'global' FROM series s JOIN (SELECT DISTINCT inst, rule_id FROM m) USING (inst)),
e AS (SELECT *, abs(v - median(v) OVER (PARTITION BY inst, rule_id, side)) AS dev FROM b WHERE v IS NOT NULL),
g AS (SELECT inst, rule_id, side, count(v) AS n, avg(v) AS mu, var_samp(v) AS va, avg(dev) AS dm, var_pop(dev) * count(v) AS ss FROM e GROUP BY ALL),
t AS (SELECT *, sum(n * dm) OVER w / sum(n) OVER w AS gm FROM g WINDOW w AS (PARTITION BY inst, rule_id)),
s AS (SELECT inst, rule_id, sum(n * (dm - gm) * (dm - gm)) AS bt, sum(ss) AS wi, sum(n) AS n, max(n) FILTER (side = 'local') AS ln, max(n) FILTER (side = 'global') AS gn, max(va) FILTER (side = 'local') AS lv, max(va) FILTER (side = 'global') AS gv,
  max(mu) FILTER (side = 'local') AS lm, max(mu) FILTER (side = 'global') AS gmu FROM t GROUP BY ALL),
l AS (SELECT *, bt / nullif(wi / (n - 2), 0) AS f, n - 2 AS d2, (lm - gmu) / nullif(sqrt(lv / ln + gv / gn), 0) AS wt, pow(lv / ln + gv / gn, 2) / nullif(pow(lv / ln, 2) / (ln - 1) + pow(gv / gn, 2) / (gn - 1), 0) AS wf, gv / nullif(lv, 0) AS ratio FROM s)
"""
_SIGNALS = """, g AS (SELECT inst, stddev_samp(x0) AS g FROM series GROUP BY inst),
a AS (SELECT inst, rule_id, g, count(*) AS n, avg(x0) AS mu, coalesce(stddev_samp(x0), 0) AS s, avg((abs(x0) > 2 * g)::INT) AS tail_rate FROM m JOIN g USING (inst) WHERE x0 IS NOT NULL GROUP BY ALL),
x AS (SELECT inst, rule_id, n, abs(mu) AS strength, abs(mu) / (s + 1e-6) AS snr, abs(mu) / nullif(g, 0) AS extremeness, CASE WHEN n > 1 THEN mu / nullif(s / sqrt(n), 0) ELSE 0 END AS t_stat, tail_rate FROM a),
y AS (SELECT *, CASE WHEN n > 1 THEN {p} ELSE 1.0 END AS p FROM x), z AS (SELECT *, 10 * strength + 5 * snr + 3 * extremeness + 2 * (1 - p) + 5 * tail_rate AS score FROM y)
""".format(p=f_upper_sql("t_stat * t_stat", "1", "n - 1"))
_SIGNAL_COLS = "inst, rule_id, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("strength", "snr", "extremeness", "t_stat", "tail_rate", "p", "score"))

ORACLE = {
    "anova_weekday": _M1 + _ANOVA.format("isodow(ts)") + "SELECT inst, rule_id, round(f, 5) AS f, d1, d2 FROM a",
    "anova_p_value": _M1 + _ANOVA.format("month(ts)") + f"SELECT inst, rule_id, round(f, 4) AS f, d1, d2, round({f_upper_sql('f', 'd1', 'd2')}, 4) AS p FROM a",
    "local_significance": _M1 + _LEVENE + f""", q AS (SELECT *, {f_upper_sql('f', '1', 'd2')} AS lp, {f_upper_sql('wt * wt', '1', 'wf')} AS wp, {f_upper_sql('ratio', 'gn - 1', 'ln - 1')} AS up FROM l)
SELECT inst, rule_id, ln AS n, CASE WHEN ln < 30 THEN 'insufficient' WHEN lp < 0.05 AND ratio > 1.5 THEN 'reduced' ELSE 'not reduced' END AS verdict, CASE WHEN ln >= 30 THEN round(lp, 4) END AS levene_p, CASE WHEN ln >= 30 THEN round(wp, 4) END AS welch_p,
  CASE WHEN ln >= 30 THEN round(2 * least(up, 1 - up), 4) END AS f_p, round((gmu - lm) / sqrt((gv + lv) / 2), 4) AS cohens_d FROM q""",
    "localization_score": _M1 + _LEVENE + f""", q AS (SELECT *, {f_upper_sql('f', '1', 'd2')} AS p, (1 - lv / gv) * 100 AS reduction FROM l)
SELECT inst, rule_id, ln AS n, round(reduction, 4) AS reduction, round(p, 4) AS p, round(CASE WHEN ln < 5 THEN '-inf'::DOUBLE ELSE least(reduction, 50) + CASE WHEN ln < 10 THEN 2.0 * ln WHEN ln <= 100 THEN 20 ELSE greatest(0, 20 - (ln - 100) * 0.1) END
  + CASE WHEN p < 0.01 THEN 30 WHEN p < 0.05 THEN 20 WHEN p < 0.1 THEN 10 ELSE 0 END END, 4) AS score FROM q""",
    "extreme_ranking": _M1.replace("h.t < s.n - 2", "h.t < s.n - 0") + _SIGNALS + f"SELECT {_SIGNAL_COLS} FROM (SELECT * FROM z WHERE strength >= 0.3 AND snr >= 0.3 AND n >= 30 AND p < 0.05 ORDER BY score DESC, inst, rule_id LIMIT 20)",
    "density_x1": _M1
    + """, s AS (SELECT inst, rule_id, count(x1) AS n, min(x1) AS lo, max(x1) AS hi, stddev_samp(x1) AS sd FROM m WHERE x1 IS NOT NULL GROUP BY ALL HAVING stddev_samp(x1) > 0),
c AS (SELECT inst, rule_id, least(floor((x1 - lo) / nullif((hi - lo) / 2048, 0)), 2047) AS b, s.n, lo, hi, sd, count(*) AS c, avg(x1) AS v FROM m JOIN s USING (inst, rule_id) WHERE x1 IS NOT NULL GROUP BY ALL),
p AS (SELECT *, lo + (hi - lo) * k.point / 63 AS "at", sd * pow(n, -0.2) AS h FROM c, (SELECT unnest(range(64))::INT AS point) k)
SELECT inst, rule_id, point, round("at", 4) AS "at", round(sum(c * exp(-pow(("at" - v) / h, 2) / 2) / h) / max(n) / 2.5066282746310002::DOUBLE, 8) AS density FROM p GROUP BY inst, rule_id, point, "at" """,
    "volatility_ranking": PANEL_SQL
    + """SELECT inst, round(volatility, 4) AS volatility, round(mean_x, 4) AS mean_x, round(abs_mean_x, 4) AS abs_mean_x, round(min_x, 4) AS min_x, round(max_x, 4) AS max_x, round(max_x - min_x, 4) AS range_x, n,
  round(within_1, 4) AS within_1, round(within_2, 4) AS within_2, round(within_5, 4) AS within_5, round(q25, 4) AS q25, round(median_x, 4) AS median_x, round(q75, 4) AS q75, row_number() OVER (ORDER BY volatility DESC, inst) AS place
  FROM (SELECT inst, stddev_samp(x) AS volatility, avg(x) AS mean_x, avg(abs(x)) AS abs_mean_x, min(x) AS min_x, max(x) AS max_x, count(x) AS n, avg((abs(x) <= 1)::INT) AS within_1, avg((abs(x) <= 2)::INT) AS within_2, avg((abs(x) <= 5)::INT) AS within_5,
  quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median_x, quantile_cont(x, 0.75) AS q75 FROM rets GROUP BY inst HAVING count(x) >= 100)""",
    "rolling_stats": PANEL_SQL + f"SELECT inst, i, {', '.join(_ROLL.format(k=20, e=f'round({e}, 3)') + f' AS {a}' for a, e in (('roll_mean', 'avg(x) OVER w'), ('roll_sd', 'stddev_samp(x) OVER w'), ('roll_sharpe', 'avg(x) OVER w / (stddev_samp(x) OVER w + 1e-6)')))} FROM rets WINDOW w AS (PARTITION BY inst ORDER BY i ROWS 19 PRECEDING)",
    "rolling_centred": PANEL_SQL + f"SELECT inst, i, {_ROLL.format(k=10, e='round(avg(x) OVER w, 4)')} AS roll_mean FROM rets WINDOW w AS (PARTITION BY inst ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)",
    "rolling_corr": PANEL_SQL + "SELECT inst, i, CASE WHEN count(price + prev) OVER w >= 20 AND stddev_pop(price) OVER w > 1e-9 * (1 + abs(avg(price) OVER w)) AND stddev_pop(prev) OVER w > 1e-9 * (1 + abs(avg(prev) OVER w)) THEN round(corr(price, prev) OVER w, 5) END AS roll_corr FROM rets WINDOW w AS (PARTITION BY inst ORDER BY i ROWS 19 PRECEDING)",
    "cum_return": EVENTS_SQL
    + """, f AS (SELECT inst, i, 1 + coalesce(x, 0) / 100 AS f FROM rets), g AS (SELECT inst, i, count(*) FILTER (f = 0) OVER w AS z, count(*) FILTER (f < 0) OVER w AS neg, sum(CASE WHEN f <> 0 THEN ln(abs(f)) ELSE 0 END) OVER w AS s FROM f WINDOW w AS (PARTITION BY inst ORDER BY i))
SELECT inst, i, CASE WHEN z = 0 AND exp(s) > 1e-9 THEN round(s, 6) END AS log_growth, CASE WHEN z > 0 THEN 0 WHEN neg % 2 = 1 THEN -1 ELSE 1 END::INT AS sign FROM g""",
    "autocorr": _M1
    + """, ids AS (SELECT unnest(range(1, 21))::INT AS rule_id), f AS (SELECT s.inst, ids.rule_id, s.i, (m.t IS NOT NULL)::INT::DOUBLE AS v FROM series s CROSS JOIN ids LEFT JOIN m ON m.inst = s.inst AND m.rule_id = ids.rule_id AND m.t = s.i),
k AS (SELECT unnest(range(1, 31))::INT AS lag), p AS (SELECT a.inst, a.rule_id, k.lag, a.v AS a, b.v AS b FROM f a JOIN k ON true JOIN f b ON b.inst = a.inst AND b.rule_id = a.rule_id AND b.i = a.i - k.lag)
SELECT inst, rule_id, lag, CASE WHEN stddev_pop(a) > 1e-9 AND stddev_pop(b) > 1e-9 THEN round(corr(a, b), 6) END AS value FROM p GROUP BY ALL""",
    "time_bins": _M1
    + """, e AS (SELECT *, min(t) OVER g AS lo, max(t) OVER g AS hi FROM m WINDOW g AS (PARTITION BY inst, rule_id))
SELECT inst, rule_id, greatest(1, least(10, coalesce(ceil((t - lo) * 10 / nullif(hi - lo, 0)), 1)))::INT AS bin, count(*) AS n, round(avg(x1), 4) AS mean_x1 FROM e GROUP BY ALL""",
    "period_splits": _M1
    + """, e AS (SELECT *, row_number() OVER (PARTITION BY inst, rule_id ORDER BY t) - 1 AS place, greatest(count(*) OVER (PARTITION BY inst, rule_id) // 4, 1) AS size FROM m)
SELECT inst, rule_id, least(place // size, 3)::INT AS part, count(*) AS n, round(avg(x1), 4) AS mean_x1, min(t) AS first_t FROM e GROUP BY ALL""",
    "match_intervals": _M1
    + """, e AS (SELECT *, t - lag(t) OVER (PARTITION BY inst, rule_id ORDER BY t) AS gap FROM m)
SELECT inst, rule_id, round(avg(gap), 4) AS interval_mean, round(stddev_samp(gap), 4) AS interval_sd, round(avg(t), 4) AS t_mean, round(stddev_samp(t), 4) AS t_sd FROM e GROUP BY ALL""",
    "moments_var_cvar": _M1
    + f""", g AS (SELECT inst, rule_id, avg(x1) AS mu, {_SQ} AS v, count(x1) AS n FROM m GROUP BY ALL),
c AS (SELECT inst, rule_id, avg(pow(x1 - mu, 2)) AS m2, avg(pow(x1 - mu, 3)) AS m3, avg(pow(x1 - mu, 4)) AS m4, avg(x1) FILTER (x1 <= v) AS cv FROM m JOIN g USING (inst, rule_id) GROUP BY ALL)
SELECT inst, rule_id, n, round(mu, 4) AS mean, round(m3 / nullif(pow(m2, 1.5), 0), 4) AS skewness, round(m4 / nullif(m2 * m2, 0) - 3, 4) AS kurtosis, round(v, 4) AS var95, round(cv, 4) AS cvar95 FROM g JOIN c USING (inst, rule_id)""",
    "ecdf": _M1 + "SELECT inst, rule_id, t, round(row_number() OVER (PARTITION BY inst, rule_id ORDER BY x1, t) / count(*) OVER (PARTITION BY inst, rule_id), 6) AS ecdf FROM m WHERE x1 IS NOT NULL",
    "ks_statistic": _M1
    + """, z AS (SELECT inst, rule_id, count(*) OVER w AS n, row_number() OVER (PARTITION BY inst, rule_id ORDER BY x1, t) AS k, (x1 - avg(x1) OVER w) / nullif(stddev_samp(x1) OVER w, 0) AS z FROM m WHERE x1 IS NOT NULL WINDOW w AS (PARTITION BY inst, rule_id)),
u AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS u FROM z),
e AS (SELECT *, 1 - ((((1.061405429::DOUBLE * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-z * z / 2) AS e FROM u),
c AS (SELECT *, CASE WHEN z >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END AS c FROM e)
SELECT inst, rule_id, round(max(greatest(k / n - c, c - (k - 1) / n)), 6) AS ks FROM c GROUP BY ALL""",
    "trend": _M1 + "SELECT inst, rule_id, CASE WHEN var_pop(t) > 0 THEN round(regr_slope(x1, t), 4) END AS slope, CASE WHEN var_pop(t) > 0 THEN round(regr_intercept(x1, t), 4) END AS intercept FROM m GROUP BY ALL",
    "anova_month": _M1
    + """, g AS (SELECT inst, rule_id, month(ts) AS mo, count(x1) AS n, avg(x1) AS mu, var_pop(x1) * count(x1) AS ss FROM m GROUP BY ALL),
t AS (SELECT *, sum(n * mu) OVER w / sum(n) OVER w AS gm FROM g WINDOW w AS (PARTITION BY inst, rule_id)),
s AS (SELECT inst, rule_id, sum(n * (mu - gm) * (mu - gm)) AS b, sum(ss) AS wi, count(*) AS k, sum(n) AS n FROM t GROUP BY ALL)
SELECT inst, rule_id, round(CASE WHEN k > 1 AND n > k THEN (b / (k - 1)) / nullif(wi / (n - k), 0) END, 5) AS f, k - 1 AS d1, n - k AS d2 FROM s""",
    "calendar_profile": _M1
    + f""", fr AS ({_FRAME}), ids AS (SELECT DISTINCT inst, rule_id FROM m),
e AS (SELECT inst, rule_id, x1, 'month' AS part, month(ts)::INT AS value FROM m UNION ALL SELECT inst, rule_id, x1, 'quarter', quarter(ts)::INT FROM m UNION ALL SELECT inst, rule_id, x1, 'weekday', isodow(ts)::INT FROM m),
g AS (SELECT inst, rule_id, part, value, count(*) AS n, avg(x1) AS a FROM e GROUP BY ALL)
SELECT inst, rule_id, part, value, coalesce(n, 0) AS n, round(a, 4) AS mean_x1 FROM ids CROSS JOIN fr LEFT JOIN g USING (inst, rule_id, part, value)""",
    "pivot_month_day": _M1 + "SELECT inst, rule_id, month(ts)::INT AS month, " + ", ".join(f"count(x1) FILTER (isodow(ts) = {i}) AS d{i}" for i in range(1, 8)) + " FROM m GROUP BY ALL",
    "rule_compare": _M1
    + """, mo AS (SELECT inst, rule_id, month(ts)::INT AS mode_month FROM m GROUP BY inst, rule_id, month(ts) QUALIFY row_number() OVER (PARTITION BY inst, rule_id ORDER BY count(*) DESC, month(ts)) = 1),
wd AS (SELECT inst, rule_id, isodow(ts)::INT AS mode_weekday FROM m GROUP BY inst, rule_id, isodow(ts) QUALIFY row_number() OVER (PARTITION BY inst, rule_id ORDER BY count(*) DESC, isodow(ts)) = 1)
SELECT inst, rule_id, count(*) AS n, max(m.n) AS total, round(count(*) / max(m.n), 6) AS match_rate, mode_month, mode_weekday FROM m JOIN mo USING (inst, rule_id) JOIN wd USING (inst, rule_id) GROUP BY inst, rule_id, mode_month, mode_weekday""",
    "match_years": _M1 + "SELECT inst, rule_id, year(ts)::INT AS year, (isodow(ts) - 1)::INT AS weekday0, count(*) AS n FROM m GROUP BY ALL",
    "five_numbers": _M1
    + """, q AS (SELECT inst, month(ts)::INT AS month, min(x0) AS p0, quantile_cont(x0, 0.25) AS p25, quantile_cont(x0, 0.5) AS p50, quantile_cont(x0, 0.75) AS p75, max(x0) AS p100 FROM series GROUP BY ALL)
SELECT DISTINCT inst, rule_id, q.month, round(p0, 4) AS p0, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p100, 4) AS p100 FROM m JOIN q USING (inst) WHERE q.month = month(m.ts)""",
    "series_correlation": _M1 + "SELECT inst, rule_id, CASE WHEN stddev_pop(x1) > 1e-9 * (1 + abs(avg(x1))) AND stddev_pop(x2) > 1e-9 * (1 + abs(avg(x2))) THEN round(corr(x1, x2), 5) END AS r, round(avg(x1), 5) AS m1, round(avg(x2), 5) AS m2, round(stddev_samp(x1), 5) AS s1, round(stddev_samp(x2), 5) AS s2 FROM m GROUP BY ALL",
    "extreme_signals": _M1.replace("h.t < s.n - 2", "h.t < s.n - 0")
    + """, g AS (SELECT inst, stddev_samp(x0) AS g FROM series GROUP BY inst),
a AS (SELECT inst, rule_id, g, count(*) AS n, avg(x0) AS mu, coalesce(stddev_samp(x0), 0) AS s, avg((abs(x0) > 2 * g)::INT) AS tr FROM m JOIN g USING (inst) WHERE x0 IS NOT NULL GROUP BY ALL)
SELECT inst, rule_id, n, round(abs(mu), 5) AS strength, round(abs(mu) / (s + 1e-6), 5) AS snr, round(abs(mu) / nullif(g, 0), 5) AS extremeness, round(CASE WHEN n > 1 THEN mu / nullif(s / sqrt(n), 0) ELSE 0 END, 5) AS t_stat, round(tr, 5) AS tail_rate FROM a""",
    "local_distribution": _M1
    + """, b AS (SELECT inst, rule_id, x1 AS v, 'local' AS side FROM m UNION ALL SELECT s.inst, rule_id, x0, 'global' FROM series s JOIN (SELECT DISTINCT inst, rule_id FROM m) USING (inst)),
e AS (SELECT *, abs(v - median(v) OVER (PARTITION BY inst, rule_id, side)) AS dev FROM b WHERE v IS NOT NULL),
g AS (SELECT inst, rule_id, side, count(v) AS n, avg(v) AS mu, var_samp(v) AS va, avg(dev) AS dm, var_pop(dev) * count(v) AS ss FROM e GROUP BY ALL),
t AS (SELECT *, sum(n * dm) OVER w / sum(n) OVER w AS gm FROM g WINDOW w AS (PARTITION BY inst, rule_id)),
s AS (SELECT inst, rule_id, sum(n * (dm - gm) * (dm - gm)) AS bt, sum(ss) AS wi, count(*) AS k, sum(n) AS n, max(n) FILTER (side = 'local') AS ln, max(n) FILTER (side = 'global') AS gn, max(va) FILTER (side = 'local') AS lv, max(va) FILTER (side = 'global') AS gv,
  max(mu) FILTER (side = 'local') AS lm, max(mu) FILTER (side = 'global') AS gmu FROM t GROUP BY ALL)
SELECT inst, rule_id, ln AS n, round(1 - sqrt(lv) / sqrt(gv), 5) AS reduction, round((bt / (k - 1)) / nullif(wi / (n - k), 0), 5) AS levene, round((lm - gmu) / nullif(sqrt(lv / ln + gv / gn), 0), 5) AS welch_t, round(gv / nullif(lv, 0), 5) AS f_ratio FROM s WHERE ln >= 30""",
    "score_temporal_rules": _M1
    + """, a AS (SELECT inst, rule_id, m.n AS total, count(*) AS c, avg(x1) AS mu, stddev_samp(x1) AS s, count(*) FILTER (x1 > 0) AS p, count(*) FILTER (x1 < 0) AS q FROM m GROUP BY inst, rule_id, m.n)
SELECT inst, rule_id, c AS matches, round(CASE WHEN s > 0 THEN c / total * 1000 * abs(mu) * greatest(p, q) / c / s ELSE 0 END, 5) AS score FROM a""",
    "background_population": _M1
    + """, p AS (SELECT inst, count(*) AS pooled_n, round(avg(x1), 4) AS pooled_m1, round(avg(x2), 4) AS pooled_m2 FROM m GROUP BY inst)
SELECT inst, rule_id, count(*) AS own_n, round(avg(x1), 4) AS own_m1, round(avg(x2), 4) AS own_m2, pooled_n, pooled_m1, pooled_m2 FROM m JOIN p USING (inst) GROUP BY ALL""",
    "win_table": _M1 + ", g AS (SELECT inst, avg(x0) AS g FROM series GROUP BY inst) SELECT inst, rule_id, (x1 > g)::INT AS better, (x1 > 0)::INT AS positive, count(*) AS n FROM m JOIN g USING (inst) WHERE x1 IS NOT NULL GROUP BY ALL",
}
