"""Further reports on rules and their matches: populations, contrasts, shared ranks, exports, mining in two phases; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagweave.functions import quadrants as quad
from lagweave.functions import scores as sc
from lagweave.functions.distributions import t_p_value
from lagweave.operators import profiles
from lagweave.operators.panels import PANEL_SQL
from lagweave.operators.quantiles import quantiles
from lagweave.plans.catalogue_pool import _P, pool
from lagweave.plans.catalogue_profiles import _SIGNALS, BY, _extreme
from lagweave.plans.catalogue_rules import _M1, _matches, _panel, _quad_sql, _rounded

LEAST_SAMPLES = 5


def least_samples(spark, d):
    """Matches of the rules that have at least so many."""
    m = _matches(spark, d)
    enough = m.groupBy(*BY).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_SAMPLES).select(*BY)
    return m.join(enough, BY).select(*BY, "t", F.round("x1", 6).alias("x1"))


def population_rows(spark, d):
    """The points of each rule, and behind them those of all rules of the instrument, copies kept."""
    m = _matches(spark, d).select("inst", "rule_id", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"))
    return m.withColumn("side", F.lit("foreground")).unionByName(m.withColumn("rule_id", F.lit(None).cast("int")).withColumn("side", F.lit("background")))


def pooled_correlation(spark, d):
    """Both future values over the pooled matches of all rules, copies kept."""
    m = _matches(spark, d).where("x1 IS NOT NULL AND x2 IS NOT NULL")
    got = m.groupBy("inst").agg(F.count(F.lit(1)).alias("n"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.stddev_samp("x1").alias("s1"), F.stddev_samp("x2").alias("s2"), profiles.correlation("x1", "x2").alias("r"))
    return _rounded(got, 5)


def pivot_month_day_mean(spark, d):
    m = _matches(spark, d).select(*BY, F.month("ts").alias("month"), F.concat(F.lit("d"), (F.weekday("ts") + 1).cast("string")).alias("day"), "x1")
    return _rounded(m.groupBy(*BY, "month").pivot("day", [f"d{i}" for i in range(1, 8)]).agg(F.avg("x1")), 4)


def rule_counts(spark, d):
    """Matches of each rule, and the rows that could have been one (without those too near the end)."""
    return _matches(spark, d).groupBy(*BY, "n").agg(F.count(F.lit(1)).alias("support_count")).select(*BY, "support_count", (F.col("n") - 2).alias("negative_count"))


def score_regime(spark, d):
    """Support over the product of the deviations of value and of interval."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*BY).orderBy("t"))
    got = _matches(spark, d).withColumn("gap", gap).groupBy(*BY, "n").agg(F.count(F.lit(1)).alias("c"), F.stddev_samp("x1").alias("s"), F.stddev_samp("gap").alias("gap_sd"))
    return _rounded(got.select(*BY, (F.col("c") / F.col("n") / (F.col("s") * F.col("gap_sd") + 0.01)).alias("score")), 9)


def score_filtered(spark, d):
    """Rules with a support of a tenth at least whose statistic, squared, is significant or absent, by their score with its bonus."""
    chi = F.coalesce(F.col("t_statistic") * F.col("t_statistic"), F.lit(0.0))
    got = pool(spark, d).withColumn("chi", chi).where("support_rate >= 0.1 AND (chi >= 3.84 OR chi = 0)")
    return _rounded(got.select("rule_id", sc.chi_bonus(F.col("support_rate"), F.col("support_count"), F.col("chi")).alias("score")), 6)


def export_top_rules(spark, d):
    """The rules with at least 30 matches, by concentration in percent (quadrants above zero or not), with the statistics of both values; fifty of each instrument."""
    m = _matches(spark, d)
    names = F.create_map(*(F.lit(x) for p in (("Q1", "Q1(++)"), ("Q2", "Q2(+-)"), ("Q3", "Q3(--)"), ("Q4", "Q4(-+)")) for x in p))
    q = quad.concentration(m, BY, "e").where("n >= 30").select(*BY, F.col("n").alias("support"), (100 * F.col("concentration")).alias("concentration"), names[F.col("quadrant")].alias("dominant"), "q1", "q2", "q3", "q4")
    s = m.groupBy(*BY).agg(*(f(f"x{k}").alias(f"{n}_t{k}") for k in (1, 2) for n, f in (("mean", F.avg), ("sigma", F.stddev_samp)))).withColumns({f"abs_mean_t{k}": F.abs(f"mean_t{k}") for k in (1, 2)})
    place = F.row_number().over(Window.partitionBy("inst").orderBy(F.desc("concentration"), "rule_id"))
    return _rounded(q.join(s, BY).withColumn("place", place).where("place <= 50"), 4)


def significance_contrasts(spark, d):
    """Of all rules, the significant ones and the others: number, share, signs of the mean, deviation, ratio of mean to deviation, and how many have a high one."""
    p = pool(spark, d).where("t_statistic IS NOT NULL AND x_mean IS NOT NULL AND x_sigma > 0").withColumn("snr", F.abs("x_mean") / F.col("x_sigma"))
    sides = F.explode(F.array(F.lit("all"), F.when(F.abs("t_statistic") >= 2, "significant").otherwise("other")))
    p = p.withColumn("side", sides)
    mid = quantiles(p, ["side"], "snr", [0.5]).select("side", F.col("value").alias("median_snr"))
    m = F.col("x_mean")
    got = p.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.avg((m > 0).cast("double")).alias("up"), F.avg((m < 0).cast("double")).alias("down"), F.avg(F.abs(m)).alias("mean_abs"), F.avg("x_sigma").alias("mean_sigma"), F.avg("snr").alias("mean_snr"), F.max("snr").alias("max_snr"), F.count_if(F.col("snr") > 0.1).alias("high_snr"),
    )
    return _rounded(got.join(mid, "side"), 6)


def win_rates(spark, d):
    """Per instrument: shares of rules whose mean is positive, and above the series' own; significance against sign; mean ratios."""
    _, s = _panel(spark, d)
    g = s.groupBy("inst").agg(F.avg("x0").alias("g"))
    r = _matches(spark, d).where("x1 IS NOT NULL").groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.avg("x1").alias("m"), F.stddev_samp("x1").alias("s"))
    r = r.where("n > 1").join(g, "inst").withColumn("t", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n"))).withColumn("sure", F.coalesce(F.col("t") * F.col("t") > 3.84, F.lit(False)))
    m, excess = F.col("m"), F.col("m") - F.col("g")
    got = r.groupBy("inst").agg(
        F.count(F.lit(1)).alias("rules"), (100 * F.avg((m > 0).cast("double"))).alias("win_rate"), (100 * F.avg((excess > 0).cast("double"))).alias("outperform_rate"),
        *(F.count_if(a & b).alias(n) for n, a, b in (("sure_up", F.col("sure"), m > 0), ("sure_down", F.col("sure"), m < 0), ("unsure_up", ~F.col("sure"), m > 0), ("unsure_down", ~F.col("sure"), m < 0))),
        F.avg(excess).alias("mean_excess"), F.avg(excess / (F.col("s") + 1e-6)).alias("mean_information"), F.avg(m / (F.col("s") + 1e-6)).alias("mean_sharpe"),
    )
    return _rounded(got, 5)


def top3_by_quality(spark, d):
    """The three rules of each instrument with the greatest ratio of mean to deviation, and their place among all instruments'."""
    p = pool(spark, d).select("symbol", "rule_id", sc.quality(F.col("x_mean"), F.col("x_sigma")).alias("quality")).where("quality IS NOT NULL")
    top = p.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("quality"), "rule_id"))).where("place <= 3")
    return _rounded(top.withColumn("overall", F.row_number().over(Window.orderBy(F.desc("quality"), "rule_id"))), 6)


def assumed_density(spark, d):
    """The normal density on both sides of 0, for a deviation of 1.5 times the greatest local one, where the series itself is not at hand."""
    widest = pool(spark, d).groupBy("symbol").agg((1.5 * F.max("x_sigma")).alias("sigma")).where("sigma > 0")
    got = widest.select("symbol", "sigma", F.explode(F.sequence(F.lit(-40), F.lit(40))).alias("step")).withColumn("z", F.col("step") / 10)
    return _rounded(got.select("symbol", "step", (F.col("z") * F.col("sigma")).alias("x"), (F.exp(-F.col("z") * F.col("z") / 2) / F.col("sigma") / 2.5066282746310002).alias("density")), 8)


def signal_sort_views(spark, d):
    """Rules by extremeness and by the weighted score of extreme signals, ten each."""
    got = _extreme(spark, d).withColumn("p", F.when(F.col("n") > 1, t_p_value(F.col("t_stat"), F.col("n") - 1)).otherwise(1.0))
    got = got.withColumn("score", 10 * F.col("strength") + 5 * F.col("snr") + 3 * F.col("extremeness") + 2 * (1 - F.col("p")) + 5 * F.col("tail_rate"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("sort_by"), F.col(n).alias("v")) for n in ("extremeness", "score"))))
    long = got.select(*BY, each.alias("e")).select(*BY, "e.sort_by", "e.v").where("v IS NOT NULL")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("sort_by").orderBy(F.desc("v"), *BY))).where("place <= 10").select("sort_by", "place", *BY)


def shared_ranks(spark, d):
    """The number of rules of the pool with greater support; equal ones share it."""
    p = pool(spark, d).where("support_count IS NOT NULL")
    return p.select("pool_id", "rule_id", (F.rank().over(Window.partitionBy("pool_id").orderBy(F.desc("support_count"))) - 1).alias("ahead"))


def two_phase(spark, d):
    """Pairs mined on the rows whose next two values are both positive enough, numbered anew, then validated on the whole series.

    The axes of the targets differ after the first step, so that the instrument is part of every key.
    """
    good, delays = (F.col("x1") >= 0.1) & (F.col("x2") >= 0.1), 3
    items, series = _panel(spark, d)
    kept = series.where(good).select("inst", "i", (F.row_number().over(Window.partitionBy("inst").orderBy("i")) - 1).alias("j"), F.count(F.lit(1)).over(Window.partitionBy("inst")).alias("m"))
    lag = lambda df, at: df.select("inst", "attr", *(["m"] if "m" in df.columns else []), F.col(at), F.explode(F.array(*map(F.lit, range(delays + 1)))).alias("delay")).withColumn("t", F.col(at) + F.col("delay")).drop(at)
    one = lag(kept.join(items, "i"), "j").where((F.col("t") >= delays) & (F.col("t") < F.col("m")))
    least = 0.1 * (F.col("m") - delays)
    often = one.groupBy("inst", "attr", "delay", "m").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("inst", "attr", "delay")
    one = one.join(often, ["inst", "attr", "delay"])
    side = lambda df, k: df.select("inst", "t", F.col("attr").alias(f"a{k}"), F.col("delay").alias(f"d{k}"), *(["m"] if k == 1 and "m" in df.columns else []))
    pair = ["inst", "a1", "d1", "a2", "d2"]
    mined = side(one, 1).join(side(one, 2), ["inst", "t"]).where("a1 < a2").groupBy(*pair, "m").agg(F.count(F.lit(1)).alias("subset_matches")).where(F.col("subset_matches") >= least).drop("m")
    # Only what was mined is matched on the whole series.
    rows = lag(items.join(series.select("inst", "i", "n", "x1", "x2"), "i").withColumn("m", F.struct("n", "x1", "x2")), "i")
    used = mined.select("inst", F.explode(F.array(F.struct(F.col("a1").alias("attr"), F.col("d1").alias("delay")), F.struct(F.col("a2").alias("attr"), F.col("d2").alias("delay")))).alias("c")).select("inst", "c.*").distinct()
    rows = rows.join(used, ["inst", "attr", "delay"])
    future = series.select("inst", F.col("i").alias("t"), "n", "x1", "x2").where(F.col("i") < F.col("n") - 2)
    met = side(rows.drop("m"), 1).join(mined, ["inst", "a1", "d1"]).join(side(rows.drop("m"), 2), ["inst", "t", "a2", "d2"]).join(future, ["inst", "t"])
    got = met.groupBy(*pair, "subset_matches", "n").agg(F.count(F.lit(1)).alias("total_matches"), F.count_if(good).alias("q1_matches"))
    precision = F.col("q1_matches") / F.col("total_matches")
    return _rounded(got.select(*pair, "subset_matches", "total_matches", precision.alias("precision"), (F.col("total_matches") / F.col("n")).alias("full_support"), (precision >= 0.32).cast("int").alias("accepted")), 6)


QUERIES = {
    f.__name__: f
    for f in (
        least_samples, population_rows, pooled_correlation, pivot_month_day_mean, rule_counts, score_regime, score_filtered, export_top_rules, significance_contrasts, win_rates, top3_by_quality, assumed_density, signal_sort_views, shared_ranks, two_phase,
    )
}

ORACLE = {
    "least_samples": _M1 + "SELECT inst, rule_id, t, round(x1, 6) AS x1 FROM m QUALIFY count(*) OVER (PARTITION BY inst, rule_id) >= 5",
    "population_rows": _M1 + "SELECT inst, rule_id, round(x1, 4) AS x1, round(x2, 4) AS x2, 'foreground' AS side FROM m UNION ALL SELECT inst, NULL, round(x1, 4), round(x2, 4), 'background' FROM m",
    "pooled_correlation": _M1 + "SELECT inst, count(*) AS n, round(avg(x1), 5) AS m1, round(avg(x2), 5) AS m2, round(stddev_samp(x1), 5) AS s1, round(stddev_samp(x2), 5) AS s2, round(corr(x1, x2), 5) AS r FROM m WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY inst",
    "pivot_month_day_mean": _M1 + "SELECT inst, rule_id, month(ts)::INT AS month, " + ", ".join(f"round(avg(x1) FILTER (isodow(ts) = {i}), 4) AS d{i}" for i in range(1, 8)) + " FROM m GROUP BY ALL",
    "rule_counts": _M1 + "SELECT inst, rule_id, count(*) AS support_count, n - 2 AS negative_count FROM m GROUP BY inst, rule_id, n",
    "score_regime": _M1 + ", e AS (SELECT *, t - lag(t) OVER (PARTITION BY inst, rule_id ORDER BY t) AS gap FROM m) SELECT inst, rule_id, round(count(*) / n / (stddev_samp(x1) * stddev_samp(gap) + 0.01), 9) AS score FROM e GROUP BY inst, rule_id, n",
    "score_filtered": _P + ", c AS (SELECT *, coalesce(t_statistic * t_statistic, 0) AS chi FROM pool) SELECT rule_id, round(support_rate * support_count * (1 + chi / 10), 6) AS score FROM c WHERE support_rate >= 0.1 AND (chi >= 3.84 OR chi = 0)",
    "export_top_rules": _M1
    + f""", q AS {_quad_sql('e', 'm', 'inst, rule_id')}, s AS (SELECT inst, rule_id, avg(x1) AS m1, stddev_samp(x1) AS s1, avg(x2) AS m2, stddev_samp(x2) AS s2 FROM m GROUP BY ALL)
SELECT inst, rule_id, n AS support, round(100 * concentration, 4) AS concentration, CASE quadrant WHEN 'Q1' THEN 'Q1(++)' WHEN 'Q2' THEN 'Q2(+-)' WHEN 'Q3' THEN 'Q3(--)' ELSE 'Q4(-+)' END AS dominant, q1, q2, q3, q4,
  round(m1, 4) AS mean_t1, round(s1, 4) AS sigma_t1, round(m2, 4) AS mean_t2, round(s2, 4) AS sigma_t2, round(abs(m1), 4) AS abs_mean_t1, round(abs(m2), 4) AS abs_mean_t2,
  row_number() OVER (PARTITION BY inst ORDER BY q.concentration DESC, rule_id) AS place FROM q JOIN s USING (inst, rule_id) WHERE n >= 30 QUALIFY place <= 50""",
    "significance_contrasts": _P
    + """, p AS (SELECT *, abs(x_mean) / x_sigma AS snr FROM pool WHERE t_statistic IS NOT NULL AND x_mean IS NOT NULL AND x_sigma > 0),
e AS (SELECT *, 'all' AS side FROM p UNION ALL SELECT *, CASE WHEN abs(t_statistic) >= 2 THEN 'significant' ELSE 'other' END FROM p)
SELECT side, count(*) AS n, round(avg((x_mean > 0)::INT), 6) AS up, round(avg((x_mean < 0)::INT), 6) AS down, round(avg(abs(x_mean)), 6) AS mean_abs, round(avg(x_sigma), 6) AS mean_sigma, round(avg(snr), 6) AS mean_snr, round(max(snr), 6) AS max_snr,
  count(*) FILTER (snr > 0.1) AS high_snr, round(median(snr), 6) AS median_snr FROM e GROUP BY side""",
    "win_rates": _M1
    + """, g AS (SELECT inst, avg(x0) AS g FROM series GROUP BY inst), r AS (SELECT inst, rule_id, count(*) AS n, avg(x1) AS mu, stddev_samp(x1) AS s FROM m WHERE x1 IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
q AS (SELECT *, mu - g AS ex, coalesce(pow(mu / nullif(s / sqrt(n), 0), 2) > 3.84, false) AS sure FROM r JOIN g USING (inst))
SELECT inst, count(*) AS rules, round(100 * avg((mu > 0)::INT), 5) AS win_rate, round(100 * avg((ex > 0)::INT), 5) AS outperform_rate, count(*) FILTER (sure AND mu > 0) AS sure_up, count(*) FILTER (sure AND mu < 0) AS sure_down,
  count(*) FILTER (NOT sure AND mu > 0) AS unsure_up, count(*) FILTER (NOT sure AND mu < 0) AS unsure_down, round(avg(ex), 5) AS mean_excess, round(avg(ex / (s + 1e-6)), 5) AS mean_information, round(avg(mu / (s + 1e-6)), 5) AS mean_sharpe FROM q GROUP BY inst""",
    "top3_by_quality": _P
    + """, q AS (SELECT symbol, rule_id, abs(x_mean) / nullif(x_sigma, 0) AS v FROM pool), t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, rule_id) AS place FROM q WHERE v IS NOT NULL QUALIFY place <= 3)
SELECT symbol, rule_id, round(v, 6) AS quality, place, row_number() OVER (ORDER BY v DESC, rule_id) AS overall FROM t""",
    "assumed_density": _P
    + """, w AS (SELECT symbol, 1.5 * max(x_sigma) AS sigma FROM pool GROUP BY symbol HAVING max(x_sigma) > 0), e AS (SELECT symbol, sigma, unnest(range(-40, 41))::INT AS step FROM w)
SELECT symbol, step, round(step / 10 * sigma, 8) AS x, round(exp(-(step / 10) * (step / 10) / 2) / sigma / 2.5066282746310002::DOUBLE, 8) AS density FROM e""",
    "signal_sort_views": _M1.replace("h.t < s.n - 2", "h.t < s.n - 0")
    + _SIGNALS
    + ", e AS (SELECT inst, rule_id, 'extremeness' AS sort_by, extremeness AS v FROM z UNION ALL SELECT inst, rule_id, 'score', score FROM z) SELECT sort_by, row_number() OVER (PARTITION BY sort_by ORDER BY v DESC, inst, rule_id) AS place, inst, rule_id FROM e WHERE v IS NOT NULL QUALIFY place <= 10",
    "shared_ranks": _P + "SELECT pool_id, rule_id, rank() OVER (PARTITION BY pool_id ORDER BY support_count DESC) - 1 AS ahead FROM pool WHERE support_count IS NOT NULL",
    "two_phase": PANEL_SQL
    + """, kept AS (SELECT inst, i, row_number() OVER (PARTITION BY inst ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY inst) AS m FROM series WHERE x1 >= 0.1 AND x2 >= 0.1),
o AS (SELECT k.inst, k.m, x.attr, d.delay, k.j + d.delay AS t FROM kept k JOIN items x USING (i), (SELECT unnest(range(4)) AS delay) d WHERE k.j + d.delay BETWEEN 3 AND k.m - 1),
mined AS (SELECT a.inst, a.attr AS a1, a.delay AS d1, b.attr AS a2, b.delay AS d2, count(*) AS subset_matches FROM o a JOIN o b ON a.inst = b.inst AND a.t = b.t AND a.attr < b.attr GROUP BY a.inst, a.m, a.attr, a.delay, b.attr, b.delay HAVING count(*) >= 0.1 * (a.m - 3)),
w AS (SELECT x.attr, d.delay, x.i + d.delay AS t FROM items x, (SELECT unnest(range(4)) AS delay) d)
SELECT s.inst, a1, d1::INT AS d1, a2, d2::INT AS d2, subset_matches, count(*) AS total_matches, round(count(*) FILTER (x1 >= 0.1 AND x2 >= 0.1) / count(*), 6) AS precision, round(count(*) / n, 6) AS full_support, (count(*) FILTER (x1 >= 0.1 AND x2 >= 0.1) / count(*) >= 0.32)::INT AS accepted
FROM mined JOIN w a ON a.attr = a1 AND a.delay = d1 JOIN w b ON b.attr = a2 AND b.delay = d2 AND b.t = a.t JOIN series s ON s.inst = mined.inst AND s.i = a.t WHERE s.i < s.n - 2 GROUP BY s.inst, a1, d1, a2, d2, subset_matches, n""",
}
