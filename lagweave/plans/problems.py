"""Queries of the general problems 1, 3 and 5, and what an SQL engine gives for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators.regular_grid import regular_grid
from lagweave.operators.rolling_totals import rolling_totals
from lagweave.operators.spikes import feed_rows, flag_values, measure_rows
from lagweave.session import table

IMPOSSIBLE_BELOW = -100.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods without a reading. Each is reported from its finished row: either it has its filled value or is marked as missing."""
    grid = regular_grid(table(spark, sf_dir, "usdjpy"), least=IMPOSSIBLE_BELOW)
    return grid.where((F.col("status") != "observed") & (F.col("n_readings") == 0) & (F.col("x").isNotNull() | (F.col("status") == "missing"))).select("feed", "period_start")


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole regular series."""
    return regular_grid(table(spark, sf_dir, "usdjpy"), least=IMPOSSIBLE_BELOW).select("feed", "bar_minutes", "period_start", "status", "n_readings", F.when(F.col("status") == "observed", F.round("x", 6)).alias("observed_x"), F.col("x").isNotNull().alias("has_x"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = flag_values(feed_rows(table(spark, sf_dir, "usdjpy")), IMPOSSIBLE_BELOW, order="us")
    feeds = feeds.where("impossible OR far OR stuck").select(F.lit("usdjpy").alias("src_table"), F.col("id").alias("row_id"))
    ranking = table(spark, sf_dir, "nikkei225_volatility_ranking")
    marks = flag_values(measure_rows(ranking, "stock_code", ["max_x", "min_x"], "row_id", "ranked_at"), IMPOSSIBLE_BELOW)
    marks = marks.where("impossible OR far").select("id")
    crossed = ranking.where("min_x > max_x AND min_x < double('Infinity') AND max_x >= -100").select(F.col("row_id").alias("id"))
    ranks = marks.unionByName(crossed).distinct().select(F.lit("nikkei225_volatility_ranking").alias("src_table"), F.col("id").alias("row_id"))
    return feeds.unionByName(ranks)


def p1_trend_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled periods of a model with trend alone, bridged residuals included. Values lie on straight lines between values of two decimals, often half way
    between two of four; a ten millionth more rounds them alike in any engine.
    """
    grid = regular_grid(table(spark, sf_dir, "usdjpy"), daily=0, weekly=0, least=IMPOSSIBLE_BELOW).where("status IN ('filled', 'repaired')")
    return grid.select("feed", "period_start", "status", F.round(F.col("x") + 1e-7, 4).alias("x"), F.round(F.col("x_fitted") + 1e-7, 4).alias("x_fitted"))


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a feed with any flag, and its flags."""
    flags = ["impossible", "fenced", "far", "rate", "stuck"]
    got = flag_values(feed_rows(table(spark, sf_dir, "usdjpy")), IMPOSSIBLE_BELOW, order="us")
    return got.where(" OR ".join(flags)).select(F.col("id").alias("row_id"), *flags)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a reading. Each is reported from its finished row: a window has its total, or no finite value."""
    days = rolling_totals(table(spark, sf_dir, "usdjpy"))
    done = F.lit(True)
    for w in (7, 30):
        done = done & (F.col(f"sum_{w}d").isNotNull() & F.col(f"mean_{w}d").isNotNull() | (F.col(f"n_{w}d") == 0))
    return days.where((F.col("n_readings") == 0) & done).select("feed", "day_utc")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = rolling_totals(table(spark, sf_dir, "usdjpy"))
    return days.select("feed", "day_utc", "n_readings", *(c for w in (7, 30) for c in (f"n_{w}d", F.round(f"sum_{w}d", 6).alias(f"sum_{w}d"), (F.round(f"sum_{w}d", 6) / F.col(f"n_{w}d")).alias(f"mean_{w}d"))))


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_trend_fill": p1_trend_fill, "p3_found": p3_found, "p3_flags": p3_flags, "p5_found": p5_found, "p5_totals": p5_totals}

READINGS_SQL = r"""
WITH parsed AS (
  SELECT feed, bar_minutes::BIGINT AS bar, x, row_id, arrived_at,
         epoch_us(try_cast(replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '/', '-') AS TIMESTAMPTZ)) AS us
  FROM usdjpy WHERE x IS NOT NULL),
r AS (
  SELECT * FROM parsed WHERE us IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY feed, us ORDER BY arrived_at DESC NULLS LAST, row_id DESC) = 1)
"""

GRID_SQL = READINGS_SQL + """,
per AS (
  SELECT feed, bar, us // (bar * 60000000) AS p, count(*) AS n,
         avg(CASE WHEN isfinite(x) AND x >= -100 THEN x END) AS v FROM r GROUP BY ALL),
ends AS (SELECT feed, bar, min(p) AS a, max(p) AS b, count(v) AS any_v FROM per GROUP BY ALL),
grid AS (SELECT feed, bar, any_v, unnest(range(a, b + 1)) AS p FROM ends)
"""

FAR_SQL = """
  SELECT {id} FROM (
    SELECT v.*, median(abs(x - med)) OVER (PARTITION BY k) AS mad FROM (
      SELECT s.*, median(x) OVER (PARTITION BY k) AS med FROM {rows} s) v) w
  WHERE abs(x - med) > 15 * mad
"""

ROLLING_SQL = READINGS_SQL + """,
daily AS (
  SELECT feed, us // 86400000000 AS d, count(*) AS n_readings, count(*) FILTER (isfinite(x)) AS n, sum(x) FILTER (isfinite(x)) AS s
  FROM r GROUP BY ALL),
ends AS (SELECT feed, min(d) AS a, max(d) AS b FROM daily GROUP BY ALL),
dense AS (
  SELECT g.feed, g.d, coalesce(n_readings, 0) AS n_readings, coalesce(n, 0) AS n, coalesce(s, 0) AS s
  FROM (SELECT feed, unnest(range(a, b + 1)) AS d FROM ends) g LEFT JOIN daily USING (feed, d))
"""

ORACLE = {
    "p1_found": GRID_SQL + "SELECT g.feed, strftime(make_timestamp(g.p * g.bar * 60000000), '%Y-%m-%d %H:%M:%S') AS period_start FROM grid g ANTI JOIN per USING (feed, p)",
    "p1_grid": GRID_SQL
    + """SELECT g.feed, g.bar::INT AS bar_minutes, strftime(make_timestamp(g.p * g.bar * 60000000), '%Y-%m-%d %H:%M:%S') AS period_start,
  CASE WHEN per.v IS NOT NULL THEN 'observed' WHEN per.n IS NOT NULL THEN 'repaired' WHEN any_v > 0 THEN 'filled' ELSE 'missing' END AS status,
  coalesce(per.n, 0) AS n_readings, round(per.v, 6) AS observed_x, any_v > 0 AS has_x
  FROM grid g LEFT JOIN per USING (feed, p)""",
    "p1_trend_fill": GRID_SQL
    + """, fit AS (SELECT feed, bar, regr_slope(v, p * bar / 1440 - 10957) AS b, regr_intercept(v, p * bar / 1440 - 10957) AS a, avg(v) AS mu FROM per WHERE v IS NOT NULL GROUP BY ALL),
val AS (SELECT feed, bar, p, v, v - coalesce(a + b * (p * bar / 1440 - 10957), mu) AS res FROM per JOIN fit USING (feed, bar) WHERE v IS NOT NULL),
cells AS (SELECT g.feed, g.bar, g.p, per.n, coalesce(a + b * (g.p * g.bar / 1440 - 10957), mu) AS fitted, any_v FROM grid g LEFT JOIN per USING (feed, p) LEFT JOIN fit ON fit.feed = g.feed WHERE per.v IS NULL),
l AS (SELECT c.*, v.p AS lp, v.res AS lr FROM cells c ASOF LEFT JOIN val v ON c.feed = v.feed AND c.p >= v.p),
b AS (SELECT l.*, v.p AS rp, v.res AS rr FROM l ASOF LEFT JOIN val v ON l.feed = v.feed AND l.p <= v.p)
SELECT feed, strftime(make_timestamp(p * bar * 60000000), '%Y-%m-%d %H:%M:%S') AS period_start, CASE WHEN n IS NOT NULL THEN 'repaired' ELSE 'filled' END AS status,
  round(fitted + CASE WHEN lr IS NULL THEN rr WHEN rr IS NULL THEN lr ELSE lr + (rr - lr) * (p - lp) / (rp - lp) END + 1e-7::DOUBLE, 4) AS x, round(fitted + 1e-7::DOUBLE, 4) AS x_fitted FROM b WHERE n IS NOT NULL OR any_v > 0""",
    "p3_flags": READINGS_SQL
    + """, g AS (SELECT feed, us, row_id, x, (us % 86400000000) // 3600000000 AS hour, lag(x) OVER w AS px, lag(us) OVER w AS pus, coalesce(isfinite(x) AND x >= -100, false) AS good FROM r WINDOW w AS (PARTITION BY feed ORDER BY us)),
c AS (SELECT feed, hour, CASE WHEN x = 0 THEN 0 WHEN x > 0 THEN floor(ln(x) / ln(2) * 64) + 76800 ELSE -(floor(ln(-x) / ln(2) * 64) + 76800) END AS cell, count(*) AS n, min(x) AS lo, max(x) AS hi FROM g WHERE good GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY feed, hour) AS total, sum(n) OVER (PARTITION BY feed, hour ORDER BY cell) - n AS below FROM c),
q AS (SELECT feed, hour, max(lo) FILTER (below <= floor((total - 1) * 0.25) AND floor((total - 1) * 0.25) < below + n) AS q1, max(hi) FILTER (below <= floor((total - 1) * 0.75) AND floor((total - 1) * 0.75) < below + n) AS q3 FROM k GROUP BY ALL),
i AS (SELECT feed, max(q3 - q1) AS iqr FROM q GROUP BY feed),
d AS (SELECT row_id, abs(x - med) > 15 * median(abs(x - med)) OVER (PARTITION BY feed) AS far FROM (SELECT *, median(x) OVER (PARTITION BY feed) AS med FROM g WHERE good)),
chained AS (SELECT *, CASE WHEN px IS NOT DISTINCT FROM x AND pus IS NOT NULL THEN 0 ELSE 1 END AS ch FROM g), runs AS (SELECT *, sum(ch) OVER (PARTITION BY feed ORDER BY us) AS run FROM chained),
s AS (SELECT row_id, count(*) OVER (PARTITION BY feed, run) AS len FROM runs),
f AS (SELECT g.row_id, NOT good AS impossible, coalesce(good AND (x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)), false) AS fenced, coalesce(far, false) AS far,
  coalesce(good AND isfinite(px) AND abs(x - px) / greatest((us - pus) / 3600000000, 1.0) > 20 * iqr, false) AS rate, good AND x <> 0 AND len >= 6 AS stuck
  FROM g JOIN s USING (row_id) LEFT JOIN d USING (row_id) LEFT JOIN q ON q.feed IS NOT DISTINCT FROM g.feed AND q.hour = g.hour LEFT JOIN i ON i.feed IS NOT DISTINCT FROM g.feed)
SELECT * FROM f WHERE impossible OR fenced OR far OR rate OR stuck""",
    "p3_found": READINGS_SQL
    + f""",
good AS (SELECT feed AS k, row_id, x FROM r WHERE isfinite(x) AND x >= -100),
chained AS (SELECT feed, row_id, us, x, CASE WHEN lag(x) OVER w IS NOT DISTINCT FROM x THEN 0 ELSE 1 END AS c FROM r WINDOW w AS (PARTITION BY feed ORDER BY us)),
runs AS (SELECT *, sum(c) OVER (PARTITION BY feed ORDER BY us) AS g FROM chained),
stuck AS (SELECT row_id, x, count(*) OVER (PARTITION BY feed, g) AS n FROM runs),
m AS (SELECT 'max|' || stock_code AS k, row_id, max_x AS x FROM nikkei225_volatility_ranking WHERE max_x IS NOT NULL
      UNION ALL SELECT 'min|' || stock_code, row_id, min_x FROM nikkei225_volatility_ranking WHERE min_x IS NOT NULL),
mgood AS (SELECT * FROM m WHERE isfinite(x) AND x >= -100)
SELECT 'usdjpy' AS src_table, row_id FROM (
  SELECT row_id FROM r WHERE NOT isfinite(x) OR x < -100
  UNION SELECT row_id FROM stuck WHERE n >= 6 AND x <> 0
  UNION {FAR_SQL.format(id="row_id", rows="good")})
UNION ALL
SELECT 'nikkei225_volatility_ranking', row_id FROM (
  SELECT row_id FROM m WHERE NOT isfinite(x) OR x < -100
  UNION SELECT row_id FROM nikkei225_volatility_ranking WHERE isfinite(min_x) AND isfinite(max_x) AND max_x >= -100 AND min_x > max_x
  UNION {FAR_SQL.format(id="row_id", rows="mgood")})
""",
    "p5_found": ROLLING_SQL + "SELECT feed, strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS day_utc FROM dense WHERE n_readings = 0",
    "p5_totals": ROLLING_SQL
    + """SELECT feed, strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS day_utc, n_readings,
  sum(n) OVER w7 AS n_7d, round(CASE WHEN sum(n) OVER w7 > 0 THEN sum(s) OVER w7 END, 6) AS sum_7d, round(CASE WHEN sum(n) OVER w7 > 0 THEN sum(s) OVER w7 END, 6) / nullif(sum(n) OVER w7, 0) AS mean_7d,
  sum(n) OVER w30 AS n_30d, round(CASE WHEN sum(n) OVER w30 > 0 THEN sum(s) OVER w30 END, 6) AS sum_30d, round(CASE WHEN sum(n) OVER w30 > 0 THEN sum(s) OVER w30 END, 6) / nullif(sum(n) OVER w30, 0) AS mean_30d
  FROM dense WINDOW w7 AS (PARTITION BY feed ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY feed ORDER BY d ROWS 29 PRECEDING)""",
}
