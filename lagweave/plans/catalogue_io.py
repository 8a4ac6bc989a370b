"""Sources and sinks: each query writes a format with this package's writer, reads it back with the reader, and gives what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lagweave.functions import quadrants as quad
from lagweave.operators import matching as mt
from lagweave.operators import prep
from lagweave.operators.panels import EVENTS_SQL, PANEL_SQL, event_prices, order_prices, order_returns
from lagweave.operators.rules import conditions
from lagweave.plans import catalogue_pool, catalogue_prep
from lagweave.plans.catalogue_rules import _CONDS_SQL, _M1, _matches, _panel, _quad_sql, _rounded, _with_depth, rules_of, verification_rows
from lagweave.plans.catalogue_rules import ORACLE as RULES_SQL
from lagweave.session import ensure_checkpoint_dir
from lagweave.sources import readers, writers


def _place(spark) -> str:
    """A new folder beside the intermediate tables, which goes with the session."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _written_table(spark, d):
    at = _place(spark)
    writers.write_wide(catalogue_prep.prep_wide(spark, d).drop("i"), at)
    return readers.mining_table(spark, at)


def io_mining_table(spark, d):
    return _written_table(spark, d).drop("ts")


def io_table_items(spark, d):
    return readers.table_items(_written_table(spark, d))


def io_prices(spark, d):
    """A wide table of closes, one column per instrument."""
    p, at = order_prices(spark, d), _place(spark)
    writers.write_wide(p.groupBy(F.col("ts").alias("timestamp")).pivot("inst").agg(F.max("price")), at)
    return readers.price_table(spark, at)


def io_klines(spark, d):
    """Candles in two pages that overlap by a day in three, the second with the right closes."""
    p, at = event_prices(spark, d), _place(spark)
    ms = F.unix_millis(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    third = F.pmod(F.dayofyear("ts"), F.lit(3))
    close = lambda c: [ms.alias("open_ms"), *(c.alias(n) for n in ("open", "high", "low", "close")), *(F.lit(0.0).alias(n) for n in ("volume", "close_ms", "quote_volume", "trades", "taker_base", "taker_quote", "ignored"))]
    one = p.where(third < 2).select("inst", F.lit(1).alias("page"), *close(F.when(third == 1, -1.0).otherwise(F.col("price"))))
    two = p.where(third > 0).select("inst", F.lit(2).alias("page"), *close(F.col("price")))
    one.unionByName(two).withColumns({n: F.lit(0).cast("long") for n in ("close_ms", "trades")}).write.partitionBy("inst", "page").csv(at)
    return readers.klines(spark, at).where("price IS NOT NULL")


def _pool(spark, d):
    """The fixed rules with their statistics, one pool per instrument."""
    m = _matches(spark, d)
    q = quad.concentration(m, ["inst", "rule_id"], "b").select("inst", "rule_id", "quadrant", "concentration")
    return mt.rule_stats(_with_depth(spark, m)).drop("max_d").join(q, ["inst", "rule_id"]).join(rules_of(spark), "rule_id")


def io_rule_pool(spark, d):
    """Pools of single instruments as tab-separated text, read together; a pool that is absent is left out."""
    at, full = _place(spark), _pool(spark, d)
    writers.write_pool(full, at)
    got = readers.rule_pool(spark, [f"{at}/*.csv", f"{at}/absent/*.csv"])
    names = {f"X(t+{k})_{s}": f"x{k}_{s}" for k in (1, 2) for s in ("mean", "sigma", "min", "max")}
    return got.select(*(f"Attr{i}" for i in range(1, 9)), *(F.col(f"`{a}`").alias(b) for a, b in names.items()), "support_count", "support_rate", "Quadrant", F.col("Concentration").alias("conc"), F.col("NumAttr").alias("k"))


def io_pool_summary(spark, d):
    pool = catalogue_pool.pool(spark, d).where("support_rate IS NOT NULL AND concentration IS NOT NULL AND quadrant IS NOT NULL")
    return writers.pool_summary(pool)


def io_matches(spark, d):
    """Verification rows in one folder per rule."""
    at = _place(spark)
    writers.write_matches(verification_rows(spark, d), at)
    return readers.match_table(spark, at)


def io_match_files(spark, d):
    at = _place(spark)
    rows = _matches(spark, d, "m4").select("rule_id", "inst", F.col("t").alias("RowIndex"), F.round("x1", 2).alias("X(t+1)"), F.round("x2", 2).alias("X(t+2)"))
    writers.write_match_files(rows, at)
    return readers.match_files(spark, f"{at}/*/*.csv").select("rule_id", "inst", F.col("RowIndex").cast("long").alias("t"), F.col("`X(t+1)`").alias("x1"), F.col("`X(t+2)`").alias("x2"))


def io_rules_with_matches(spark, d):
    """Rules joined with their stored matches; rules without any are left out."""
    at = _place(spark)
    writers.write_matches(_matches(spark, d).select("rule_id", "inst", "t", "x1"), at)
    got = rules_of(spark).select("rule_id", "k").join(readers.match_table(spark, at), "rule_id")
    return _rounded(got.groupBy("rule_id", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("x1").alias("mean_x1")), 4)


def io_headerless(spark, d):
    """Lines without a header whose second-last field is the value."""
    at = _place(spark)
    r = order_returns(spark, d)
    r.select(F.col("inst").alias("series"), F.concat_ws(",", F.lit("0"), F.coalesce(F.col("x").cast("string"), F.lit("n/a")), F.date_format("ts", "yyyy-MM-dd")).alias("value")).repartition("series").write.partitionBy("series").text(at)
    got = readers.headerless(spark, at)
    return got.select(F.round("x", 6).alias("x"))


def io_block_report(spark, d):
    """A text report of one block per rule, its conditions as rows."""
    at = _place(spark)
    c = conditions(rules_of(spark)).groupBy("rule_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "attr", "delay"))), lambda x: F.concat(x["attr"], F.lit(" | "), x["delay"].cast("string"))), "\n").alias("rows"))
    c.select(F.concat(F.lit("Rule "), F.col("rule_id").cast("string"), F.lit(":\n------\n"), F.col("rows"), F.lit("\n======")).alias("value")).write.text(at)
    return readers.block_report(spark, at).select("rule", F.array_join("cells", "|").alias("cells"))


def io_simulation(spark, d):
    """A made-up series, and how many rows of a simulated rule there are in and outside its months and weekdays."""
    got = readers.simulated_matches(readers.synthetic_prices(spark, ["A", "B"], 1_500), [1, 4, 7], [2, 3], 50)
    outside = ~(F.month("ts").isin(1, 4, 7) & (F.weekday("ts") + 1).isin(2, 3))
    return got.groupBy("inst").agg(F.count(F.lit(1)).alias("picked"), F.countDistinct("ts").alias("times"), F.count_if(outside).alias("outside"))


def io_ranked(spark, d):
    at = _place(spark)
    writers.write_ranked(catalogue_pool.instrument_top10(spark, d), at)
    return spark.read.csv(at, header=True, schema="symbol string, rule_id long, support_count int, support_rate double, x_mean double, x_sigma double, place int")


def io_extremes(spark, d):
    """The rows beyond a threshold, in one file set for each side."""
    at = _place(spark)
    prep.extremes(order_returns(spark, d), 1.0).select("inst", "i", F.col("x"), "side").write.partitionBy("side").option("header", True).csv(at)
    got = spark.read.csv(at, header=True, schema="inst string, i long, x double, side string")
    return got.select("inst", "i", F.round("x", 6).alias("x"), "side")


def new_rules_only(spark, d):
    """Mined rules that a stored pool does not hold yet, delays counting: of all that pass, those under a concentration of 0.47, which the pool begins with."""
    from dataclasses import replace

    from lagweave.plans.catalogue_rules import PARAMS, _mined

    at = _place(spark)
    _mined(spark, d, 2, replace(PARAMS, min_concentration=0.47)).where("reject_reason = 'passed'").select("inst", "a1", "d1", "a2", "d2").write.parquet(at)
    return _mined(spark, d, 2).where("reject_reason = 'passed'").join(spark.read.parquet(at), ["inst", "a1", "d1", "a2", "d2"], "left_anti").select("inst", "rule", "n")


QUERIES = {
    f.__name__: f
    for f in (
        io_mining_table, io_table_items, io_prices, io_klines, io_rule_pool, io_pool_summary, io_matches, io_match_files, io_rules_with_matches, io_headerless, io_block_report, io_simulation, io_ranked, io_extremes, new_rules_only,
    )
}

_WIDE = catalogue_prep.ORACLE["prep_wide"]
_STATS = ", ".join(f"printf('%.3f', {e}(x{h}))::DOUBLE AS x{h}_{n}" for h in (1, 2) for n, e in (("mean", "avg"), ("sigma", "stddev_pop"), ("min", "min"), ("max", "max")))


def _new_sql():
    from dataclasses import replace

    from lagweave.plans.catalogue_rules import PARAMS, _level_sql

    strict = _level_sql(2, replace(PARAMS, min_concentration=0.47)) + "SELECT inst, rule FROM mined WHERE reject_reason = 'passed'"
    return _level_sql(2) + f"SELECT inst, rule, n FROM mined WHERE reject_reason = 'passed' AND (inst, rule) NOT IN (SELECT (inst, rule) FROM ({strict}))"


ORACLE = {
    "io_mining_table": f"SELECT * EXCLUDE (i, X), coalesce(X, 0.0) AS X FROM ({_WIDE})",
    "io_table_items": PANEL_SQL + "SELECT i - 1 AS i, attr FROM items WHERE i >= 1",
    "io_prices": PANEL_SQL + "SELECT inst, ts, price FROM prices WHERE price IS NOT NULL",
    "io_klines": EVENTS_SQL + "SELECT inst, ts, price FROM prices WHERE price IS NOT NULL",
    "io_rule_pool": _M1
    + f""", ids AS (SELECT unnest(range(1, 21))::INT AS rule_id), w AS (SELECT rule_id, list(attr || '(t-' || delay || ')' ORDER BY pos) AS c FROM conds GROUP BY rule_id), q AS {_quad_sql('b', 'm', 'inst, rule_id')},
s AS (SELECT inst, rule_id, {_STATS}, count(*)::DOUBLE AS support_count, printf('%.4f', count(*) / (n - max_d - 2))::DOUBLE AS support_rate FROM m GROUP BY inst, rule_id, n, max_d)
SELECT {", ".join(f"coalesce(c[{i}], '0') AS Attr{i}" for i in range(1, 9))}, s.* EXCLUDE (inst, rule_id), quadrant AS Quadrant, printf('%.3f', concentration)::DOUBLE AS conc, len(c)::DOUBLE AS k FROM s JOIN q USING (inst, rule_id) JOIN w USING (rule_id)""",
    "io_pool_summary": catalogue_pool._P
    + """, p AS (SELECT * FROM pool WHERE support_rate IS NOT NULL AND concentration IS NOT NULL AND quadrant IS NOT NULL)
SELECT 0 AS place, 'Rules: ' || count(*) || ', greatest support ' || coalesce(max(support_count), 0) AS line FROM p UNION ALL (SELECT row_number() OVER (ORDER BY support_count DESC, rule_id)::INT,
  printf('Rule %s: support %s (%.4f), concentration %.3f, %s', rule_id::VARCHAR, support_count::VARCHAR, support_rate, concentration, quadrant) FROM p ORDER BY support_count DESC, rule_id LIMIT 10)""",
    "io_matches": RULES_SQL["verification_rows"],
    "io_match_files": _M1.replace("h.t < s.n - 2", "h.t < s.n - 0") + "SELECT rule_id, inst, t, round(x1, 2) AS x1, round(x2, 2) AS x2 FROM m",
    "io_rules_with_matches": _M1 + "SELECT rule_id, k, count(*) AS n, round(avg(x1), 4) AS mean_x1 FROM m JOIN rules USING (rule_id) GROUP BY rule_id, k",
    "io_headerless": PANEL_SQL + "SELECT round(x, 6) AS x FROM rets WHERE x IS NOT NULL AND inst IN (SELECT inst FROM rets GROUP BY inst HAVING count(x) >= 100)",
    "io_block_report": f"WITH {_CONDS_SQL} SELECT rule_id AS rule, attr || '|' || delay AS cells FROM conds",
    "io_simulation": """WITH d AS (SELECT DATE '2020-01-01' + id::INT AS d FROM (SELECT unnest(range(1500)) AS id)), f AS (SELECT least(50, count(*)) AS picked FROM d WHERE month(d) IN (1, 4, 7) AND isodow(d) IN (2, 3))
SELECT unnest(['A', 'B']) AS inst, picked, picked AS times, 0 AS outside FROM f""",
    "io_ranked": catalogue_pool.ORACLE["instrument_top10"],
    "io_extremes": PANEL_SQL + "SELECT inst, i, round(x, 6) AS x, CASE WHEN x >= 1 THEN 'positive' ELSE 'negative' END AS side FROM rets WHERE abs(x) >= 1",
    "new_rules_only": _new_sql(),
}
