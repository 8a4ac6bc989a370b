"""Queries of rule matching, statistics, quadrants, gates and mining on the orders panel, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lagweave.functions import quadrants as quad
from lagweave.operators import matching as mt
from lagweave.operators import prep
from lagweave.operators.panels import PANEL_SQL, order_prices, order_returns
from lagweave.operators.rules import attribute_summary, conditions, parse_rules, write_rule
from lagweave.params import MiningParams
from lagweave.plans import mining

U, H, M, N, L = "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"
#: The fixed rules of the match queries: 1 to 4 conditions, delays 0 to 5, one attribute at two delays, one unsatisfiable, one unknown attribute, one empty.
RULES = {
    1: [(U, "Up", 0)], 2: [(U, "Up", 1)], 3: [(U, "Stay", 0)], 4: [(H, "Down", 5)], 5: [(N, "Up", 3)],
    6: [(U, "Up", 2), (H, "Stay", 0)], 7: [(M, "Down", 1), (L, "Up", 0)], 8: [(U, "Down", 0), (U, "Down", 1)], 9: [(H, "Up", 0), (N, "Down", 4)], 10: [(L, "Stay", 2), (M, "Stay", 2)],
    11: [(U, "Up", 0), (H, "Up", 0), (M, "Up", 0)], 12: [(N, "Stay", 1), (L, "Down", 3), (U, "Down", 0)], 13: [(M, "Up", 5), (H, "Down", 2), (L, "Up", 1)],
    14: [(U, "Up", 0), (H, "Up", 1), (M, "Up", 2), (N, "Up", 3)], 15: [(L, "Down", 0), (N, "Down", 0), (M, "Down", 0), (H, "Down", 0)],
    16: [(U, "Up", 0), (U, "Down", 0)], 17: [(U, "Up", 0), ("UNKNOWN", "Up", 1)], 18: [(H, "Stay", 4), (M, "Up", 0)], 19: [(L, "Up", 5)], 20: [],
}


def rule_table(spark):
    rows = [(r, *(f"{a}_{k}(t-{d})" for a, k, d in c), *["0"] * (8 - len(c))) for r, c in RULES.items()]
    return spark.createDataFrame(rows, "rule_id int, " + ", ".join(f"attr{i} string" for i in range(1, 9)))


def rules_of(spark):
    return parse_rules(rule_table(spark), [f"attr{i}" for i in range(1, 9)])


def _panel(spark, d):
    r = order_returns(spark, d)
    return prep.items(r), prep.targets(r)


def _matches(spark, d, kind="m1", **more):
    items, series = _panel(spark, d)
    return mt.matches(rules_of(spark), items, series, mt.RANGES[kind], **more)


def _rounded(df, digits=4, keep=()):
    doubles = {n for n, t in df.dtypes if t == "double"} - set(keep)
    return df.select(*(F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns))


def rule_parse(spark, d):
    return conditions(rules_of(spark)).select("rule_id", "pos", "attr", "delay", "k", "max_d")


def pool_conditions(spark, d):
    """All conditions of the rule pool, however written; attr in normal form."""
    from lagweave.session import table

    got = parse_rules(table(spark, d, "zrp01a"), [f"attr{i}" for i in range(1, 9)], any_writing=True)
    return conditions(got).select("rule_id", "attr", "delay", "k", "max_d")


def attr_summary(spark, d):
    return rules_of(spark).select("rule_id", attribute_summary(F.col("conds")).alias("summary"))


def attr_frequency(spark, d):
    got = pool_conditions(spark, d).groupBy("attr").agg(F.count(F.lit(1)).alias("n"))
    return got.orderBy(F.col("n").desc(), "attr").limit(10)


def match_m1(spark, d):
    return _matches(spark, d, "m1").select("inst", "rule_id", "t")


def match_m2(spark, d):
    return _matches(spark, d, "m2").select("inst", "rule_id", "t")


def match_m3(spark, d):
    return _matches(spark, d, "m3").select("inst", "rule_id", "t")


def match_m4(spark, d):
    return _matches(spark, d, "m4").select("inst", "rule_id", "t")


def match_m5(spark, d):
    items, series = _panel(spark, d)
    return mt.match_extreme(rules_of(spark), items, series).select("inst", "rule_id", "t", F.round("x0", 6).alias("x0"))


def match_m6(spark, d):
    items, series = _panel(spark, d)
    return mt.match_progressive(rules_of(spark), items, series).select("inst", "rule_id", "t")


def match_m7(spark, d):
    return _matches(spark, d, "m7").select("inst", "rule_id", "t")


def match_m8(spark, d):
    return _matches(spark, d, "m8", empty_matches=True).select("inst", "rule_id", "t")


def verification_rows(spark, d):
    items, series = _panel(spark, d)
    got = mt.verification_rows(rules_of(spark), mt.matches(rules_of(spark), items, series), series)
    return _rounded(got)


def rule_stats(spark, d):
    return _rounded(mt.rule_stats(_with_depth(spark, _matches(spark, d))).drop("n", "max_d"))


def rule_stats_sample_sd(spark, d):
    return _rounded(mt.rule_stats(_with_depth(spark, _matches(spark, d)), sample_sd=True).drop("n", "max_d"))


def _with_depth(spark, matched):
    return matched.join(rules_of(spark).select("rule_id", "max_d"), "rule_id")


def directional_stats(spark, d):
    return _rounded(mt.directional_stats(_matches(spark, d)))


def _quadrant(kind):
    def query(spark, d):
        return _rounded(quad.concentration(_matches(spark, d), ["inst", "rule_id"], kind, threshold=1.0), 6)

    query.__name__ = f"quadrant_{kind}"
    return query


def quadrant_d(spark, d):
    s = mt.rule_stats(_with_depth(spark, _matches(spark, d)))
    return s.select("inst", "rule_id", quad.centre_quadrant(F.col("x1_min"), F.col("x1_max"), F.col("x2_min"), F.col("x2_max"), 90.0).alias("quadrant"))


def acceptance_test(spark, d):
    """A rule is accepted with at least 20 points and a concentration of 0.8."""
    got = quad.concentration(_matches(spark, d), ["inst", "rule_id"], "c", threshold=0.001)
    return got.select("inst", "rule_id", "n", ((F.col("n") >= 20) & (F.col("concentration") >= 0.8)).cast("int").alias("accepted"))


PARAMS = MiningParams(max_delay=5, min_support=0.03, min_concentration=0.45, max_deviation=5_000.0)


def _length(spark, d) -> int:
    return order_prices(spark, d).select("ts").distinct().count()


def _mined(spark, d, k, p=PARAMS):
    items, series = _panel(spark, d)
    return mining.mined(items, series, _length(spark, d), k, p)


_RULE_COLS = ["inst", "rule", "n", "q1", "q2", "q3", "q4", "concentration", "quadrant", "support_rate", "x1_mean", "x2_mean", "x1_min", "x2_max", "reject_reason"]


def mine_level1(spark, d):
    return _rounded(_mined(spark, d, 1).select(*_RULE_COLS))


def mine_level2(spark, d):
    return _rounded(_mined(spark, d, 2).select(*_RULE_COLS))


def mine_level3(spark, d):
    """Only frequent pairs are extended."""
    return _rounded(_mined(spark, d, 3).where("reject_reason <> 'support'").select(*_RULE_COLS))


def mine_level2_dedupe(spark, d):
    """Rules that pass, one per set of attributes: the delays found first stay."""
    got = _mined(spark, d, 2).where("reject_reason = 'passed'")
    return _rounded(mining.dedupe(got, ["inst", "a1", "a2"], ["d1", "d2"]).select("inst", "a1", "d1", "a2", "d2", "n", "concentration"))


def gate_report(spark, d):
    return _rounded(mining.gate_report(_mined(spark, d, 2)), 6)


def strict_gate_report(spark, d):
    """The alternative gate over single conditions and pairs."""
    p = replace(PARAMS, max_sigma=2_500.0)
    one, two = (mining.with_strict_gate(_mined(spark, d, k), p, k, min_count=80, min_mean=50.0).groupBy("inst", "reject_reason").agg(F.count(F.lit(1)).alias("rules")).withColumn("conditions", F.lit(k)) for k in (1, 2))
    return one.unionByName(two)


def legacy_values(spark, d):
    """Own and next value with 0 where there is none."""
    _, series = _panel(spark, d)
    return series.select("inst", "i", F.round(F.coalesce("x0", F.lit(0.0)), 6).alias("own"), F.round(F.coalesce("x1", F.lit(0.0)), 6).alias("next"))


def three_horizons(spark, d):
    """Statistics over three future values."""
    items, _ = _panel(spark, d)
    series = prep.targets(order_returns(spark, d), horizons=3)
    m = mt.matches(rules_of(spark), items, series, mt.Range(span=3))
    return _rounded(mt.rule_stats(_with_depth(spark, m), span=3, horizons=3).select("inst", "rule_id", "support_count", "support_rate", "x3_mean", "x3_sigma", "deviation"))


def rule_flags(spark, d):
    got = _mined(spark, d, 1, p=replace(PARAMS, max_sigma=4_000.0))
    return got.select("inst", "rule", "high_support", "low_variance")


def q1_validation(spark, d):
    """Rules matched on the rows whose next two values are both positive enough, numbered anew, then validated on the whole series."""
    items, series = _panel(spark, d)
    good = (F.col("x1") >= 0.1) & (F.col("x2") >= 0.1)
    from pyspark.sql import Window

    kept = series.where(good).select("inst", "i", "ts", "x0", "x1", "x2", (F.row_number().over(Window.partitionBy("inst").orderBy("i")) - 1).cast("long").alias("j"), F.count(F.lit(1)).over(Window.partitionBy("inst")).alias("n"))
    moved = kept.join(items, "i").select("inst", F.col("j").alias("i"), "attr")
    q1 = mt.matches(rules_of(spark), moved, kept.select("inst", F.col("j").alias("i"), "ts", "n", "x0", "x1", "x2"), mt.Range(span=0)).groupBy("inst", "rule_id").agg(F.count(F.lit(1)).alias("subset_matches"))
    full = mt.matches(rules_of(spark), items, series, mt.RANGES["m8"])
    got = full.groupBy("inst", "rule_id", "n").agg(F.count(F.lit(1)).alias("total_matches"), F.count_if(good).alias("q1_matches"))
    precision = F.col("q1_matches") / F.col("total_matches")
    got = got.withColumn("precision", precision).withColumn("full_support", F.col("total_matches") / F.col("n")).withColumn("accepted", (precision >= 0.32).cast("int"))
    return _rounded(got.join(q1, ["inst", "rule_id"], "left").withColumn("subset_matches", F.coalesce("subset_matches", F.lit(0))).drop("n"), 6)


def rule_text(spark, d):
    return write_rule(rules_of(spark)).drop("conds")


QUERIES = {
    f.__name__: f
    for f in (
        rule_parse, pool_conditions, attr_summary, attr_frequency, match_m1, match_m2, match_m3, match_m4, match_m5, match_m6, match_m7, match_m8, verification_rows, rule_stats, rule_stats_sample_sd, directional_stats,
        *(_quadrant(k) for k in ("a", "a_total", "b", "c", "e")), quadrant_d, acceptance_test, mine_level1, mine_level2, mine_level3, mine_level2_dedupe, gate_report, strict_gate_report, legacy_values, three_horizons, rule_flags, q1_validation, rule_text,
    )
}

_CONDS = ", ".join(f"({r}, {p}, '{a}_{k}', {dl})" for r, c in RULES.items() for p, (a, k, dl) in enumerate(c))
_CONDS_SQL = f"""conds(rule_id, pos, attr, delay) AS (VALUES {_CONDS}),
rules AS (SELECT rule_id, count(*) AS k, max(delay) AS max_d FROM conds GROUP BY rule_id)"""
_HITS = PANEL_SQL + f""", {_CONDS_SQL},
hits AS (SELECT rule_id, i + delay AS t, max_d FROM items JOIN conds USING (attr) JOIN rules USING (rule_id) GROUP BY rule_id, i + delay, max_d, k HAVING count(*) = k)
"""


def _m(start="max_d", span=2, where="true", name="m"):
    return _HITS + f""", {name} AS (SELECT s.inst, h.rule_id, h.t, h.max_d, s.n, s.ts, s.x0, s.x1, s.x2 FROM hits h JOIN series s ON s.i = h.t WHERE h.t >= {start} AND h.t < s.n - {span} AND {where})
"""


_M1 = _m()
_STATS_SQL = _M1 + """SELECT inst, rule_id, count(*) AS support_count, round(avg(x1), 4) AS x1_mean, round({0}(x1){1}, 4) AS x1_sigma, round(min(x1), 4) AS x1_min, round(max(x1), 4) AS x1_max,
  round(avg(x2), 4) AS x2_mean, round({0}(x2){1}, 4) AS x2_sigma, round(min(x2), 4) AS x2_min, round(max(x2), 4) AS x2_max, round(count(*) / (n - max_d - 2), 4) AS support_rate,
  round((greatest(abs(min(x1)), abs(max(x1))) + greatest(abs(min(x2)), abs(max(x2)))) / 2, 4) AS deviation FROM m GROUP BY inst, rule_id, n, max_d"""


def _quad_sql(kind, source, by, pick=None, tail=""):
    up, down = {"a": ("{} > 0", "{} < 0"), "a_total": ("{} > 0", "{} < 0"), "b": ("{} >= 0", "{} < 0"), "c": ("{} >= 1.0", "{} < -1.0"), "e": ("{} > 0", "NOT {} > 0")}[kind]
    pairs = [(up, up), (down, up), (down, down), (up, down)]
    if kind == "e":
        pairs = [(up, up), (up, down), (down, down), (down, up)]
    counts = ", ".join(f"count(*) FILTER ({a.format('x1')} AND {b.format('x2')}) AS q{i}" for i, (a, b) in enumerate(pairs, 1))
    total = "n" if kind in ("a_total", "b", "e") else "(q1 + q2 + q3 + q4)"
    return f"""(SELECT *, coalesce(greatest(q1, q2, q3, q4) / nullif({total}, 0), 0) AS concentration,
  CASE greatest(q1, q2, q3, q4) WHEN 0 THEN 'Q0' WHEN q1 THEN 'Q1' WHEN q2 THEN 'Q2' WHEN q3 THEN 'Q3' ELSE 'Q4' END AS quadrant
  FROM (SELECT {by}, {counts}, count(*) AS n{tail} FROM {source} WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY {by}))"""


def _level_sql(k, p=PARAMS):
    """Rules of k conditions with the gate. All combinations are matched and counted first; then those stay whose parts of k - 1 conditions have the support."""
    rng = f"t BETWEEN {p.max_delay} AND (SELECT max(i) + 1 FROM times) - {p.future_span} - 1"
    span = f"((SELECT max(i) + 1 FROM times) - {p.max_delay + p.future_span})"
    parts = f", one AS (SELECT attr, delay, t FROM (SELECT attr, d.delay, i + d.delay AS t FROM items, (SELECT unnest(range({p.max_delay + 1})) AS delay) d) WHERE {rng})"
    parts += ", l1 AS (SELECT attr AS a1, delay AS d1, t FROM one)"
    for j in range(2, k + 1):
        parts += f", l{j} AS (SELECT l.*, o.attr AS a{j}, o.delay AS d{j} FROM l{j - 1} l JOIN one o USING (t) WHERE o.attr > l.a{j - 1})"
    if k > 1:
        keys = ", ".join(f"a{i}, d{i}" for i in range(1, k))
        parts += f", f AS (SELECT {keys} FROM l{k - 1} GROUP BY ALL HAVING count(*) >= {p.min_support} * {span})"
        subsets = [[i for i in range(1, k + 1) if i != out] for out in range(1, k + 1)]
        tests = " AND ".join("(" + ", ".join(f"l.a{i}, l.d{i}" for i in own) + f") IN (SELECT ({keys}) FROM f)" if k > 2 else f"(l.a{own[0]}, l.d{own[0]}) IN (SELECT (a1, d1) FROM f)" for own in subsets)
        rules = ", ".join(f"a{i}, d{i}" for i in range(1, k + 1))
        parts += f", c AS (SELECT {rules} FROM (SELECT DISTINCT {rules} FROM l{k}) l WHERE {tests}), lk AS (SELECT l{k}.* FROM l{k} JOIN c USING ({rules}))"
    else:
        parts += ", lk AS (SELECT * FROM l1)"
    by = "inst, " + ", ".join(f"a{i}, d{i}" for i in range(1, k + 1))
    tail = ", " + ", ".join(f"{f}(x{h}) AS x{h}_{nm}" for h in (1, 2) for nm, f in (("mean", "avg"), ("sigma", "stddev_pop"), ("min", "min"), ("max", "max")))
    source = "(SELECT l.*, s.inst, s.x1, s.x2 FROM lk l JOIN series s ON s.i = l.t)"
    rule = " || ' & ' || ".join(f"a{i} || '(t-' || d{i} || ')'" for i in range(1, k + 1))
    D = p.max_deviation
    calm = f"CASE quadrant WHEN 'Q1' THEN x1_min >= -{D} AND x2_min >= -{D} WHEN 'Q2' THEN x1_max <= {D} AND x2_min >= -{D} WHEN 'Q3' THEN x1_max <= {D} AND x2_max <= {D} WHEN 'Q4' THEN x1_min >= -{D} AND x2_max <= {D} ELSE false END"
    return PANEL_SQL + parts + f""", mined AS (SELECT *, {rule} AS rule, n / {span} AS support_rate,
  CASE WHEN concentration < {p.min_concentration} THEN 'concentration' WHEN NOT {calm} THEN 'deviation' WHEN n / {span} < {p.min_support} THEN 'support' ELSE 'passed' END AS reject_reason
  FROM {_quad_sql("b", source, by, tail=tail)})
"""


_MINED_COLS = ", ".join(f"round({c}, 4) AS {c}" if c in ("concentration", "support_rate", "x1_mean", "x2_mean", "x1_min", "x2_max") else c for c in _RULE_COLS)
_SLOT_LIST = ", ".join(f"attr{i}" for i in range(1, 9))


def _normal_sql():
    """The slots in normal form: ASCII letters and digits alone, in lower case; an empty slot is '' or 0."""
    return f"list_transform([{_SLOT_LIST}], lambda a: lower(regexp_replace(coalesce(a, ''), '[^A-Za-z0-9]', '', 'g')))"


_SET = f"list_sort(list_distinct(list_filter({_normal_sql()}, lambda a: a NOT IN ('', '0'))))"
_POOL = f"""WITH c AS (SELECT rule_id, unnest({_normal_sql()}) AS raw FROM zrp01a),
p AS (SELECT rule_id, CASE WHEN regexp_matches(raw, '^.+t[0-9]+$') THEN regexp_extract(raw, '^(.+)t([0-9]+)$', 1) ELSE raw END AS attr, TRY_CAST(nullif(regexp_extract(raw, '^(.+)t([0-9]+)$', 2), '') AS INT) AS delay FROM c WHERE raw NOT IN ('', '0'))
"""



def _progressive_sql():
    """One step per position: the rows left are numbered, and a lag counts in these numbers."""
    out, done = ", s0 AS (SELECT inst, rule_id, k, i, i AS j FROM series, rules)", []
    for pos in range(max(len(c) for c in RULES.values())):
        out += f""", k{pos} AS (SELECT s.inst, s.rule_id, s.k, s.i FROM s{pos} s JOIN conds c ON c.rule_id = s.rule_id AND c.pos = {pos} JOIN s{pos} b ON b.inst = s.inst AND b.rule_id = s.rule_id AND b.j = s.j - c.delay
  JOIN items x ON x.i = b.i AND x.attr = c.attr), s{pos + 1} AS (SELECT *, row_number() OVER (PARTITION BY inst, rule_id ORDER BY i) AS j FROM k{pos} WHERE k > {pos + 1})"""
        done.append(f"SELECT inst, rule_id, i AS t FROM k{pos} WHERE k = {pos + 1}")
    return out + f", m AS ({' UNION ALL '.join(done)})"


ORACLE = {
    "rule_parse": f"WITH {_CONDS_SQL} SELECT rule_id, pos, attr, delay, k, max_d FROM conds JOIN rules USING (rule_id)",
    "pool_conditions": _POOL + "SELECT rule_id, attr, delay, count(*) OVER (PARTITION BY rule_id) AS k, coalesce(max(delay) OVER (PARTITION BY rule_id), 0) AS max_d FROM p",
    "rule_text": f"WITH {_CONDS_SQL}, ids AS (SELECT unnest(range(1, 21))::INT AS rule_id), w AS (SELECT rule_id, list(attr || '(t-' || delay || ')' ORDER BY pos) AS c FROM conds GROUP BY rule_id) SELECT rule_id, coalesce(k, 0) AS k, coalesce(max_d, 0) AS max_d, " + ", ".join(f"coalesce(c[{i}], '0') AS attr{i}" for i in range(1, 9)) + " FROM ids LEFT JOIN rules USING (rule_id) LEFT JOIN w USING (rule_id)",
    "attr_summary": f"""WITH {_CONDS_SQL}, w AS (SELECT rule_id, list(attr || '(t-' || delay || ')' ORDER BY pos) AS c FROM conds GROUP BY rule_id)
SELECT rule_id, array_to_string(c[1:3], ', ') || CASE WHEN len(c) > 3 THEN ' ... (+' || (len(c) - 3) || ')' ELSE '' END AS summary FROM w UNION ALL SELECT 20, ''""",
    "attr_frequency": _POOL + "SELECT attr, count(*) AS n FROM p GROUP BY attr ORDER BY n DESC, attr LIMIT 10",
    "match_m1": _M1 + "SELECT inst, rule_id, t FROM m",
    "match_m2": _m(start="5") + "SELECT inst, rule_id, t FROM m",
    "match_m3": _m(span=1) + "SELECT inst, rule_id, t FROM m",
    "match_m4": _m(span=0) + "SELECT inst, rule_id, t FROM m",
    "match_m5": PANEL_SQL
    + f""", {_CONDS_SQL}, side AS (SELECT inst, count(*) FILTER (x0 >= 1) > count(*) FILTER (x0 <= -1) AS up FROM series GROUP BY inst),
kept AS (SELECT o.*, row_number() OVER (PARTITION BY inst ORDER BY i) - 1 AS j FROM series o JOIN side USING (inst) WHERE CASE WHEN up THEN x0 >= 1 ELSE x0 <= -1 END),
moved AS (SELECT inst, j, attr FROM kept JOIN items USING (i)),
hits AS (SELECT inst, rule_id, j + delay AS t, max_d FROM moved JOIN conds USING (attr) JOIN rules USING (rule_id) GROUP BY inst, rule_id, j + delay, max_d, k HAVING count(*) = k)
SELECT hits.inst, rule_id, t, round(x0, 6) AS x0 FROM hits JOIN kept ON j = t AND kept.inst = hits.inst WHERE t >= max_d""",
    "match_m6": PANEL_SQL + f", {_CONDS_SQL}" + _progressive_sql() + " SELECT inst, rule_id, t FROM m",
    "match_m7": PANEL_SQL
    + f""", {_CONDS_SQL.replace('conds(', 'conds0(').replace('FROM conds ', 'FROM conds ')}""".replace("rules AS", "conds AS (SELECT * FROM conds0 SEMI JOIN items USING (attr)), rules AS")
    + """, hits AS (SELECT rule_id, i + delay AS t, max_d FROM items JOIN conds USING (attr) JOIN rules USING (rule_id) GROUP BY rule_id, i + delay, max_d, k HAVING count(*) = k)
SELECT s.inst, rule_id, t FROM hits JOIN series s ON s.i = t WHERE t >= max_d AND t < n - 1""",
    "match_m8": _m(start="0") + "SELECT inst, rule_id, t FROM m UNION ALL SELECT inst, 20, i FROM series WHERE i < n - 2",
    "verification_rows": _m()
    + """SELECT m.inst, m.rule_id, m.t AS row_index, strftime(m.ts, '%Y-%m-%d') AS timestamp, pos, delay, attr || '(' || strftime(s.ts, '%Y-%m-%d') || ')' AS cell, round(m.x1, 4) AS x1, round(m.x2, 4) AS x2
  FROM m JOIN conds USING (rule_id) LEFT JOIN times s ON s.i = m.t - delay""",
    "rule_stats": _STATS_SQL.format("stddev_pop", ""),
    "rule_stats_sample_sd": _STATS_SQL.replace("round({0}(x1){1}, 4)", "round(coalesce(stddev_samp(x1), 0), 4)").replace("round({0}(x2){1}, 4)", "round(coalesce(stddev_samp(x2), 0), 4)"),
    "directional_stats": _M1
    + """, s AS (SELECT inst, rule_id, count(*) FILTER (x1 > 0) AS pos_count, count(*) FILTER (x1 < 0) AS neg_count, avg(x1) FILTER (x1 > 0) AS pos_mean, avg(x1) FILTER (x1 < 0) AS neg_mean,
  sum(x1) FILTER (x1 > 0) AS gain, -sum(x1) FILTER (x1 < 0) AS loss FROM m GROUP BY ALL), w AS (SELECT *, pos_count / nullif(pos_count + neg_count, 0) AS wr FROM s)
SELECT inst, rule_id, pos_count, neg_count, round(pos_mean, 4) AS pos_mean, round(neg_mean, 4) AS neg_mean, round(wr, 4) AS win_rate, round(gain / nullif(loss, 0), 4) AS profit_factor,
  round(wr * coalesce(pos_mean, 0) + (1 - wr) * coalesce(neg_mean, 0), 4) AS expectancy FROM w""",
    **{f"quadrant_{k}": _M1 + f"SELECT inst, rule_id, q1, q2, q3, q4, n, round(concentration, 6) AS concentration, quadrant FROM {_quad_sql(k, 'm', 'inst, rule_id')}" for k in ("a", "a_total", "b", "c", "e")},
    "quadrant_d": _M1
    + """, s AS (SELECT inst, rule_id, min(x1) AS a, max(x1) AS b, min(x2) AS c, max(x2) AS d FROM m GROUP BY ALL), k AS (SELECT *, (a + b) / 2 AS cx, (c + d) / 2 AS cy FROM s)
SELECT inst, rule_id, CASE WHEN (cx > 0 AND a < -90) OR (cx < 0 AND b > 90) OR (cy > 0 AND c < -90) OR (cy < 0 AND d > 90) THEN 0
  WHEN cx > 0 AND cy > 0 THEN 1 WHEN cx < 0 AND cy > 0 THEN 2 WHEN cx < 0 AND cy < 0 THEN 3 WHEN cx > 0 AND cy < 0 THEN 4 ELSE 0 END AS quadrant FROM k""",
    "acceptance_test": _M1 + f"SELECT inst, rule_id, n, (n >= 20 AND concentration >= 0.8)::INT AS accepted FROM {_quad_sql('c', 'm', 'inst, rule_id').replace('>= 1.0', '>= 0.001').replace('< -1.0', '< -0.001')}",
    "mine_level1": _level_sql(1) + f"SELECT {_MINED_COLS} FROM mined",
    "mine_level2": _level_sql(2) + f"SELECT {_MINED_COLS} FROM mined",
    "mine_level3": _level_sql(3) + f"SELECT {_MINED_COLS} FROM mined WHERE reject_reason <> 'support'",
    "mine_level2_dedupe": _level_sql(2) + "SELECT inst, a1, d1, a2, d2, n, round(concentration, 4) AS concentration FROM mined WHERE reject_reason = 'passed' QUALIFY row_number() OVER (PARTITION BY inst, a1, a2 ORDER BY d1, d2) = 1",
    "gate_report": _level_sql(2)
    + """, g AS (SELECT inst, reject_reason, count(*) AS rules FROM mined GROUP BY ALL)
SELECT inst, reject_reason, rules, round(100 * rules / sum(rules) OVER (PARTITION BY inst), 6) AS percent,
  reject_reason <> 'passed' AND row_number() OVER (PARTITION BY inst, reject_reason = 'passed' ORDER BY rules DESC, reject_reason) = 1 AS bottleneck FROM g""",
    "strict_gate_report": " UNION ALL ".join(
        "SELECT * FROM (" + _level_sql(k) + f"""SELECT inst, CASE WHEN support_rate < 0.03 THEN 'support' WHEN {k} < 2 THEN 'conditions' WHEN n < 80 THEN 'count' WHEN abs(x1_mean) < 50 OR abs(x2_mean) < 50 THEN 'mean'
  WHEN greatest(x1_sigma, x2_sigma) > 2500 THEN 'sigma' ELSE 'passed' END AS reject_reason, count(*) AS rules, {k} AS conditions FROM mined GROUP BY ALL)"""
        for k in (1, 2)
    ),
    "legacy_values": PANEL_SQL + "SELECT inst, i, round(coalesce(x0, 0), 6) AS own, round(coalesce(x1, 0), 6) AS next FROM series",
    "three_horizons": PANEL_SQL
    + f""", {_CONDS_SQL}, s3 AS (SELECT *, lead(x0, 3) OVER (PARTITION BY inst ORDER BY i) AS x3 FROM series),
hits AS (SELECT rule_id, i + delay AS t, max_d FROM items JOIN conds USING (attr) JOIN rules USING (rule_id) GROUP BY rule_id, i + delay, max_d, k HAVING count(*) = k)
SELECT inst, rule_id, count(*) AS support_count, round(count(*) / (n - max_d - 3), 4) AS support_rate, round(avg(x3), 4) AS x3_mean, round(stddev_pop(x3), 4) AS x3_sigma,
  round((greatest(abs(min(x1)), abs(max(x1))) + greatest(abs(min(x2)), abs(max(x2))) + greatest(abs(min(x3)), abs(max(x3)))) / 3, 4) AS deviation
FROM hits JOIN s3 ON i = t WHERE t >= max_d AND t < n - 3 GROUP BY inst, rule_id, n, max_d""",
    "rule_flags": _level_sql(1) + "SELECT inst, rule, support_rate >= 0.06 AS high_support, greatest(x1_sigma, x2_sigma) <= 2000 AS low_variance FROM mined",
    "q1_validation": PANEL_SQL
    + f""", {_CONDS_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY inst) AS kn FROM series WHERE x1 >= 0.1 AND x2 >= 0.1), moved AS (SELECT inst, kn, j, attr FROM kept JOIN items USING (i)),
qh AS (SELECT inst, rule_id, j + delay AS t, max_d, kn FROM moved JOIN conds USING (attr) JOIN rules USING (rule_id) GROUP BY inst, rule_id, j + delay, max_d, kn, k HAVING count(*) = k),
qs AS (SELECT inst, rule_id, count(*) AS s FROM qh WHERE t >= max_d AND t < kn GROUP BY inst, rule_id),
hits AS (SELECT rule_id, i + delay AS t FROM items JOIN conds USING (attr) JOIN rules USING (rule_id) GROUP BY rule_id, i + delay, k HAVING count(*) = k),
f AS (SELECT inst, rule_id, n, count(*) AS total_matches, count(*) FILTER (x1 >= 0.1 AND x2 >= 0.1) AS q1_matches FROM hits JOIN series ON i = t WHERE t < n - 2 GROUP BY ALL)
SELECT inst, rule_id, total_matches, q1_matches, round(q1_matches / total_matches, 6) AS precision, round(total_matches / n, 6) AS full_support, (q1_matches / total_matches >= 0.32)::INT AS accepted, coalesce(s, 0) AS subset_matches
FROM f LEFT JOIN qs USING (inst, rule_id)""",
}
