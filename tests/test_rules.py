"""Rules on the hand-made series, progressive matching by brute force, the evolutionary miner, distributions."""

import numpy as np
import pytest

from lagweave.functions import quadrants
from lagweave.functions.distributions import f_upper, normal_cdf, t_two_sided
from lagweave.operators import matching, prep
from lagweave.operators.profiles import density
from lagweave.operators.quantiles import quantiles
from lagweave.operators.rules import parse_rules
from lagweave.params import MiningParams
from lagweave.plans import evolution
from pyspark.sql import functions as F

A = [100, 110, 110, 99, 108.9, 119.79, 119.79, 107.811, 118.5921, 118.5921]
B = [50, 49, 49, 50, 50, 51, 50, 50, 51, 52]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(n, i, float(p)) for n, ps in (("A", A), ("B", B)) for i, p in enumerate(ps)]
    grid = spark.createDataFrame(rows, "inst string, i long, price double").withColumn("ts", F.timestamp_add("DAY", F.col("i").cast("int"), F.lit("2020-01-01").cast("timestamp_ntz")))
    r = prep.with_returns(grid)
    return prep.items(r), prep.targets(r).where("inst = 'A'")


def rules(spark, *texts):
    slots = [f"attr{i}" for i in range(1, 9)]
    rows = [(i, *t, *["0"] * (8 - len(t))) for i, t in enumerate(texts)]
    return parse_rules(spark.createDataFrame(rows, "rule_id int, " + ", ".join(f"{s} string" for s in slots)), slots)


HAND = [
    (["A_Up(t-0)"], [1, 4, 5], (0, 0, 0, 0), (1, 0, 0, 2), (0, 1, 2, 0), 3 / 8),
    (["A_Up(t-1)"], [2, 5, 6], (0, 2, 0, 0), (0, 2, 0, 1), (0, 0, 1, 2), 3 / 7),
    (["A_Stay(t-0)"], [2, 6], (0, 2, 0, 0), (0, 2, 0, 0), (0, 0, 0, 2), 2 / 8),
    (["A_Up(t-2)", "B_Stay(t-0)"], [7], (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), 1 / 6),
    (["B_Down(t-1)"], [2, 7], (0, 1, 0, 0), (1, 1, 0, 0), (0, 1, 0, 1), 2 / 7),
]


def test_hand_series(spark, panel):
    items, series = panel
    r = rules(spark, *(h[0] for h in HAND))
    m = matching.matches(r, items, series).withColumns({c: F.round(c, 6) for c in ("x1", "x2")}).cache()
    got = {}
    for row in m.collect():
        got.setdefault(row.rule_id, []).append(row.t)
    quads = {k: {q.rule_id: (q.q1, q.q2, q.q3, q.q4) for q in quadrants.concentration(m, ["rule_id"], k).collect()} for k in "abe"}
    support = {s.rule_id: s.support_rate for s in matching.rule_stats(m.join(r.select("rule_id", "max_d"), "rule_id")).collect()}
    for i, (_, t, qa, qb, qe, s) in enumerate(HAND):
        assert sorted(got[i]) == t
        assert (quads["a"][i], quads["b"][i], quads["e"][i]) == (qa, qb, qe)
        assert support[i] == pytest.approx(s)


def test_order_of_conditions_is_no_matter(spark, panel):
    items, series = panel
    r = rules(spark, ["A_Up(t-2)", "B_Stay(t-0)"], ["B_Stay(t-0)", "A_Up(t-2)"], ["A_Up(t-0)", "A_Down(t-0)"], [])
    got = matching.matches(r, items, series, matching.RANGES["m8"], empty_matches=True).collect()
    at = lambda k: sorted(x.t for x in got if x.rule_id == k)
    assert at(0) == at(1) and not at(2) and at(3) == list(range(8))


def test_progressive_matching(spark, panel):
    items, series = panel
    texts = [["A_Up(t-1)", "B_Stay(t-1)"], ["B_Stay(t-0)", "A_Up(t-1)"], ["A_Up(t-0)"], ["B_Up(t-0)", "B_Up(t-1)", "A_Stay(t-0)"]]
    got = {}
    for r in matching.match_progressive(rules(spark, *texts), items, series).collect():
        got.setdefault(r.rule_id, []).append(r.t)
    has = {(r.i, r.attr) for r in items.collect()}
    for k, text in enumerate(texts):
        frame = list(range(10))
        for c in text:
            name, d = c[:-1].split("(t-")
            frame = [i for j, i in enumerate(frame) if j >= int(d) and (frame[j - int(d)], name) in has]
        assert sorted(got.get(k, [])) == frame
    assert matching.match_progressive(rules(spark, []), items, series).count() == 0


def test_parse_odd_slots(spark):
    got = rules(spark, [" A_Up(t-3)\r\n", "0", "", "-", "weird", "B(x)(t-12)"]).first()
    assert [(c.attr, c.delay) for c in got.conds] == [("A_Up", 3), ("B(x)", 12)] and got.max_d == 12


def test_evolution_is_repeatable_and_right(spark):
    r = np.random.default_rng(3)
    n = 400
    flags = r.random((4, n)) < 0.4
    x = r.normal(0, 1, n)
    x[2:] += 1.5 * flags[0, :-2]
    p = MiningParams(generations=15, individuals=40, elite=10, elite_copies=4, crossover_pairs=5, start_nodes=4, judgement_nodes=20, min_support=0.05, min_concentration=0.4, max_deviation=10.0)
    first, log = evolution.evolve(flags, list("abcd"), x, p, 5)
    again, _ = evolution.evolve(flags, list("abcd"), x, p, 5)
    assert [f["rule"] for f in first] == [f["rule"] for f in again] and first
    assert [a["rules"] for a in log] == sorted(a["rules"] for a in log)
    assert len({tuple(a for a, _ in f["rule"]) for f in first}) == len(first)
    for f in first:
        t = [t for t in range(f["max_d"], n - 2) if all(flags[a, t - d] for a, d in f["rule"])]
        assert f["support_count"] == len(t) and f["x1_mean"] == pytest.approx(x[np.array(t) + 1].mean())
        assert evolution.passes(f, p)


def test_gates_by_bitmaps_are_the_plain_ones():
    """Rules of one to three conditions, series with unknown values, both kinds of range, against statistics row by row."""
    r = np.random.default_rng(4)
    n, attrs = 333, 5
    flags, x = r.random((attrs, n)) < 0.5, r.normal(0.2, 1, n)
    x[[0, 17, 18, 200]] = np.nan
    p = MiningParams(min_support=0.02, min_concentration=0.32, max_deviation=1.6)
    panel, lags = evolution.Panel(flags, x, p), p.max_delay + 1
    rules = [tuple(sorted((int(a), int(r.integers(lags))) for a in r.choice(attrs, k, replace=False))) for k in (1, 2, 3) for _ in range(150)]
    codes = np.full((len(rules), 3), -1)
    for line, rule in zip(codes, rules):
        line[: len(rule)] = sorted(a * lags + d for a, d in rule)
    ok, rate, concentration = panel.gates(codes, np.array([max(d for _, d in rule) for rule in rules]))
    assert 0 < ok.sum() < len(rules)
    for i, rule in enumerate(rules):
        s = evolution.rule_statistics(flags, x, rule, p)
        assert ok[i] == evolution.passes(s, p)
        assert (rate[i], concentration[i]) == (pytest.approx(s["support_rate"]), pytest.approx(s["concentration"]))


def test_paths_spell_what_a_walk_spells():
    r = np.random.default_rng(5)
    n, p = 200, MiningParams(individuals=6, start_nodes=3, judgement_nodes=8, max_depth=4, min_support=0.01)
    flags, x = r.random((3, n)) < 0.8, r.normal(0, 1, n)
    to, attr, delay = r.integers(3, 11, (6, 11)), r.integers(0, 3, (6, 11)), r.integers(0, 6, (6, 11))
    who, codes = evolution.paths(evolution.Panel(flags, x, p), to, attr, delay)
    want = []
    for i in range(6):
        for start in range(3):
            node, rule, seen = to[i, start], {}, []
            for _ in range(4):
                a, d = int(attr[i, node]), int(delay[i, node])
                seen.append((a, d))
                rows = [t for t in range(max(d for _, d in seen), n - 2) if all(flags[b, t - e] for b, e in seen)]
                if len(rows) < max(1.0, p.min_support * (n - 7)):
                    break
                rule[a] = d
                want.append((i, sorted(b * 6 + e for b, e in rule.items())))
                node = to[i, node]
    assert [(int(i), [int(v) for v in c if v >= 0]) for i, c in zip(who, codes)] == want


def test_usage_weights_by_hand():
    delays = evolution.Usage(2, [1] * 5, 1, 2, 5)
    delays.add(0, 3)
    assert delays.weights(0).tolist() == [8, 5]  # five windows of 1, and what was found
    assert delays.weights(1).tolist() == [9, 6]  # the window opened at the refresh begins with 2, an old one of 1 has gone
    delays.add(1)
    assert delays.weights(2).tolist() == [9, 7]
    for g in (3, 4):
        assert delays.weights(g).tolist() == [9, 7]
    assert delays.weights(5).tolist() == [6, 7]  # the find of generation 0 is five windows old
    attributes = evolution.Usage(2, [1, 0, 0, 0, 0], 0, 1, 5)
    assert attributes.weights(0).tolist() == [1, 1] and attributes.weights(1).tolist() == [2, 2]


def test_tightness_is_a_fitness_of_its_own():
    r = np.random.default_rng(3)
    flags, x = r.random((4, 300)) < 0.4, r.normal(0, 1, 300)
    p = MiningParams(generations=6, individuals=40, elite=10, elite_copies=4, crossover_pairs=5, start_nodes=4, judgement_nodes=20, min_support=0.05, min_concentration=0.3, max_deviation=10.0)
    one, log1 = evolution.evolve(flags, list("abcd"), x, p, 5)
    two, log2 = evolution.evolve(flags, list("abcd"), x, p, 5, evolution.tightness_fitness)
    assert one and two and log1[0]["best_fitness"] != log2[0]["best_fitness"]
    assert evolution.tightness_fitness(2, {"support_rate": 0.1, "x1_sigma": 0.999, "x2_sigma": 1.999}) == pytest.approx(6)


def test_distributions():
    # Critical points of published tables.
    for t, df, p in ((2.228, 10, 0.05), (2.750, 30, 0.01), (12.706, 1, 0.05)):
        assert t_two_sided(t, df) == pytest.approx(p, abs=2e-4)
    for f, a, b, p in ((4.10, 2, 10, 0.05), (2.76, 4, 25, 0.05), (10.04, 1, 10, 0.01)):
        assert f_upper(f, a, b) == pytest.approx(p, abs=3e-4)
    assert t_two_sided(float("inf"), 5) == 0 and f_upper(-1, 2, 3) == 1
    assert np.isnan(t_two_sided([1.0, np.nan, 1.0], [3.0, 3.0, 0.0])).tolist() == [False, True, True]


def test_normal_cdf(spark):
    import math

    zs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(z / 2**0.5)) for z in zs], abs=2e-7)


def test_quantiles(spark):
    r = np.random.default_rng(1)
    data = {"a": np.round(r.normal(0, 5, 501), 1), "b": np.array([2.0]), "c": np.repeat(7.0, 40), "d": np.array([-1e300, 0.0, 1e-300, 1e300])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("a", float("inf"))]
    got = quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0, 0.1, 0.5, 0.77, 1]).collect()
    assert len(got) == 20
    for q in got:
        assert q.value == pytest.approx(np.quantile(data[q.g], q.p))


def test_density_has_area_one(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([("a", float(v)) for v in r.normal(0, 1, 2000)], "g string, x double")
    got = sorted((q["at"], q["density"]) for q in density(df, ["g"], "x").collect())
    assert np.trapezoid([d for _, d in got], [a for a, _ in got]) == pytest.approx(1, abs=0.01)
