"""Queries that must do the whole job: pool rules however written, every target, the full search."""

import re
from collections import Counter, defaultdict

import pytest

SMALL = "/root/testdata/sf0.001"
SLOTS = [f"attr{i}" for i in range(1, 9)]


def written(v):
    """A slot's condition in normal form; None if it is empty."""
    text = re.sub("[^A-Za-z0-9]", "", v or "").lower()
    return text if text not in ("", "0") else None


@pytest.fixture(scope="module")
def pool_rows(spark):
    return spark.read.parquet(f"{SMALL}/zrp01a.parquet").collect()


def test_rules_written_otherwise_keep_their_conditions_in_the_key(spark, pool_rows):
    from lagweave.plans.catalogue_pool import dedupe_across_trials

    groups = defaultdict(list)
    for r in pool_rows:
        groups[r.pool_id.split("_")[0].upper(), frozenset(filter(None, (written(r[s]) for s in SLOTS)))].append((r.mined_at is not None, r.mined_at, r.rule_id))
    want = {(min(g)[2], symbol, len(g)) for (symbol, _), g in groups.items()}
    assert {tuple(r) for r in dedupe_across_trials(spark, SMALL).select("rule_id", "symbol", "n").collect()} == want


def parts(v):
    text = written(v)
    m = text and re.fullmatch("(.+)t([0-9]+)", text)
    return text and ((m[1], int(m[2])) if m else (text, None))


def test_conditions_of_the_pool_count_however_written(spark, pool_rows):
    from lagweave.plans.catalogue_pool import conditions_summary
    from lagweave.plans.catalogue_rules import attr_frequency, pool_conditions

    conds, summaries = Counter(), set()
    for r in pool_rows:
        slots = [parts(r[s]) for s in SLOTS]
        kept = [c for c in slots if c]
        conds.update((r.rule_id, *c, len(kept), max(x for _, x in kept)) for c in kept)
        lead = slots[: slots.index(None)] if None in slots else slots
        more = f" ... (+{len(lead) - 3})" if len(lead) > 3 else ""
        summaries.add((r.rule_id, len(lead), ", ".join(f"{a}(t-{x})" for a, x in lead[:3]) + more))
    assert Counter(tuple(r) for r in pool_conditions(spark, SMALL).collect()) == conds
    n = Counter()
    for (_, attr, *_), k in conds.items():
        n[attr] += k
    assert [tuple(r) for r in attr_frequency(spark, SMALL).collect()] == sorted(n.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert {tuple(r) for r in conditions_summary(spark, SMALL).collect()} == summaries


def test_text_without_delay_is_no_empty_slot(spark):
    from lagweave.operators.rules import parse_rules, write_rule

    df = spark.createDataFrame([(1, "odd", "-", "a_UP ( T – 2 )", "0", None)], "rule_id int, attr1 string, attr2 string, attr3 string, attr4 string, attr5 string")
    got = write_rule(parse_rules(df, SLOTS[:5], any_writing=True), 3).first()
    assert [(c.attr, c.delay) for c in got.conds] == [("odd", None), ("aup", 2)] and (got.k, got.max_d) == (2, 2)
    assert (got.attr1, got.attr2, got.attr3) == ("odd", "aup(t-2)", "0")


@pytest.mark.parametrize("name", ["gnp_mine", "gnp_pool", "gnp_log", "gnp_trials"])
def test_search_is_the_full_one_for_all_targets(spark, monkeypatch, name):
    from lagweave.params import MiningParams
    from lagweave.plans import catalogue_search, evolution

    asked = []

    def mine(items, series, p, log=False):
        asked.append((sorted(r.inst for r in series.select("inst").distinct().collect()), p.trials, p.generations, p.individuals))
        return spark.createDataFrame([], evolution.LOG if log else evolution.SCHEMA)

    monkeypatch.setattr(evolution, "mine", mine)
    catalogue_search.QUERIES[name](spark, SMALL)
    whole = MiningParams()
    assert asked == [(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], whole.trials, whole.generations, whole.individuals)]


TARGETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@pytest.mark.parametrize("name", ["mine_level2", "mine_level2_dedupe", "strict_gate_report", "verification_rows", "q1_validation", "match_m5", "match_m6", "sweep_from_matches"])
def test_every_target_is_there(spark, name):
    from lagweave.plans import catalogue_pool, catalogue_rules

    got = (catalogue_rules.QUERIES | catalogue_pool.QUERIES)[name](spark, SMALL)
    assert sorted(r.inst for r in got.select("inst").distinct().collect()) == TARGETS


def test_progressive_matching_keeps_targets_apart(spark):
    from lagweave.operators import matching
    from lagweave.plans import catalogue_rules as cr

    got = {tuple(r) for r in cr.match_m6(spark, SMALL).collect()}
    items, series = cr._panel(spark, SMALL)
    alone = set()
    for target in TARGETS:
        alone |= {(target, r.rule_id, r.t) for r in matching.match_progressive(cr.rules_of(spark), items, series.where(series.inst == target)).collect()}
    assert got == alone and {g[0] for g in got} == set(TARGETS)


def test_level3_has_the_support_of_the_other_levels(spark, monkeypatch):
    """Three items that are on together in every 20th row: under 8 % and over 3 %."""
    from lagweave.plans import catalogue_rules as cr

    items = spark.range(420).where("id % 20 = 0").selectExpr("id AS i", "explode(array('A_Up', 'B_Up', 'C_Up')) AS attr")
    series = spark.range(420).selectExpr("'A' AS inst", "id AS i", "1D AS x1", "1D AS x2")
    monkeypatch.setattr(cr, "_panel", lambda s, d: (items, series))
    monkeypatch.setattr(cr, "_length", lambda s, d: 420)
    got = cr.mine_level3(spark, SMALL).collect()
    assert {r.rule for r in got} == {f"A_Up(t-{x}) & B_Up(t-{x}) & C_Up(t-{x})" for x in range(6)}
    assert all(cr.PARAMS.min_support <= r.support_rate < 0.08 for r in got)


def test_low_deviation_view_reaches_to_five(spark, monkeypatch):
    from lagweave.plans import catalogue_pool as cp

    rows = [(i, 0.01, 0.1, 0.1, 0.1, 0.1, -v, v, -v, v) for i, v in enumerate((1.0, 1.2, 3.0, 5.0, 5.1))]
    df = spark.createDataFrame(rows, "rule_id long, support_rate double, x_mean double, x2_mean double, x_sigma double, x2_sigma double, x_min double, x_max double, x2_min double, x2_max double")
    monkeypatch.setattr(cp, "pool", lambda s, d: df)
    assert {r.rule_id for r in cp.score_views(spark, SMALL).where("view = 'deviation'").collect()} == {0, 1, 2, 3}


def test_autocorrelation_of_every_rule(spark):
    from lagweave.plans import catalogue_profiles as cp

    got = cp.autocorr(spark, SMALL).collect()
    assert {(r.inst, r.rule_id) for r in got} == {(t, k) for t in TARGETS for k in range(1, 21)}
    assert {r.value for r in got if r.rule_id in (16, 20)} == {None}  # never a match: no correlation


def test_candidates_do_not_depend_on_names(spark):
    """A pair of a frequent and a rare condition is no candidate, whichever of them comes first by name."""
    from lagweave.params import MiningParams
    from lagweave.plans import mining

    p = MiningParams(max_delay=0, min_support=0.1)
    series = spark.range(100).selectExpr("'A' AS inst", "id AS i", "1D AS x1", "1D AS x2")
    for often, rare in (("A", "B"), ("B", "A")):
        items = spark.range(100).selectExpr("id AS i", f"explode(filter(array(if(id % 2 = 0, '{often}', null), if(id % 40 = 0, '{rare}', null), if(id % 3 = 0, 'C', null)), x -> x IS NOT NULL)) AS attr")
        assert {r.rule for r in mining.mined(items, series, 100, 2, p).collect()} == {f"{often}(t-0) & C(t-0)"}


def test_a_sweep_is_what_separate_minings_give(spark):
    from dataclasses import replace

    from lagweave.plans import catalogue_pool as cp
    from lagweave.plans import catalogue_rules as cr

    got = {(r.inst, r.max_delay, r.min_support, r.min_concentration, r.max_deviation): r.rules for r in cp.sweep_from_matches(spark, SMALL).collect()}
    for setting in ((3, 0.02, 0.30, 20_000.0), (4, 0.05, 0.40, 5_000.0)):
        p = replace(cr.PARAMS, **dict(zip(cp.SWEEP, setting)))
        alone = {r.inst: r["count"] for r in cr._mined(spark, SMALL, 2, p).where("reject_reason = 'passed'").groupBy("inst").count().collect()}
        assert {t: got[t, *setting] for t in TARGETS} == {t: alone.get(t, 0) for t in TARGETS}
