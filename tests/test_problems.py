"""The general problems on small tables with every kind of dirt, against brute force."""

import datetime as dt
import math
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from lagweave.functions.instants import utc_text, with_instant_us
from lagweave.operators.regular_grid import regular_grid
from lagweave.operators.rolling_totals import rolling_totals
from lagweave.operators.skew import spread_join
from lagweave.operators.spikes import cell_of, feed_rows, flag_values, measure_rows

SCHEMA = "row_id long, feed string, bar_minutes int, x double, t string, arrived_at timestamp_ntz, k string, block string, us string, n int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """rows: (feed, bar, x, t) or with arrival seconds; extra columns have the operators' own inner names."""
    base = dt.datetime(2020, 1, 1)
    out = []
    for i, r in enumerate(rows):
        at = base + dt.timedelta(seconds=r[4] if len(r) > 4 else i)
        out.append((i, *r[:4], at, "clash", "clash", "clash", 1))
    return spark.createDataFrame(out, SCHEMA)


def readings_of(rows):
    """(feed, bar): {time: x} of the newest delivery."""
    newest = {}
    for i, r in enumerate(rows):
        feed, bar, x, t = r[:4]
        try:
            when = dt.datetime.strptime(t, "%Y-%m-%d %H:%M:%S")
        except (TypeError, ValueError):
            continue
        if x is None:
            continue
        at = r[4] if len(r) > 4 else i
        if (feed, bar, when) not in newest or (at, i) > newest[feed, bar, when][:2]:
            newest[feed, bar, when] = (at, i, x)
    out = defaultdict(dict)
    for (feed, bar, when), (_, i, x) in newest.items():
        out[feed, bar][when] = (x, i)
    return out


def random_rows(seed, n=300):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        feed, bar = r.choice([("a", 60), ("b", 15), ("c", 1440), (None, 60), ("hot", 60), ("hot", 60)])
        t = dt.datetime(2020, 2, 1) + dt.timedelta(minutes=r.randrange(0, 60 * 24 * 9, 7))
        x = r.choice([None, NAN, INF, -INF, 0.0, 0.5, 0.5, 0.5, round(r.gauss(0, 1), 2), round(r.gauss(0, 1), 2), 500.0, -101.0])
        rows.append((feed, bar, x, r.choice([t.strftime("%Y-%m-%d %H:%M:%S")] * 9 + [None, "", "n/a", "2020-02-30 00:00:00"]), r.randrange(1000)))
    return rows + rows[:20]


@pytest.mark.parametrize("text,want", [
    ("2020-09-14 17:42:24", "2020-09-14 17:42:24"), ("2020-09-15T02:26:55+09:00", "2020-09-14 17:26:55"), ("2020-09-14 14:16:36-0500", "2020-09-14 19:16:36"), ("2020-09-14T20:56:00Z", "2020-09-14 20:56:00"),
    ("  2020/09/14 21:15:57\t", "2020-09-14 21:15:57"), ("2020-09-14", "2020-09-14 00:00:00"), ("2020/02/03 05:06", "2020-02-03 05:06:00"), ("　2020-09-14 17:42:24　", "2020-09-14 17:42:24"), ("1969-12-31 23:59:59", "1969-12-31 23:59:59"),
    ("2020-02-30", None), ("2020-02-28 25:00:00", None), ("2020", None), ("T12:30", None), ("", None), ("n/a", None), (None, None),
])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants(spark, text, want, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = with_instant_us(spark.createDataFrame([(text,)], "t string"), "t", "us").select(utc_text(F.col("us"), "time")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [4, 256])
def test_grid_periods_against_brute_force(spark, seed, block):
    rows = random_rows(seed)
    want = {}
    epoch = dt.datetime(1970, 1, 1)
    for (feed, bar), at in readings_of(rows).items():
        per = defaultdict(list)
        for when, (x, _) in at.items():
            per[(when - epoch) // dt.timedelta(minutes=bar)].append(x)
        any_value = any(math.isfinite(x) and x >= -100 for v in per.values() for x in v)
        for p in range(min(per), max(per) + 1):
            fine = [x for x in per.get(p, []) if math.isfinite(x) and x >= -100]
            status = "observed" if fine else "repaired" if p in per else "filled" if any_value else "missing"
            want[feed, (epoch + p * dt.timedelta(minutes=bar)).strftime("%Y-%m-%d %H:%M:%S")] = (status, len(per.get(p, [])), sum(fine) / len(fine) if fine else None)
    got = {(r.feed, r.period_start): r for r in regular_grid(table(spark, rows), block_periods=block, gap_chunk=5, least=-100.0).collect()}
    assert set(got) == set(want)
    for key, (status, n, x) in want.items():
        assert (got[key].status, got[key].n_readings) == (status, n)
        if x is not None:
            assert got[key].x == pytest.approx(x)
        else:
            assert (got[key].x is None) == (status == "missing")


def test_grid_recovers_a_seasonal_series(spark):
    start = dt.datetime(2020, 3, 1)
    f = lambda h: 3 + 0.01 * h + 2 * math.sin(2 * math.pi * h / 24) + math.cos(4 * math.pi * h / 24)
    hours = [h for h in range(24 * 28) if h % 5 and not 300 < h < 330]
    rows = [("s", 60, f(h), (start + dt.timedelta(hours=h)).strftime("%Y-%m-%d %H:%M:%S")) for h in hours]
    got = regular_grid(table(spark, rows)).where("status = 'filled'").collect()
    assert len(got) > 100
    for r in got:
        h = (dt.datetime.strptime(r.period_start, "%Y-%m-%d %H:%M:%S") - start) // dt.timedelta(hours=1)
        assert r.x == pytest.approx(f(h), abs=1e-4)


def test_grid_bridges_residuals(spark):
    rows = [("s", 1440, float(v), f"2020-03-{d:02d} 00:00:00") for d, v in ((1, 1), (2, 5), (5, 2), (6, 2))]
    got = {r.period_start[:10]: r for r in regular_grid(table(spark, rows)).collect()}
    ra, rb = (got[d].x - got[d].x_fitted for d in ("2020-03-02", "2020-03-05"))
    for d, share in (("2020-03-03", 1 / 3), ("2020-03-04", 2 / 3)):
        assert got[d].x == pytest.approx(got[d].x_fitted + ra + (rb - ra) * share)


def test_grid_of_nothing(spark):
    assert regular_grid(table(spark, [])).count() == 0
    assert regular_grid(table(spark, [("a", 60, None, "2020-01-01 00:00:00"), ("a", None, 1.0, "2020-01-01 00:00:00"), ("a", 0, 1.0, "2020-01-01 00:00:00")])).count() == 0
    only = regular_grid(table(spark, [("a", 60, NAN, "2020-01-01 00:00:00"), ("a", 60, INF, "2020-01-01 02:00:00")])).orderBy("period_us").collect()
    assert [(r.status, r.x) for r in only] == [("repaired", None), ("missing", None), ("repaired", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_totals_against_brute_force(spark, seed):
    rows = random_rows(seed)
    got = {(r.feed, r.day_utc): r for r in rolling_totals(table(spark, rows), (1, 3, 7, 30)).collect()}
    by = defaultdict(dict)
    for (feed, _), at in readings_of(rows).items():
        by[feed].update(at)
    want = {}
    for feed, at in by.items():
        days = [w.date() for w in at]
        for i in range((max(days) - min(days)).days + 1):
            d = min(days) + dt.timedelta(days=i)
            sums = []
            for w in (1, 3, 7, 30):
                v = [x for t, (x, _) in at.items() if d - dt.timedelta(days=w) < t.date() <= d and math.isfinite(x)]
                sums.append((len(v), math.fsum(v) if v else None))
            want[feed, d.isoformat()] = (days.count(d), sums)
    assert set(got) == set(want)
    for key, (n, sums) in want.items():
        assert got[key].n_readings == n
        for w, (c, s) in zip((1, 3, 7, 30), sums):
            assert got[key][f"n_{w}d"] == c
            assert got[key][f"sum_{w}d"] == (None if s is None else pytest.approx(s))
            assert got[key][f"mean_{w}d"] == (None if s is None else pytest.approx(s / c))


def test_rolling_of_nothing(spark):
    assert rolling_totals(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        rolling_totals(table(spark, []), (0,))


def far(values):
    m = median(values)
    d = median(abs(v - m) for v in values)
    return lambda x: abs(x - m) > 15 * d


@pytest.mark.parametrize("seed,few", [(1, 50_000), (2, 0), (3, 50_000)])
@pytest.mark.parametrize("hours", [3, 400])
def test_flags_against_brute_force(spark, seed, few, hours):
    rows = random_rows(seed, 400)
    got = {r.id: r for r in flag_values(feed_rows(table(spark, rows), block_us=hours * 3_600_000_000), order="us", few=few).collect()}
    by = defaultdict(dict)
    for (feed, _), at in readings_of(rows).items():
        by[feed].update(at)
    seen = set()
    for at in by.values():
        line = [at[t] for t in sorted(at)]
        good = [x for x, _ in line if math.isfinite(x) and x >= -100]
        is_far = far(good) if good else None
        run = []
        for x, i in [*line, (None, None)]:
            if run and x != run[0][0]:
                for y, j in run:
                    assert got[j].stuck == (len(run) >= 6 and y != 0), (j, run)
                run = []
            if i is None:
                continue
            seen.add(i)
            if math.isfinite(x) and x >= -100:
                run.append((x, i))
                assert not got[i].impossible
                assert got[i].far == is_far(x)
            else:
                assert got[i].impossible and not got[i].far
    assert set(got) == seen


def test_flags_of_measures(spark):
    rows = [(i, "s" if i % 3 else None, x, -x if x is not None else None, dt.datetime(2020, 1, 1, i % 24)) for i, x in enumerate([1.0, 1.1, 0.9, 1.2, 1.0, 0.8, 1.05, NAN, INF, None, 50.0, 1.0, 1.0, 1.01] * 3)]
    df = spark.createDataFrame(rows, "row_id long, stock_code string, a double, b double, ranked_at timestamp_ntz")
    got = {(r.k.split("|")[0], r.id): r for r in flag_values(measure_rows(df, "stock_code", ["a", "b"], "row_id", "ranked_at")).collect()}
    for col in (2, 3):
        for s in ("s", None):
            values = [r[col] for r in rows if r[1] == s and r[col] is not None and math.isfinite(r[col]) and r[col] >= -100]
            is_far = far(values)
            for r in rows:
                if r[1] == s and r[col] is not None:
                    f = got["ab"[col - 2], r[0]]
                    assert f.far == (math.isfinite(r[col]) and r[col] >= -100 and is_far(r[col]))
    assert flag_values(measure_rows(df.limit(0), "stock_code", ["a"], "row_id", "ranked_at")).count() == 0


def test_rate_and_fence(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [("f", 60, 0.01 * (i % 7) + (30.0 if i == 100 else 0.0), (start + dt.timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S")) for i in range(300)]
    got = {r.id: r for r in flag_values(feed_rows(table(spark, rows)), order="us").collect()}
    assert got[100].rate and got[100].fenced and got[100].far
    assert sum(r.fenced for r in got.values()) == 1


@pytest.mark.parametrize("few", [50_000, 100])
def test_a_source_with_all_values_in_two_cells(spark, few):
    """100,000 values between 100 and 101: the sketch tells nothing, the exact median and MAD come from narrowing."""
    n = 100_000
    spread = ((F.col("id") * 7_919) % n / n).alias("x")
    x = F.when(F.col("id") == 7, 106.0).when(F.col("id") == 11, 101.9).when(F.col("id") == 13, 94.0).otherwise(100 + spread)
    rows = spark.range(n).select(F.lit("=hot").alias("k"), (F.col("id") % 9).alias("block"), (F.col("id") % 24).cast("int").alias("hour"), "id", x.alias("x"))
    got = {r.id for r in flag_values(rows, far=15.0, few=few).where("far").collect()}
    values = {i: 100 + (i * 7_919) % n / n for i in range(n)} | {7: 106.0, 11: 101.9, 13: 94.0}
    is_far = far(list(values.values()))
    assert got == {i for i, v in values.items() if is_far(v)} == {7, 13}


def test_values_at_ranks(spark):
    """Ranks of skewed groups, with intervals that never hold few values, against sorted lists."""
    from lagweave.operators.narrowing import values_at

    r = random.Random(8)
    data = {"a": [r.gauss(0, 1) for _ in range(400)], "b": [r.choice([1.0, 2.0, 3.0]) for _ in range(90)], "c": [5.0], "d": [10.0**e for e in range(-9, 9)]}
    counts = spark.createDataFrame([(k, x, v.count(x)) for k, v in data.items() for x in set(v)], "k string, x double, n long")
    wanted = [(k, q * (len(v) - 1) // 4) for k, v in data.items() for q in range(5)]
    state = spark.createDataFrame([(k, w, 0, min(data[k]), max(data[k])) for k, w in sorted(set(wanted))], "k string, r long, below long, lo double, hi double")
    for few in (0, 10_000):
        got = {(g.k, g.r): g.v for g in values_at(counts, state, splits=3, few=few).collect()}
        assert got == {(k, w): sorted(data[k])[w] for k, w in wanted}


def test_rate_after_a_value_that_is_no_number(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [("f", 60, NAN if i == 50 else 0.01 * (i % 7), (start + dt.timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S")) for i in range(100)]
    got = flag_values(feed_rows(table(spark, rows)), order="us").where("rate OR impossible").collect()
    assert [(r.id, r.rate, r.impossible) for r in got] == [(50, False, True)]


def test_no_folder_of_this_machine_on_a_cluster(spark, monkeypatch):
    """Without spark.checkpoint.dir only a session within one process may write intermediate tables."""
    from types import SimpleNamespace

    from lagweave.session import ensure_checkpoint_dir

    def session(master):
        made = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append, getConf=lambda: {})
        return SimpleNamespace(sparkContext=sc, conf={}), made

    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(session(master)[0])
    for master in ("local", "local[8]", "local[*]"):
        s, made = session(master)
        ensure_checkpoint_dir(s)
        assert len(made) == 1


def test_tables_go_when_they_are_done(spark):
    from lagweave.session import _FOLDERS, discard, stored

    first = stored(spark.range(5))
    path = _FOLDERS[first]
    second = stored(first.selectExpr("id + 1 AS id"), done=[first])
    import os

    assert not os.path.exists(path.removeprefix("file:")) and second.count() == 5
    discard(second, spark.range(1))
    assert second not in _FOLDERS


def test_cells_ascend(spark):
    values = sorted([0.0, -0.0, 1e-300, 5e-324, 1.0, 1.01, -1.0, -1.2, 1e300, -1e300, 3.14, 1.7976931348623157e308, -1.7976931348623157e308])
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", cell_of(F.col("x")).alias("c")).collect()
    cells = [r.c for r in sorted(df, key=lambda r: r.x)]
    assert cells == sorted(cells)


def test_spread_join_keeps_every_row(spark):
    rows = spark.range(1_000).select(F.col("id"), F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = spread_join(rows, groups, ["k"], "n", "id", hot=2, least=100, spread=8)
    assert got.count() == 1_000
    assert got.where("k = 'hot' AND n = 600").count() == 600
