"""Readers, writers, streaming."""

import pytest
from pyspark.sql import functions as F

from lagweave.operators import prep
from lagweave.operators.rules import parse_rules
from lagweave.sources import readers, writers
from lagweave.streaming.bars import bars, moves


def test_mining_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A_Up , A_Down,X,timestamp\r\n1,0, 0.5 ,2020-01-01\r\n2,,oops,2020-01-02\r\n0,1,,2020-01-03\r\n")
    t = readers.mining_table(spark, str(tmp_path / "a.csv"))
    assert t.columns == ["A_Up", "A_Down", "X", "T", "ts"]
    assert [(r.A_Up, r.A_Down, r.X) for r in t.orderBy("T").collect()] == [(1, 0, 0.5), (2, None, 0.0), (0, 1, 0.0)]
    assert sorted((r.i, r.attr) for r in readers.table_items(t).collect()) == [(0, "A_Up"), (2, "A_Down")]
    (tmp_path / "b.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError):
        readers.mining_table(spark, str(tmp_path / "b.csv"))
    assert readers.present(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")]) == [str(tmp_path / "a.csv")]


def test_prices_and_candles(spark, tmp_path):
    (tmp_path / "p.csv").write_text("timestamp,USD,EUR\n2020-01-01 00:00:00,1.5,\n2020-01-02T00:00:00+00:00,bad,2\n")
    assert sorted((r.inst, r.price) for r in readers.price_table(spark, str(tmp_path / "p.csv")).collect()) == [("EUR", 2.0), ("USD", 1.5)]
    (tmp_path / "k.csv").write_text("1577836800000,1,2,0.5,1.7,10,1577840399999,9,3,1,1,0\n")
    r = readers.klines(spark, str(tmp_path / "k.csv"), "BTC").first()
    assert (r.price, str(r.ts)) == (1.7, "2020-01-01 00:00:00")


def test_pool_round_trip(spark, tmp_path):
    slots = [f"attr{i}" for i in range(1, 9)]
    rows = spark.createDataFrame([(1, "A_Up(t-1)", "B_Down(t-0)", *["0"] * 6)], "rule_id int, " + ", ".join(f"{s} string" for s in slots))
    stats = {f"x{k}_{s}": F.lit(0.5) for k in (1, 2) for s in ("mean", "sigma", "min", "max")}
    full = parse_rules(rows, slots).withColumns(stats | {"support_count": F.lit(7), "support_rate": F.lit(0.25), "quadrant": F.lit("Q1(++)"), "concentration": F.lit(0.75)})
    writers.write_pool(full, str(tmp_path / "pool"))
    got = readers.rule_pool(spark, [str(tmp_path / "pool" / "*.csv")])
    r = got.first()
    assert (r.Attr1, r.Attr3, r["X(t+1)_mean"], r.support_rate, r.NumAttr) == ("A_Up(t-1)", "0", 0.5, 0.25, 2.0)
    lines = [r.line for r in writers.pool_summary(full).orderBy("place").collect()]
    assert lines[0] == "Rules: 1, greatest support 7" and lines[1].startswith("Rule 1: support 7")
    assert readers.rule_pool(spark, [str(tmp_path / "none.csv")]).count() == 0


def test_match_files_reports_and_headerless(spark, tmp_path):
    (tmp_path / "rule_007.csv").write_text("RowIndex,X(t+1),X(t+2)\n5,0.25,-\n")
    r = readers.match_files(spark, str(tmp_path / "rule_*.csv")).first()
    assert (r.rule_id, r["X(t+1)"], r["X(t+2)"]) == (7, 0.25, None)
    (tmp_path / "report.txt").write_text("Rule 3:\n a | b \n----+----\n 1 | 2 \n======\nRule 4:\n c | d \n")
    assert [(b.rule, b.cells) for b in readers.block_report(spark, str(tmp_path / "report.txt")).orderBy("line").collect()] == [(3, ["a", "b"]), (3, ["1", "2"]), (4, ["c", "d"])]
    (tmp_path / "h.csv").write_text("".join(f"1,0,{i}.5,2020\n" for i in range(5)) + "1,0,x,2020\n")
    assert readers.headerless(spark, str(tmp_path / "h.csv"), least=5).count() == 5
    assert readers.headerless(spark, str(tmp_path / "h.csv"), least=6).count() == 0


def test_wide_and_matches(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "inst string, v int")
    writers.write_wide(df, str(tmp_path / "w"), "inst")
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).count() == 2
    writers.write_matches(df.withColumn("rule_id", F.lit(3)), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("rule_id = 3").count() == 2
    writers.write_ranked(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["inst", "v"]


def test_synthetic(spark):
    got = readers.synthetic_prices(spark, ["a", "b"], 50)
    assert got.count() == 100 and got.exceptAll(readers.synthetic_prices(spark, ["a", "b"], 50)).count() == 0


def test_streamed_bars_equal_batch(spark, tmp_path):
    ticks = spark.range(400).select(F.concat(F.lit("i"), F.col("id") % 2).alias("inst"), F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 600).alias("ts"), ((F.col("id") * 7919) % 13 + 1).cast("double").alias("price"))
    ticks.repartition(1).write.parquet(str(tmp_path / "ticks"))
    def run(df, kind, **options):
        w = df.writeStream.format(kind).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{kind}")).trigger(availableNow=True)
        q = w.options(**options).queryName("moved").start()
        q.awaitTermination(120)

    run(bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))), "parquet", path=str(tmp_path / "bars"))
    run(moves(spark.readStream.schema("inst string, ts timestamp, price double").parquet(str(tmp_path / "bars"))), "memory")
    got = {(r.inst, r.ts): r for r in spark.table("moved").collect()}
    batch = ticks.groupBy("inst", F.window("ts", "1 hour").start.alias("ts")).agg(F.avg("price").alias("price")).withColumn("i", F.col("ts"))
    want = {(r.inst, r.ts): r for r in prep.with_returns(batch).collect()}
    assert len(got) > 50
    for key, r in got.items():
        assert r.price == pytest.approx(want[key].price)
        assert r.x == (None if want[key].x is None else pytest.approx(want[key].x)) or (r.x != r.x and want[key].x is None)
