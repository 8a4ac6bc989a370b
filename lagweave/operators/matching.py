"""Where rules match: every condition's item is 1, delay rows before t.

Relational matching joins the sparse items with the conditions on the attribute, moves each by its delay and keeps the (rule, t)
that all conditions reach: equal keys only, so Spark broadcasts the rules if they are small and shuffles by attribute if not, and the count
combines on the map side. Conditions of a rule are distinct and items unique, so a full count is a match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators.rules import conditions
from lagweave.session import stored


@dataclass(frozen=True)
class Range:
    """Valid rows of a match: start (the rule's greatest delay, or a number) up to n - span."""

    start: int | None = None
    span: int = 2
    per_condition: bool = False  # each condition needs only its own delay; the rule's start is then its own greatest all the same
    ignore_unknown: bool = False  # conditions on attributes that never occur are left out


#: The ranges in use. M1: miner; M2: graph evaluation; M3: one future value; M4: the row itself; M7: unknown attributes ignored; M8: whole series.
RANGES = {"m1": Range(), "m2": Range(start=5), "m3": Range(span=1), "m4": Range(span=0), "m7": Range(span=1, ignore_unknown=True), "m8": Range(start=0)}


def hits(rules: DataFrame, items: DataFrame) -> DataFrame:
    """rule_id, t, max_d of the rows where all conditions hold, and inst if items has it; rules without conditions have none here."""
    own = [c for c in ("inst",) if c in items.columns]
    c = conditions(rules).dropDuplicates(["rule_id", "attr", "delay"])
    need = Window.partitionBy("rule_id")
    c = c.withColumn("need", F.count(F.lit(1)).over(need))
    met = items.join(c, "attr").select(*own, "rule_id", "need", "max_d", (F.col("i") + F.col("delay")).alias("t"))
    return met.groupBy(*own, "rule_id", "t", "need", "max_d").agg(F.count(F.lit(1)).alias("got")).where("got = need").select(*own, "rule_id", "t", "max_d")


def matches(rules: DataFrame, items: DataFrame, series: DataFrame, valid: Range = RANGES["m1"], empty_matches: bool = False) -> DataFrame:
    """inst, rule_id, t and the series' columns at t, for one or more target series sharing the items' axis, or each with the items of its own inst.

    series: inst, i, n, ... (see prep.targets). empty_matches: rules without conditions match every valid row.
    """
    if valid.ignore_unknown:
        known = items.select("attr").distinct()
        kept = conditions(rules).join(known, "attr", "left_semi").groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("pos", "attr", "delay"))).alias("conds"))
        rules = kept.select("rule_id", F.transform("conds", lambda x: F.struct(x["attr"].alias("attr"), x["delay"].alias("delay"))).alias("conds"), F.size("conds").alias("k"), F.array_max(F.transform("conds", lambda x: x["delay"])).alias("max_d"))
    got = hits(rules, items)
    own = ["inst"] if "inst" in items.columns else []
    out = series.join(got.withColumn("i", F.col("t")), [*own, "i"]).where(F.col("t") < F.col("n") - valid.span)
    out = out.where(F.col("t") >= (F.col("max_d") if valid.start is None else F.lit(valid.start)))
    out = out.select("rule_id", "t", *(c for c in series.columns if c != "i"))
    if empty_matches:
        # Such a rule takes every row, so rules meet rows in parts, and each part holds a share of the rows.
        parts, start = 64, valid.start or 0
        free = rules.where("k = 0").select("rule_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
        every = series.where((F.col("i") >= start) & (F.col("i") < F.col("n") - valid.span)).withColumn("_part", F.pmod("i", F.lit(parts)).cast("int"))
        out = out.unionByName(every.join(free, "_part").select("rule_id", F.col("i").alias("t"), *(c for c in series.columns if c != "i")))
    return out


def extreme_subset(series: DataFrame, threshold: float = 1.0) -> DataFrame:
    """The rows beyond the threshold on the side that has more of them (a tie goes to the negative), numbered anew in j; n is their number."""
    counted = series.select("*", F.count_if(F.col("x0") >= threshold).over(Window.partitionBy("inst")).alias("_p"), F.count_if(F.col("x0") <= -threshold).over(Window.partitionBy("inst")).alias("_m"))
    kept = counted.where(F.when(F.col("_p") > F.col("_m"), F.col("x0") >= threshold).otherwise(F.col("x0") <= -threshold))
    return kept.select("inst", "i", "ts", "x0", (F.row_number().over(Window.partitionBy("inst").orderBy("i")) - 1).cast("long").alias("j"), F.count(F.lit(1)).over(Window.partitionBy("inst")).alias("n"))


def match_extreme(rules: DataFrame, items: DataFrame, series: DataFrame, threshold: float = 1.0) -> DataFrame:
    """M5, for one or more targets: lags run over each target's extreme rows alone."""
    kept = extreme_subset(series, threshold)
    moved = kept.join(items, "i").select("inst", F.col("j").alias("i"), "attr")
    return matches(rules, moved, kept.select("inst", F.col("j").alias("i"), "ts", "n", "x0"), RANGES["m4"])


def match_progressive(rules: DataFrame, items: DataFrame, series: DataFrame) -> DataFrame:
    """M6, for one or more targets: each condition's lag runs over the rows that survived the conditions before it.

    One step per position; the survivors are written out in between, as each step reads them twice.
    """
    c = conditions(rules)
    slots = c.agg(F.max("k")).first()[0] or 0
    items = stored(items)
    base = series.select("inst", "i")
    frame = None
    for pos in range(slots):
        at = c.where(F.col("pos") == pos).select("rule_id", "attr", "delay", "k")
        if frame is None:
            # The first condition runs over the full series: an ordinary lag.
            kept = items.join(at, "attr").select("rule_id", "k", (F.col("i") + F.col("delay")).alias("i")).join(base, "i")
            done = kept.where("k = 1").select("inst", "rule_id", "i")
        else:
            numbered = frame.withColumn("j", F.row_number().over(Window.partitionBy("inst", "rule_id").orderBy("i")))
            need = numbered.join(at.drop("k"), "rule_id")
            source = numbered.select("inst", "rule_id", F.col("j").alias("_j"), F.col("i").alias("_i"))
            lagged = need.join(source, (need.inst == source.inst) & (need.rule_id == source.rule_id) & (need.j - need.delay == source._j)).select(need.inst, need.rule_id, "k", "i", "attr", "_i")
            kept = lagged.join(items.select(F.col("i").alias("_i"), "attr"), ["_i", "attr"], "left_semi").select("inst", "rule_id", "k", "i")
            done = done.unionByName(kept.where(F.col("k") == pos + 1).select("inst", "rule_id", "i"))
        frame = stored(kept.where(F.col("k") > pos + 1))
    if frame is None:
        return series.select(F.lit(None).cast("int").alias("rule_id"), F.col("i").alias("t"), *(x for x in series.columns if x != "i")).limit(0)
    return series.join(done.withColumn("t", F.col("i")), ["inst", "i"]).select("rule_id", "t", *(x for x in series.columns if x != "i"))


def rule_stats(matched: DataFrame, span: int = 2, sample_sd: bool = False, horizons: int = 2) -> DataFrame:
    """Per target and rule: matches, support (n over the rows a match could have), mean, deviation, least and greatest of each future value, deviation measure."""
    sd = (lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))) if sample_sd else F.stddev_pop
    per = [f(f"x{k}").alias(f"x{k}_{name}") for k in range(1, horizons + 1) for name, f in (("mean", F.avg), ("sigma", sd), ("min", F.min), ("max", F.max))]
    got = matched.groupBy("inst", "rule_id", "max_d", "n").agg(F.count(F.lit(1)).alias("support_count"), *per)
    widest = [F.greatest(F.abs(F.col(f"x{k}_min")), F.abs(F.col(f"x{k}_max"))) for k in range(1, horizons + 1)]
    total = widest[0]
    for w in widest[1:]:
        total = total + w
    return got.withColumn("support_rate", F.col("support_count") / (F.col("n") - F.col("max_d") - span)).withColumn("deviation", total / horizons)


def directional_stats(matched: DataFrame, x: str = "x1") -> DataFrame:
    """Win rate, profit factor and expectancy; zeros are on neither side."""
    c = F.col(x)
    pos, neg = c > 0, c < 0
    got = matched.groupBy("inst", "rule_id").agg(
        F.count_if(pos).alias("pos_count"), F.count_if(neg).alias("neg_count"),
        F.avg(F.when(pos, c)).alias("pos_mean"), F.avg(F.when(neg, c)).alias("neg_mean"),
        F.sum(F.when(pos, c)).alias("_gain"), F.sum(F.when(neg, -c)).alias("_loss"),
    )
    win = F.try_divide(F.col("pos_count"), F.col("pos_count") + F.col("neg_count"))
    got = got.withColumn("win_rate", win).withColumn("profit_factor", F.try_divide(F.col("_gain"), F.col("_loss"))).drop("_gain", "_loss")
    return got.withColumn("expectancy", F.col("win_rate") * F.coalesce("pos_mean", F.lit(0.0)) + (1 - F.col("win_rate")) * F.coalesce("neg_mean", F.lit(0.0)))


def verification_rows(rules: DataFrame, matched: DataFrame, times: DataFrame) -> DataFrame:
    """One row per match and condition: the condition and the time of the row it looked at."""
    c = conditions(rules)
    m = matched.select("inst", "rule_id", "t", "ts", "x1", "x2").join(c, "rule_id").withColumn("at", F.col("t") - F.col("delay"))
    seen = times.select("inst", F.col("i").alias("at"), F.col("ts").alias("seen_ts"))
    label = F.concat("attr", F.lit("("), F.date_format("seen_ts", "yyyy-MM-dd"), F.lit(")"))
    return m.join(seen, ["inst", "at"], "left").select("inst", "rule_id", F.col("t").alias("row_index"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), "pos", "delay", label.alias("cell"), "x1", "x2")
