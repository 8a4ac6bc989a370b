"""Rules as text and as typed conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a condition as written, NAME(t-delay).
CONDITION = r"(?s)^(.+)\(t-(\d+)\)$"
#: The same in normal form, see normalized.
WRITTEN = r"^(.+)t(\d+)$"
SLOTS = 8


def normalized(slots: list[str]) -> Column:
    """The slots' texts, each once, as ASCII letters and digits alone in lower case: a condition however it is written."""
    return F.transform(F.array(*slots), lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")))


def filled(text: Column) -> Column:
    """Whether a normalized slot holds a condition: an empty one is NULL, 0 or nothing but other characters."""
    return text.isNotNull() & (text != "") & (text != "0")


def condition_key(slots: list[str]) -> Column:
    """Text of the set of conditions in the slots, however written and in any order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(normalized(slots), filled))), "&")


def parse_condition(c: Column) -> Column:
    """struct(attr, delay), or NULL for an empty slot (NULL, blank, 0, -) and for text that is no condition."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(text.rlike(CONDITION), F.struct(F.regexp_extract(text, CONDITION, 1).alias("attr"), F.regexp_extract(text, CONDITION, 2).try_cast("int").alias("delay")))


def parse_normalized(text: Column) -> Column:
    """struct(attr, delay) of a normalized slot; NULL for an empty one alone. Text without a delay is an attr with delay NULL."""
    delay = F.regexp_extract(text, WRITTEN, 2).try_cast("int")
    attr = F.when(delay.isNull(), text).otherwise(F.regexp_extract(text, WRITTEN, 1))
    return F.when(filled(text), F.struct(attr.alias("attr"), delay.alias("delay")))


def parse_rules(df: DataFrame, slots: list[str], rule_id: str = "rule_id", stop_at_gap: bool = False, any_writing: bool = False) -> DataFrame:
    """rule_id, conds (array in slot order), k, max_d. stop_at_gap drops the conditions after the first empty slot; any_writing reads them in normal form."""
    each = F.transform(normalized(slots), parse_normalized) if any_writing else F.array(*(parse_condition(F.col(s)) for s in slots))
    if stop_at_gap:
        first_gap = F.array_position(F.transform(each, lambda c: c.isNull().cast("int")), F.lit(1))
        each = F.when(first_gap == 0, each).otherwise(F.slice(each, 1, F.greatest(first_gap - 1, F.lit(0)).cast("int")))
    conds = F.filter(each, lambda c: c.isNotNull())
    return df.select(rule_id, conds.alias("conds")).select("*", F.size("conds").alias("k"), F.coalesce(F.array_max(F.transform("conds", lambda c: c["delay"])), F.lit(0)).alias("max_d"))


def write_condition(c: Column) -> Column:
    return F.concat(c["attr"], F.coalesce(F.concat(F.lit("(t-"), c["delay"].cast("string"), F.lit(")")), F.lit("")))


def write_rule(rules: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Typed conditions back to slot columns attr1, attr2, ...; empty slots are 0."""
    return rules.select("*", *(F.coalesce(write_condition(F.get("conds", F.lit(i))), F.lit("0")).alias(f"attr{i + 1}") for i in range(slots)))


def attribute_summary(conds: Column, shown: int = 3) -> Column:
    """The first conditions, and how many more there are."""
    names = F.transform(conds, write_condition)
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(F.size(names) > shown, F.concat(F.lit(" ... (+"), (F.size(names) - shown).cast("string"), F.lit(")"))).otherwise(""))


def conditions(rules: DataFrame) -> DataFrame:
    """rule_id, pos, attr, delay, k, max_d: one row per condition."""
    return rules.select("rule_id", "k", "max_d", F.posexplode("conds").alias("pos", "c")).select("rule_id", "pos", "c.attr", "c.delay", "k", "max_d")
