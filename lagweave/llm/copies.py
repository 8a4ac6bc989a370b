"""Copies of rules that differ only in writing and in the order of their conditions.

Method. Each distinct normalized condition is hashed together with its field's name; the hashes of a rule are added, so
their order plays no part (a multiset hash over distinct pairs, i.e. over the set). Rules are grouped by exact group key
and fingerprint; each member's conditions are compared with those of the group's first rule as sets, without sorting.
Members of another set (a collision of fingerprints) are regrouped among themselves by their sorted conditions, so the
result is exact whatever the hash does.

Scale. Grouping is a hash aggregate of numbers, combined on the map side. A rule's conditions travel once to its group, as one
text; only rules with copies go on to be compared with their group's first. Both joins spread the heaviest groups. The
hashed rows and the labels are written once each, as both are read several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions.keys import decode_key, encode_key
from lagweave.operators.skew import spread_join
from lagweave.session import stored

#: Bits of each of the two words; sums of 128 hashes still fit a long.
HASH_BITS = 56


def normalized(c: Column) -> Column:
    """ASCII letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def condition_set(fields: list[str]) -> Column:
    """Distinct normalized conditions of the fields, in any order; empty slots (NULL, nothing but other characters, 0) left out."""
    each = F.array(*(normalized(F.col(f).cast("string")) for f in fields))
    return F.array_distinct(F.filter(each, lambda v: v.isNotNull() & (v != "") & (v != "0")))


def fingerprint(values: Column, field: str, word: int, bits: int = HASH_BITS) -> Column:
    """Sum of the hashes of the (field, value) pairs; word picks one of independent hashes."""
    mask = F.lit((1 << bits) - 1)
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + F.xxhash64(F.lit(word), F.lit(field), v).bitwiseAND(mask))


def label_copies(df: DataFrame, fields: list[str], group: str, row_id: str, bits: int = HASH_BITS, least_hot: int = 10_000) -> DataFrame:
    """Columns group, row_id, first: each row with the smallest row_id among the rows equal to it (its own if it is alone).

    Rows are equal if group is the same (NULL equals NULL) and the sets of conditions in fields are. Rows without any
    condition are equal to each other. Rows with NULL row_id are left out. Other columns are not read. An empty table gives no rows.
    """
    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), encode_key(F.col(group)).alias("k"), condition_set(fields).alias("conditions"))
    rows = stored(rows.select("id", "k", *(fingerprint(F.col("conditions"), "condition", w, bits).alias(f"f{w}") for w in (1, 2)), F.array_join("conditions", " ").alias("text")))
    keys = ["k", "f1", "f2"]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    met = spread_join(rows, groups, keys, "n", "id", least=least_hot)
    several = lambda c: F.when(F.col("n") > 1, F.col(c)).alias(c)
    met = stored(met.select("id", "k", "first", "n", *map(several, ("f1", "f2", "text"))), done=[rows])
    heads = met.where("id = first AND n > 1").groupBy(*keys).agg(F.max("n").alias("n"), F.min("text").alias("head"))  # one, also where an id repeats
    others = spread_join(met.where("id <> first").drop("n"), heads, keys, "n", "id", least=least_hot)
    own, head = F.split("text", " "), F.split("head", " ")  # conditions hold letters and digits alone
    same = (F.size(own) == F.size(head)) & (F.size(F.array_except(own, head)) == 0)
    others = stored(others.select("id", "k", "first", F.when(~same, F.array_join(F.array_sort(own), " ")).alias("text")))
    out = met.where("id = first").select("k", "id", "first").unionByName(others.where("text IS NULL").select("k", "id", "first"))
    strays = others.where("text IS NOT NULL").select("id", "k", "text")
    if not strays.isEmpty():
        heads = strays.groupBy("k", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        out = out.unionByName(spread_join(strays, heads, ["k", "text"], "n", "id", least=least_hot).select("k", "id", "first"))
    return out.select(decode_key(F.col("k")).alias(group), F.col("id").alias(row_id), "first")


def collapse_copies(df: DataFrame, fields: list[str], group: str, row_id: str, bits: int = HASH_BITS) -> DataFrame:
    """One row per distinct rule: group, row_id of the first, copies."""
    labels = label_copies(df, fields, group, row_id, bits)
    return labels.groupBy(group, F.col("first").alias(row_id)).agg(F.count(F.lit(1)).alias("copies"))
