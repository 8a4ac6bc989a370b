"""Queries of the problems tagged llm: 2, 4, 6, 7, 8 and 9."""

from __future__ import annotations

import hashlib
import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.functions.keys import encode_key
from lagweave.llm.copies import collapse_copies, label_copies
from lagweave.llm.languages import ByteNet, detect_languages, fit, label_language, other_languages
from lagweave.llm.packing import pack_items
from lagweave.llm.percentiles import day_summary, decode, exact_percentiles, merged_percentiles
from lagweave.llm.sql import ORACLE  # noqa: F401
from lagweave.llm.tokens import FOLDER, count_tokens, decode_ids, encode_texts, encoder
from lagweave.llm.top_items import top_items
from lagweave.session import stored, table

CONDITIONS = [f"attr{i}" for i in range(1, 9)]
PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_copies(table(spark, sf_dir, "zrp01a"), CONDITIONS, "pool_id", "rule_id")
    return labels.where("rule_id <> first").select(F.col("first").alias("first_rule_id"), F.col("rule_id").alias("dup_rule_id"))


def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct rule once, with its number of copies."""
    return collapse_copies(table(spark, sf_dir, "zrp01a"), CONDITIONS, "pool_id", "rule_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "zrp01a").where("t_statistic > double('-Infinity') AND t_statistic < double('Infinity')")
    order = [F.col("t_statistic").desc(), F.col("support_rate").desc_nulls_last(), F.col("x_sigma").asc_nulls_last(), F.col("rule_id").asc()]
    return top_items(rows.select("pool_id", "rule_id", "t_statistic", "support_rate", "x_sigma"), "pool_id", order, 5).select("pool_id", "rule_id")


def _measured(spark: SparkSession, sf_dir: str, day: bool = False) -> DataFrame:
    """k (measure and source), x of both tables, and the day of arrival if asked."""
    feeds = table(spark, sf_dir, "usdjpy")
    stocks = table(spark, sf_dir, "nikkei225_volatility_ranking")
    days = lambda c: [F.col(c).cast("date").alias("day")] if day else []
    key = lambda measure, c: encode_key(F.concat(F.lit(measure + "|"), encode_key(F.col(c)))).alias("k")
    one = feeds.select(key("x", "feed"), F.col("x"), *days("arrived_at"))
    each = F.explode(F.array(*(F.struct(key(m, "stock_code"), F.col(m).alias("x")) for m in ("volatility_std", "max_x", "min_x"))))
    return one.unionByName(stocks.select(each.alias("e"), *days("ranked_at")).select("e.*", *(["day"] if day else [])))


def _named(df: DataFrame) -> DataFrame:
    """measure and source from the key."""
    df = decode(df, "name")
    source = F.expr("CASE WHEN name NOT LIKE '%|' THEN substring(name, instr(name, '|') + 2) END")
    return df.select(F.substring_index("name", "|", 1).alias("measure"), source.alias("source"), *(c for c in df.columns if c != "name"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each feed's x and each stock's measures; error is the bound of value's error."""
    return _named(exact_percentiles(_measured(spark, sf_dir), PERCENTILES)).withColumn("error", F.lit(0.0))


def p6_day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the percentiles from summaries of single days, merged."""
    return _named(merged_percentiles(day_summary(_measured(spark, sf_dir, day=True), "day"), PERCENTILES))


def p7_ids(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), folder=folder)


def p7_roundtrip(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    """Each text encoded and decoded again; the number of bytes stands for the text."""
    back = decode_ids(p7_ids(spark, sf_dir, folder), folder=folder)
    return back.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"))


def p8_containers(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    """Every text's containers, for each row of pack_sizes. Each tokenizer named is a file of the folder, so there are no more names than files."""
    packs = table(spark, sf_dir, "pack_sizes").where("tokenizer IS NOT NULL").select("pack_id", "tokenizer", F.col("capacity_tokens").alias("capacity"))
    names = [r[0] for r in packs.select("tokenizer").distinct().orderBy("tokenizer").toLocalIterator() if encoder(folder, r[0])]
    sizes = stored(count_tokens(table(spark, sf_dir, "documents"), names, folder=folder))
    return pack_items(stored(sizes.join(packs, "tokenizer").select("pack_id", F.col("doc_id").alias("item_id"), "size", "capacity"), done=[sizes]))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pack: containers, tokens, and the share of their room that is used."""
    got = p8_containers(spark, sf_dir).where("container IS NOT NULL").groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("room").alias("tokens"))
    return got.join(table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens"), "pack_id").withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p8_checks(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    """The rules of packing, counted per pack: texts and their ids, containers over their capacity, texts divided that need not be, texts whose
    pieces are not their size, and whether the share of room used reaches what is there to fill: 0.98 of the containers, but for one.
    """
    packs = table(spark, sf_dir, "pack_sizes").select("pack_id", "tokenizer", F.col("capacity_tokens").alias("capacity"))
    names = [r[0] for r in packs.select("tokenizer").distinct().orderBy("tokenizer").toLocalIterator() if encoder(folder, r[0])]
    wanted = count_tokens(table(spark, sf_dir, "documents"), names, folder=folder).join(packs, "tokenizer")
    got = stored(p8_containers(spark, sf_dir, folder))
    texts = got.groupBy("pack_id", "item_id").agg(F.sum("room").alias("room"), F.count(F.lit(1)).alias("pieces"))
    one = wanted.join(texts.withColumnRenamed("item_id", "doc_id"), ["pack_id", "doc_id"], "left").groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("texts"), F.countDistinct("doc_id").alias("ids"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).cast("int").alias("divided"), F.count_if(~F.col("room").eqNullSafe(F.col("size"))).cast("int").alias("wrong_sizes"),
    )
    bins = got.where("container IS NOT NULL").groupBy("pack_id", "container").agg(F.sum("room").alias("room")).join(packs, "pack_id")
    two = bins.groupBy("pack_id", "capacity").agg(F.count_if(F.col("room") > F.col("capacity")).cast("int").alias("overfull"), F.sum("room").alias("used"), F.count(F.lit(1)).alias("n"))
    return one.join(two.select("pack_id", "overfull", (F.col("used") >= 0.98 * F.col("capacity") * (F.col("n") - 1)).alias("well_filled")), "pack_id")


#: Bounds of what the network is fitted on: sentences of the reference, and loosely labelled texts of at most so many characters.
FIT_REFERENCE, FIT_TEXTS, FIT_CHARS = 20_000, 1_500, 600


_FITTED: dict[int, ByteNet] = {}


def _fit_in_task(spark: SparkSession, clean: list[tuple], texts: list[tuple]) -> ByteNet:
    """The fit runs in one task: Python workers keep to a task's cores, while the driver's matrix library would start threads on all."""

    def run(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*pickle.loads(payload)))], pa.binary())], names=["net"])

    payload = pickle.dumps((clean, texts))
    key = int.from_bytes(hashlib.sha256(payload).digest()[:8], "big")
    if key not in _FITTED:
        _FITTED[key] = pickle.loads(bytes(spark.createDataFrame([(payload,)], "payload binary").mapInArrow(run, "net binary").first()[0]))
    return _FITTED[key]


def language_model(reference: DataFrame, documents: DataFrame, references: int = FIT_REFERENCE, texts: int = FIT_TEXTS, chars: int = FIT_CHARS) -> ByteNet:
    """Fitted on at most `references` clean sentences and `texts` labelled documents of at most `chars` characters, chosen by a hash of their id. The same rows give the same model."""
    clean = reference.where("text IS NOT NULL AND lang IS NOT NULL").orderBy(F.xxhash64("ref_id"), "ref_id").limit(references).select("lang", "text").collect()
    named = documents.select("doc_id", label_language(F.col("lang")).alias("lang"), "text").where(F.col("lang").isNotNull() & F.length("text").between(1, chars))
    loose = named.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(texts).select("lang", "text").collect()
    return _fit_in_task(documents.sparkSession, [tuple(r) for r in clean], [tuple(r) for r in loose])


def _detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    return detect_languages(documents, language_model(table(spark, sf_dir, "lang_reference"), documents)), documents


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return other_languages(*_detected(spark, sf_dir))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and of every stretch."""
    got, _ = _detected(spark, sf_dir)
    return got


QUERIES = {f.__name__: f for f in (p2_found, p2_rules, p4_found, p6_percentiles, p6_day_bounds, p7_ids, p7_roundtrip, p8_containers, p8_fill, p8_checks, p9_found, p9_documents)}
