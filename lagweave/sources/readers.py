"""Readers of the text formats: mining tables, prices, rule pools, match files, block reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.operators.prep import ordinals

TIME_NAMES = ("T", "timestamp")


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths (patterns allowed) that match a file; a missing file is left out, not an error."""
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        matched = path.getFileSystem(conf).globStatus(path)
        if matched is not None and len(matched):
            found.append(p)
    return found


def _trimmed(df: DataFrame) -> DataFrame:
    return df.select(*(F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", "").alias(c.strip()) for c in df.columns))


def mining_table(spark: SparkSession, path: str) -> DataFrame:
    """A header CSV of 0/1 attributes, X and T (or timestamp): attributes as tinyint, X as double (0.0 where unreadable), T as text, ts parsed.

    Empty cells are NULL; columns never shift.
    """
    raw = _trimmed(spark.read.csv(path, header=True, enforceSchema=False))
    time = next((c for c in TIME_NAMES if c in raw.columns), None)
    if "X" not in raw.columns or time is None:
        raise ValueError(f"{path} has no X or no {' / '.join(TIME_NAMES)} column")
    attrs = [c for c in raw.columns if c not in ("X", time)]
    return raw.select(*(F.col(f"`{c}`").try_cast("tinyint").alias(c) for c in attrs), F.coalesce(F.col("X").try_cast("double"), F.lit(0.0)).alias("X"), F.col(f"`{time}`").alias("T"), F.col(f"`{time}`").try_cast("timestamp_ntz").alias("ts"))


def table_items(table: DataFrame, order: str = "ts") -> DataFrame:
    """i, attr of the cells that are 1 in a mining table; 2 and other values are no match. Rows are numbered by their distinct times, block by block; those without a time have no place."""
    attrs = [c for c, t in table.dtypes if t == "tinyint"]
    numbered = table.join(ordinals(table, order), order)
    each = F.explode(F.filter(F.array(*(F.when(F.col(f"`{a}`") == 1, F.lit(a)) for a in attrs)), lambda a: a.isNotNull()))
    return numbered.select("i", each.alias("attr"))


def price_table(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV of closing prices to long inst, ts, price."""
    raw = _trimmed(spark.read.csv(path, header=True))
    time = next((c for c in ("timestamp", "T") if c in raw.columns), None)
    if time is None:
        raise ValueError(f"{path} has no timestamp or T column")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("inst"), F.col(f"`{c}`").try_cast("double").alias("price")) for c in raw.columns if c != time)))
    ts = F.coalesce(F.to_utc_timestamp(F.col(f"`{time}`").try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"), F.col(f"`{time}`").try_cast("timestamp_ntz"))
    return raw.select(ts.alias("ts"), cells.alias("c")).select("c.inst", "ts", "c.price").where("price IS NOT NULL AND ts IS NOT NULL")


KLINE = "open_ms long, open double, high double, low double, close double, volume double, close_ms long, quote_volume double, trades long, taker_base double, taker_quote double, ignored string"


def klines(spark: SparkSession, path: str, inst: str | None = None) -> DataFrame:
    """Twelve-column candle records without a header, to inst, ts, price: only the time and the close are read on.

    path: a file, or a folder of pages, which may overlap: one close stays for each time, that of the last page by name. Without inst the folder is divided into inst=... folders.
    """
    schema = KLINE if inst is not None else KLINE + ", inst string"
    raw = spark.read.schema(schema).option("recursiveFileLookup", inst is not None).csv(path).where("open_ms IS NOT NULL")
    own = F.lit(inst) if inst is not None else F.col("inst")
    got = raw.select(own.alias("inst"), F.timestamp_millis("open_ms").cast("timestamp_ntz").alias("ts"), "close", F.input_file_name().alias("page"))
    return got.groupBy("inst", "ts").agg(F.max_by("close", "page").alias("price"))


def rule_pool(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tab-separated rule pools, several files at once, with source_file; slots as text, numbers as double. Paths without a file are left out; with none at all the frame is empty."""
    there = present(spark, paths)
    if not there:
        return spark.createDataFrame([], ", ".join([*(f"Attr{i} string" for i in range(1, 9)), "source_file string"]))
    raw = spark.read.csv(there, header=True, sep="\t").withColumn("source_file", F.input_file_name())
    raw = raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns))
    text = {"source_file", "Quadrant"} | {c for c in raw.columns if c.lower().startswith("attr")}
    return raw.select(*(F.col(f"`{c}`") if c in text else F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns))


def match_table(spark: SparkSession, path: str) -> DataFrame:
    """Matches as write_matches leaves them: a condition on rule_id reads the folders of those rules alone."""
    return spark.read.parquet(path)


def match_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Per-rule match files rule_<id>.csv, or folders rule_id=<id> of such files, as one table, the id taken from the name; '-' is NULL."""
    raw = spark.read.csv(pattern, header=True)
    rule = F.regexp_extract(F.input_file_name(), r"/rule_(?:id=)?0*(\d+)(?:\.csv$|/[^/]*$)", 1).try_cast("int")
    numbers = [c for c in raw.columns if c.startswith("X(")]
    return raw.select(rule.alias("rule_id"), *(F.col(f"`{c}`").try_cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in raw.columns))


def headerless(spark: SparkSession, path: str, least: int = 100, sep: str = ",") -> DataFrame:
    """X of files without a header: the second-last field, unreadable values left out, series with fewer than `least` values too."""
    lines = spark.read.text(path).withColumn("source_file", F.input_file_name())
    parts = F.split("value", sep)
    x = lines.select("source_file", F.get(parts, F.size(parts) - 2).try_cast("double").alias("x")).where("x IS NOT NULL")
    enough = x.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("source_file")
    return x.join(enough, "source_file", "left_semi")


def block_report(spark: SparkSession, path: str) -> DataFrame:
    """Text reports of blocks 'Rule n:', a line of dashes, rows a|b|c, a line of equals signs: rule, line, cells.

    A file is read as one record, since a block belongs to the heading above it; reports are small by nature.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.posexplode(F.split("value", "\\r?\\n")).alias("line", "t"))
    w = Window.partitionBy("source_file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.regexp_extract("t", r"^\s*Rule\s+(\d+)\s*:", 1).try_cast("int")
    marked = text.withColumn("rule", F.last(heading, ignorenulls=True).over(w))
    return marked.where(F.col("t").contains("|") & F.col("rule").isNotNull() & ~F.col("t").rlike(r"^[\s|+=-]*$")).select("source_file", "rule", "line", F.transform(F.split("t", r"\|"), lambda v: F.trim(v)).alias("cells"))


def synthetic_prices(spark: SparkSession, insts: list[str], rows: int, seed: int = 1) -> DataFrame:
    """Trend, season and noise for each instrument, a pure function of seed, instrument and row."""
    noise = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "inst", "id"), F.lit(1_000_003)) + 1) / 1_000_004.0
    normal = F.sqrt(-2 * F.log(noise(0))) * F.cos(2 * 3.141592653589793 * noise(1))
    base = spark.range(rows).withColumn("inst", F.explode(F.array(*(F.lit(i) for i in insts))))
    price = 100 + 0.01 * F.col("id") + 5 * F.sin(F.col("id") * 2 * 3.141592653589793 / 30) + normal
    return base.select("inst", F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ts"), F.round(price, 2).alias("price"))


def simulated_matches(series: DataFrame, months: list[int], weekdays: list[int], n: int, seed: int = 1) -> DataFrame:
    """At most n rows of each instrument whose month and weekday (Monday is 1) are among those given, drawn by a hash of seed, instrument and time."""
    fits = series.where(F.month("ts").isin(months) & (F.weekday("ts") + 1).isin(weekdays))
    draw = F.row_number().over(Window.partitionBy("inst").orderBy(F.xxhash64(F.lit(seed), "inst", "ts"), "ts"))
    return fits.withColumn("_draw", draw).where(F.col("_draw") <= n).drop("_draw")
