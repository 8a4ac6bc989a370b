"""Instants written in mixed formats, and arithmetic on them in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blanks that may surround a text, and the shape of a readable instant after trimming and with - for /.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"
INSTANT = r"^\d{4}-\d{2}-\d{2}([T ] *\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?( ?(Z|z|[+-]\d{2}:?\d{2}))?)?$"

DAY_US = 86_400_000_000


def with_instant_us(df: DataFrame, time: str, out: str) -> DataFrame:
    """Adds the microseconds since 1970-01-01 UTC of the instant that the text names, else NULL.

    Without a zone the text is UTC whatever the session's zone; a bare date is midnight.
    Impossible dates or times (30 February, 25:00) name no instant.
    Each step is a projection of its own, so that no text is taken apart twice; only texts with an offset take the
    cast with a zone, which costs several times the other.
    """
    c, at = F.col(time), lambda n: F.col(time).substr(n, 1)
    plain = (F.length(c) == 19) & (at(5) == "-") & (at(8) == "-") & (at(11) == " ") & (at(14) == ":") & (at(17) == ":")
    bare, timed = F.col("_bare"), F.regexp_replace("_bare", r"^(.{11} *\d{2}:\d{2})(?![\d:])", "$1:00")
    local = F.when(bare.rlike(INSTANT), F.regexp_replace(bare, r" ?[Zz]$", ""))
    offset = bare.rlike(r"[T ] *\d{2}:\d{2}[^+-]*[+-]\d{2}:?\d{2}$") & bare.rlike(INSTANT)
    zoned = F.regexp_replace(F.regexp_replace(timed, r"([+-]\d{2})(\d{2})$", "$1:$2"), r" (?=[+-])", "")
    part = lambda unit: F.extract(F.lit(unit), F.col("_since"))
    return (
        df.withColumn("_bare", F.when(~plain, F.translate(F.btrim(c, F.lit(BLANKS)), "/", "-")))
        .withColumn("_offset", F.when(bare.isNotNull(), offset))
        .withColumn("_local", F.when(bare.isNull(), c).when(~F.col("_offset"), local))
        .withColumn("_since", F.col("_local").try_cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz"))
        .withColumn("_utc", (part("DAY").cast("long") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60) * 1_000_000 + (part("SECOND") * 1_000_000).cast("long"))
        .withColumn(out, F.coalesce("_utc", F.when(F.col("_offset"), F.unix_micros(zoned.try_cast("timestamp")))))
        .drop("_bare", "_offset", "_local", "_since", "_utc")
    )


def step_of(us: Column, width: Column) -> Column:
    """Number of the width-aligned interval that holds us, 0 being the first from 1970 on."""
    return ((us - F.pmod(us, width)) / width).cast("long")


def day_of(us: Column) -> Column:
    return step_of(us, F.lit(DAY_US))


def utc_text(us: Column, pattern: str) -> Column:
    """Text of an instant in UTC, whatever the session's zone."""
    if pattern == "date":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY_US)).cast("int")).cast("string")
    seconds = F.floor(F.pmod(us, F.lit(DAY_US)) / F.lit(1_000_000)).cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    whole = lambda a: F.floor(a).cast("int")
    return F.concat(utc_text(us, "date"), F.lit(" "), two(whole(seconds / 3600)), F.lit(":"), two(whole(seconds % 3600 / 60)), F.lit(":"), two(seconds % 60))
