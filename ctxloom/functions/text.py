"""Text expressions of the engine, all of them built-in functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reference tokenizer that needs no file: runs of word characters, or of other marks.
WORD_LEVEL = r"(?U)\w+|[^\w\s]+"


def body_text(body: Column) -> Column:
    """A body as text; null unless it is valid UTF-8."""
    text = body.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def strict_text(body: Column) -> Column:
    """A body as text; an error unless it is valid UTF-8."""
    return F.validate_utf8(body.cast("string"))


def word_level_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_LEVEL)), F.lit(0)).cast("long")


#: What stands between terms.
BETWEEN = r"[^\p{IsAlphabetic}\p{N}]+"


def terms(text: Column, least_bytes: int) -> Column:
    """Lower-cased runs of letters and digits of at least that many bytes, measured before lower-casing."""
    parts = F.filter(F.split(text, BETWEEN), lambda w: (F.octet_length(w) >= least_bytes) & (w != ""))
    return F.transform(parts, F.lower)


def each_term(df: DataFrame, column: str, least_bytes: int) -> DataFrame:
    """terms() as rows, in place of the column: term, beside the other columns."""
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, F.explode(F.split(column, BETWEEN)).alias("term")).filter((F.octet_length("term") >= least_bytes) & (F.col("term") != ""))
    return rows.withColumn("term", F.lower("term"))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words between white space; empty for null."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return F.coalesce(F.array_distinct(words), F.array().cast("array<string>"))


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def iso8601(ms: Column) -> Column:
    """UTC, to the second, whatever the session's time zone."""
    seconds = F.floor(ms / 1000).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))


def f32(x: Column) -> Column:
    """Single precision. By way of double, as Spark drops the float of an integer that it widens again, as division does."""
    return x.cast("double").cast("float")


def ratio32(a: Column, b: Column) -> Column:
    """Single-precision division; Spark would widen it."""
    return f32(f32(a) / f32(b))
