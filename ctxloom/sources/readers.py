"""Sources of blocks: files as they are, and tables of any format that Spark reads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import block_id, content_hash
from ..plans.models import KIND_BY_NAME


def _blocks(df: DataFrame, session: Column, kind: Column, body: Column, ts_ms: Column, key: Column, priority: Column) -> DataFrame:
    """key tells apart blocks of one millisecond; the order of arrival is by time, then id."""
    raw = body.cast("binary")
    none = F.array().cast("array<string>")
    return df.select(
        session.alias("session_id"), block_id(ts_ms, F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))).alias("block_id"), kind.alias("kind"), raw.alias("body"), F.create_map().cast("map<string,bigint>").alias("token_counts"), priority.cast("float").alias("priority"),
        ts_ms.alias("created_at_ms"), ts_ms.alias("updated_at_ms"), F.struct(key.cast("string").alias("source"), none.alias("parents"), none.alias("labels")).alias("provenance"), content_hash(raw).alias("content_hash"), ts_ms.alias("seq"),
    )


def from_files(spark: SparkSession, path: str, session_id: str, kind: str, glob: str | None = None) -> DataFrame:
    """A block for each file, its bytes unread by any decoder, its time the file's."""
    reader = spark.read.format("binaryFile")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return _blocks(df, F.lit(session_id), F.lit(KIND_BY_NAME[kind]), F.col("content"), F.unix_millis("modificationTime"), F.col("path"), F.lit(0.0))


def from_table(df: DataFrame, session: str | Column, kind: str, body: str, ts_ms: str | Column, key: str, priority: Column | None = None) -> DataFrame:
    """A block for each row of any table: session and ts_ms are columns or expressions, key a column that is unique in a millisecond."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return _blocks(df, col(session), F.lit(KIND_BY_NAME[kind]), F.col(body), col(ts_ms).cast("long"), F.col(key), F.lit(0.0) if priority is None else priority)
