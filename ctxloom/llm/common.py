"""Shared helpers of the training-data operators."""
from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: ASCII white space that separates words.
WORD_RE = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_RE)

def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before the interpreter
        pass


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that operators make inside it when it ends: consume or write their results before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared folder, removed when the scope ends in which it is made, or else the
    driver's interpreter."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(remove, spark, path)
    return path


def spill_to(df: DataFrame, path: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Writes df to path, with options of the Parquet writer, and reads it back: cuts lineage and survives lost executors."""
    schema = df.schema
    df.write.options(compression=codec, **(options or {})).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def spill(df: DataFrame, tag: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """As spill_to, in a fresh folder under the shared one."""
    return spill_to(df, new_path(df.sparkSession, tag), codec, options)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def path_prefix(uri: str) -> str:
    """Scheme and authority, which pyarrow's paths lack."""
    m = re.match(r"(\w+):(//[^/]*)?", uri)
    return "" if not m else "" if m[1] == "file" else f"{m[1]}://" if m[1] in ("s3", "s3a", "gs", "gcs") else m[0]


def read_slice(path: str, offset: int, size: int) -> bytes:
    """Bytes of a file that an executor wrote into the shared folder."""
    store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(name) as f:
        return f.read_at(size, offset)


def read_all(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(name) as f:
        return f.read()


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def often(counts: DataFrame, key: str, total: int) -> list:
    """The keys of counts (key, n), which add up to total at most, that have over a thousandth of it and over a
    thousand: fewer than a thousand keys."""
    least = max(1000, total // 1000)
    return [] if total <= least else [r[0] for r in counts.filter(F.col("n") > least).select(key).collect()]


def join_split(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once; left's rows with a hot key (see often) do not meet in one
    task, but are joined where they are to a broadcast of right's rows with those keys."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    at_once = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return at_once.unionByName(left.filter(~is_hot | F.col(key).isNull()).join(right, key, how))


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what the driver no longer refers to; call it once a spill has cut them off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the system; workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
