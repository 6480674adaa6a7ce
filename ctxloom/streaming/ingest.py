"""Structured Streaming at the edges of the engine: ingest, deduplication, running session state."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import shared_dir
from ..sources.store import ContextStore


def ingest(stream: DataFrame, store: ContextStore):
    """A writer that puts each micro-batch (columns of blocks, session_id, seq) into the store, writing its new rows
    alone. A batch that is repeated after a failure adds nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: store.put(df) and None)


def deduplicate(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key has not been seen within the delay of the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, *keys: str) -> DataFrame:
    """Counts over tumbling windows; rows later than the watermark are dropped."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return rows.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def drain(out: DataFrame, mode: str) -> DataFrame:
    """Runs a streaming result over all that its source has now: its rows with the batch that wrote them. Batches are
    files in the shared folder, so nothing is gathered on the driver."""
    spark = out.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = out.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def running_state(stream: DataFrame, key: str, step: Callable[[str | None, pd.DataFrame], str]) -> DataFrame:
    """Per key, a text state that each batch replaces by step(state, rows): the latest state of each key that changed."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        for pdf in batches:
            now = step(now, pdf)
        state.update((now,))
        yield pd.DataFrame({key: [str(k[0])], "state": [now]})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, state string", "state string", "update", "NoTimeout")
