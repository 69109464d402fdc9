"""Structured Streaming: watched folders, windowed counts with late data, and pattern counts kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, folder: str, action: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.md") -> StreamingQuery:
    """Call ``action(batch, number)`` for notes that appear in ``folder``: path, time and whole text, each once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    notes = files.select("path", "modificationTime", F.decode("content", "UTF-8").alias("content"))
    return notes.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per window and type; rows later than ``late`` are left out once the watermark has passed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


OUT = "event_type string, n long, last_ids string"
STATE = "n long, last_ids string"


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last = state.get if state.exists else (0, "")
    ids = [int(x) for x in last.split(",") if x]
    for b in batches:
        n += len(b)
        ids = sorted([*ids, *b["event_id"].tolist()])[-50:]
    text = ",".join(map(str, ids))
    state.update((n, text))
    yield pd.DataFrame({"event_type": [key[0]], "n": [n], "last_ids": [text]})


def pattern_counts(events: DataFrame) -> DataFrame:
    """Running count of each type and its 50 latest ids, kept as bounded state across batches."""
    return events.groupBy("event_type").applyInPandasWithState(_count, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def write_updates(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what each batch updates to the Parquet files of ``folder``; nothing is kept on the driver."""
    append = lambda batch, _: batch.write.mode("append").parquet(folder)
    return counts.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
