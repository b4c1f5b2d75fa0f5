"""Event streams: windows, sessions, late data and de-duplication. Every function takes a batch or a streaming table alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def tumbling(df: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n and total of each window; rows later than `late` behind the newest are dropped by a stream."""
    out = df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    out = df.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(df: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once. A stream forgets keys once the watermark has passed them."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def running_totals(df: DataFrame) -> DataFrame:
    """user_id, n and total so far, kept as state of a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    rows = df.select("user_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream has now, as a memory table."""
    out = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    (out.option("checkpointLocation", checkpoint) if checkpoint else out).start().awaitTermination()
    return df.sparkSession.table(name)
