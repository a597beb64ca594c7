"""Event roll-ups that run alike on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def invocation_stats(events: DataFrame, key: str = "user_id", kind: str = "click") -> DataFrame:
    """(key, invocations, last_invoked_at): how often and when last. Late events never set the time back."""
    return events.where(F.col("event_type") == kind).groupBy(key).agg(F.count(F.lit(1)).alias("invocations"), F.max("ts").alias("last_invoked_at"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """One row per user and run of events with no pause of ``gap`` or more."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def fresh_snapshots(events: DataFrame, keys: list[str], late: str = "60 seconds") -> DataFrame:
    """Events whose keys did not occur within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def kept_snapshots(events: DataFrame, keys: list[str], gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(keys, ts): events of a stream that come ``gap`` or more after the last one that was kept of their keys.

    The state of a key is the time of its last kept event; a timer clears it once the watermark has passed that time and the gap, so that state does not grow
    with the keys ever seen. Events later than the watermark are dropped; an event before the last kept one is kept only if it is ``gap`` or more before it, and sets no time back.
    Within a batch events are taken in the order of their times. Null times are dropped.
    """
    micros = int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = np.sort(np.concatenate([b["ts"].to_numpy("datetime64[us]").astype(np.int64) for b in batches]))
        kept = []
        for t in times.tolist():
            if last is None or abs(t - last) >= micros:
                kept.append(t)
                last = t if last is None else max(t, last)
        if kept:
            state.update((last,))
        if state.exists:
            state.setTimeoutTimestamp(max((last + micros) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({k: [v] * len(kept) for k, v in zip(keys, key, strict=True)} | {"ts": pd.to_datetime(kept, unit="us")})

    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(*keys, "ts")
    return timed.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(frame: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there and stop: Parquet in append mode, else every batch as the whole table."""
    if mode == "append":
        started = frame.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        started = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start()
    started.awaitTermination()
    return started
