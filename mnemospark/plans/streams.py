"""Registered queries: event roll-ups, batch and streaming."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.plans.registry import query
from mnemospark.session import ensure_checkpoint_dir, read_table
from mnemospark.streaming import events as E

_STATS = "SELECT user_id, count(*) AS invocations, max(ts) AS last_invoked_at FROM events WHERE event_type = 'click' GROUP BY user_id"


@query("invocation_stats", _STATS)
def invocation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.invocation_stats(read_table(spark, sf_dir, "events"))


@query("invocation_stats_streaming", _STATS)
def invocation_stats_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same roll-up by a stream over the table's file, worked off to its end."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    source = read_table(spark, sf_dir, "events")
    stream = E.event_stream(spark, f"{sf_dir}/events.parquet*", source.schema)
    E.run_to_end(E.invocation_stats(stream), f"{root}/out", f"{root}/state", mode="complete")
    return spark.read.parquet(f"{root}/out")


@query("snapshots_kept", """WITH RECURSIVE e AS (SELECT user_id, event_type, ts FROM events WHERE ts IS NOT NULL),
k AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL
  UNION ALL SELECT k.user_id, k.event_type, (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 5 DAYS) AS n FROM k WHERE n IS NOT NULL)
SELECT user_id, event_type, ts FROM k""")
def snapshots_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with state over the events of a user and type: one is kept if it comes five days or more after the last kept."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    schema = read_table(spark, sf_dir, "events").schema
    stream = E.event_stream(spark, f"{sf_dir}/events.parquet*", schema)
    E.run_to_end(E.kept_snapshots(stream, ["user_id", "event_type"], "5 days"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").withColumn("ts", F.col("ts").cast(schema["ts"].dataType))


@query("event_windows_tumbling", "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(read_table(spark, sf_dir, "events"), "6 hours").select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_windows_sliding", "SELECT time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 3 HOURS AS start, event_type, count(*) AS n FROM events, range(0, 2) t(k) GROUP BY ALL")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding(read_table(spark, sf_dir, "events"), "6 hours", "3 hours").select(F.col("w.start").alias("start"), "event_type", "n")


@query("event_windows_session", """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(read_table(spark, sf_dir, "events"), "2 hours").select("user_id", F.col("w.start").alias("start"), "n")
