"""Maintenance of memories and knowledge: expiry, decay, pruning, staleness, contradiction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.vector import cosine_similarity
from mnemospark.operators.dedup import similar_pairs
from mnemospark.operators.recall import DECAY, DECAY_OTHER, days_since


def expire(memories: DataFrame, now: Column) -> DataFrame:
    """Memories whose time is over become inactive."""
    over = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return memories.withColumn("is_active", F.col("is_active") & ~over)


def decay_step(memories: DataFrame, now: Column) -> DataFrame:
    """One night's decay of the importance, applied to what the night before left."""
    rate = F.when(F.col("memory_type") == "working", DECAY["working"]).when(F.col("memory_type") == "episodic", DECAY["episodic"]).otherwise(DECAY_OTHER)
    days = days_since(F.coalesce("last_accessed", "created_at"), now)
    return memories.withColumn("importance", F.greatest(F.lit(0.0), F.col("importance") * F.exp(-rate * days)))


def prune(memories: DataFrame, least: float = 0.05, accessed: int = 2) -> DataFrame:
    """Hardly important, hardly accessed episodic and working memories become inactive."""
    low = (F.col("importance") < least) & (F.col("access_count") < accessed) & F.col("memory_type").isin("episodic", "working")
    return memories.withColumn("is_active", F.col("is_active") & ~low)


def stale_artifacts(artifacts: DataFrame, open_flags: DataFrame, now: Column) -> DataFrame:
    """(artifact_id, signal, confidence, evidence): published over 180 days ago, not accessed for 60, not flagged yet."""
    old = artifacts.where((F.col("status") == "published") & (days_since(F.col("created_at"), now) > 180) & (days_since(F.col("last_accessed"), now) > 60))
    fresh = old.join(open_flags.select(F.col("artifact_id").alias("id")), "id", "left_anti")
    evidence = F.to_json(F.struct(F.floor(days_since(F.col("last_accessed"), now)).cast("long").alias("days")))
    return fresh.select(F.col("id").alias("artifact_id"), F.lit("low_access_age").alias("signal"), F.lit(0.3).alias("confidence"), evidence.alias("evidence"))


def contradictions(artifacts: DataFrame, memories: DataFrame, topic: float, negation: DataFrame, least: float, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(artifact_id, memory_id, confidence): per artifact the first memory near its topic that also resembles a negation.

    Both inputs are (id, block, vec, content); only rows of one block meet, in tiles, and only memories near the one vector ``q`` of
    ``negation``. ``judge`` may decide on the two contents; without it every survivor counts.
    """
    against = memories.where("vec is not null").crossJoin(F.broadcast(negation.select("q").where("q is not null").limit(1))).where(cosine_similarity(F.col("vec"), F.col("q")) > least)
    near = similar_pairs(artifacts.select("id", "vec", "block"), against.select("id", "vec", "block"), topic, ["block"])
    near = near.select(F.col("a").alias("artifact_id"), F.col("b").alias("memory_id"), F.col("similarity").alias("sim")).where("artifact_id <> memory_id")
    if judge is not None:
        near = near.join(artifacts.select(F.col("id").alias("artifact_id"), F.col("content").alias("ca")), "artifact_id").join(memories.select(F.col("id").alias("memory_id"), F.col("content").alias("cm")), "memory_id")
        near = near.where(judge(F.col("ca"), F.col("cm")))
    first = near.groupBy("artifact_id").agg(F.min_by(F.struct("memory_id", "sim"), "memory_id").alias("first"))
    return first.select("artifact_id", "first.memory_id", F.least(F.lit(0.9), 1.5 * F.col("first.sim")).alias("confidence"))


def flag_digests(links: DataFrame, changed: DataFrame, open_flags: DataFrame) -> DataFrame:
    """(artifact_id, confidence): digests of changed sources without an open flag; a deleted source weighs 1.0, others 0.9."""
    weight = F.when(F.col("change") == "deleted", 1.0).otherwise(0.9)
    hit = links.join(changed, "source_id").groupBy(F.col("digest_id").alias("artifact_id")).agg(F.max(weight).alias("confidence"))
    return hit.join(open_flags, "artifact_id", "left_anti")
