"""State machines of knowledge and skills, replayed from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.dedup import numbered

#: Fixed table: from which states an event leads to which.
TRANSITIONS = {
    "submit": (("draft",), "in_review"), "retract": (("in_review",), "draft"), "publish": (("in_review",), "published"),
    "deprecate": (("published",), "deprecated"), "republish": (("deprecated",), "published"), "delete": (("draft", "in_review", "published", "deprecated"), "deleted"),
}


def _next(state: Column, event: Column, required: Column) -> Column:
    """The state after an event. ``endorse`` counts distinct endorsers in review and publishes at ``required``."""
    status = state.status
    moved = status
    for name, (before, after) in TRANSITIONS.items():
        moved = F.when((event.action == name) & status.isin(*before), after).otherwise(moved)
    new = (event.action == "endorse") & (status == "in_review") & ~F.array_contains(state.endorsers, event.actor)
    endorsers = F.when(moved == "draft", F.array().cast("array<string>")).when(new, F.concat(state.endorsers, F.array(event.actor))).otherwise(state.endorsers)
    published = F.when((moved == "in_review") & (F.size(endorsers) >= required), "published").otherwise(moved)
    return F.struct(published.alias("status"), endorsers.alias("endorsers"), (state.applied + (new | (moved != status)).cast("int")).alias("applied"))


def replay(events: DataFrame, key: str, order: list[str], required: int = 2) -> DataFrame:
    """(key, status, endorsements, applied) from rows with ``action`` and ``actor``; events that do not fit the state change nothing.

    A key's log is folded in order inside the JVM.
    """
    log = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "action", "actor"))).alias("log"))
    start = F.struct(F.lit("draft").alias("status"), F.array().cast("array<string>").alias("endorsers"), F.lit(0).alias("applied"))
    end = F.aggregate("log", start, lambda s, e: _next(s, e, F.lit(required)))
    return log.select(key, end.alias("s")).select(key, "s.status", F.size("s.endorsers").alias("endorsements"), "s.applied")


def replay_review(events: DataFrame, key: str, time: str, order: list[str], rules: str = "knowledge", required: int = 2) -> DataFrame:
    """(key, status, endorsements, published_at) from rows with ``action``, ``actor``, ``is_author``, ``is_admin``, folded in order of ``time`` and ``order``.

    ``knowledge``: authors and admins submit and retract; admins may endorse at any time, others only what is in review and not
    their own; admins deprecate, republish (the time stays), roll back and delete. ``skill``: anybody submits and retracts, nobody endorses
    their own, republishing sets the time anew, drafts cannot be rolled back, and nothing is deleted. An endorsement counts once a person, and
    ``required`` of them publish. What is not allowed or does not fit changes nothing.
    """
    knowledge = rules == "knowledge"

    def step(s: Column, e: Column) -> Column:
        may = (e.is_admin | e.is_author) if knowledge else F.lit(True)
        reviewed = ~e.is_author & (s.status == "in_review")
        can = (e.action == "endorse") & ((e.is_admin | reviewed) if knowledge else reviewed) & (s.status != "deleted")
        endorsers = F.when(can, F.array_union(s.endorsers, F.array(e.actor))).otherwise(s.endorsers)
        full = can & (F.size(endorsers) >= required)
        status = (
            F.when(s.status == "deleted", s.status)
            .when((e.action == "submit") & (s.status == "draft") & may, "in_review")
            .when((e.action == "retract") & (s.status == "in_review") & may, "draft")
            .when((e.action == "deprecate") & (s.status == "published") & e.is_admin, "deprecated")
            .when((e.action == "republish") & (s.status == "deprecated") & e.is_admin, "published")
            .when((e.action == "rollback") & e.is_admin & (F.lit(knowledge) | (s.status != "draft")), "draft")
            .when(full, "published")
            .when(F.lit(knowledge) & (e.action == "delete") & e.is_admin, "deleted")
            .otherwise(s.status)
        )
        again = (e.action == "republish") & (s.status == "deprecated") & e.is_admin
        published = F.when(full, e[time]).when(again, F.coalesce(s.published_at, e[time]) if knowledge else e[time]).otherwise(s.published_at)
        return F.struct(status.alias("status"), endorsers.alias("endorsers"), published.alias("published_at"))

    log = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(time, *order, "action", "actor", "is_author", "is_admin"))).alias("log"))
    kind = events.schema[time].dataType.simpleString()
    start = F.struct(F.lit("draft").alias("status"), F.array().cast("array<string>").alias("endorsers"), F.lit(None).cast(kind).alias("published_at"))
    end = log.select(key, F.aggregate("log", start, step).alias("s"))
    return end.select(key, "s.status", F.size("s.endorsers").alias("endorsements"), "s.published_at")


def approve_promotions(memories: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending requests (memory_id, request_id, decision) that are approved make draft artifacts; memories learn the outcome.

    Requests that are not pending any more are left alone; of several for a memory the first counts.
    """
    pending = requests.where("status = 'pending' AND decision IN ('approve', 'reject')")
    first = pending.groupBy("memory_id").agg(F.min_by("decision", "request_id").alias("decision"), F.min("request_id").alias("request_id"))
    hit = memories.join(first.withColumnRenamed("memory_id", "id"), "id")
    drafts = hit.where("decision = 'approve'").select(F.col("request_id").alias("artifact_id"), F.col("id").alias("source_memory_id"), "content", F.lit("draft").alias("status"))
    outcome = hit.select("id", F.when(F.col("decision") == "approve", "promoted").otherwise("none").alias("promotion_status"))
    return drafts, outcome


#: Sources that one row of a digest holds; further ones follow in further parts.
LISTED = 1000


def synthesise(sources: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(group, part, sources, source_ids, content): a digest of every group with at least ``least`` published sources (id, title, content).

    A digest of more than ``LISTED`` sources continues in further parts, so that no row holds a whole large group; ``sources`` counts all of them.
    """
    total = sources.groupBy(group).agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= least)
    placed = numbered(sources.select(group, "id", "title", "content"), group, "id").withColumn("part", F.floor((F.col("place") - 1) / LISTED).cast("int"))
    each = F.sort_array(F.collect_list(F.struct("place", "id", "title", "content")))
    found = placed.groupBy(group, "part").agg(each.alias("each")).join(total, group)
    body = F.array_join(F.transform("each", lambda x: F.concat(F.lit("## "), x.title, F.lit("\n\n"), x.content)), "\n\n")
    return found.select(group, "part", F.col("sources").cast("int").alias("sources"), F.transform("each", lambda x: x.id).alias("source_ids"), body.alias("content"))
