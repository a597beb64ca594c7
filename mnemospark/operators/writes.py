"""What the write paths do to tables: creating memories, embedding batches, sessions, collections, skills, knowledge, and the code index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.skills import file_problem
from mnemospark.operators.recall import near_probe
from mnemospark.session import checkpointed

#: Fixed: how often an embedding is tried, the life of a working memory in seconds, and the distance of a near-duplicate.
MAX_RETRIES = 3
WORKING_SECONDS = 3600
DUPLICATE_DISTANCE = 0.05


def create_memories(new: DataFrame, memories: DataFrame, now: Column, distance: float = DUPLICATE_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(memory_id, new_id, action) and the rows to write, for ``new (id, scope_id, memory_type, content, source_ref, vec, expires_in)``, each judged against ``memories`` as they were.

    A new memory within ``distance`` of an active one of its scope updates the nearest such (``updated``); others are inserted (``created``) with
    the kind of their content, and working ones with an end of life. Of several updates of one memory the largest new id is written.
    """
    dupes = near_probe(new, memories, distance, 1).select(F.col("asked_id").alias("new_id"), F.col("id").alias("old_id"))
    rows = new.withColumnRenamed("id", "new_id").join(dupes, "new_id", "left")
    actions = rows.select(F.coalesce("old_id", "new_id").alias("memory_id"), "new_id", F.when(F.col("old_id").isNull(), "created").otherwise("updated").alias("action"))
    life = F.coalesce("expires_in", F.lit(WORKING_SECONDS)).cast("long")
    ends = F.when(F.col("memory_type") == "working", F.timestamp_seconds(F.unix_timestamp(now) + life))
    written = rows.select(
        F.coalesce("old_id", "new_id").alias("id"), "new_id", "scope_id", "memory_type", "content", T.content_kind(F.col("content"), F.col("source_ref")).alias("content_kind"),
        F.when(F.col("old_id").isNull(), ends).alias("expires_at"), F.col("old_id").isNotNull().alias("is_update"),
    )
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("new_id")))
    return actions, written.withColumn("_last", last).where("_last = 1").drop("_last")


def chunk_children(written: DataFrame, least: int = 2000) -> DataFrame:
    """(parent_id, chunk, content): the chunks of inserted memories of over ``least`` characters; updated ones have theirs already."""
    long = written.where(~F.col("is_update") & (F.length("content") > least))
    return long.select(F.col("id").alias("parent_id"), F.posexplode(T.chunks("content")).alias("chunk", "content"))


def embedding_batch(index: DataFrame, memories: DataFrame, artifacts: DataFrame, skills: DataFrame, model_id: str, limit: int = 64) -> DataFrame:
    """(object_type, object_id, retry_count, content): the oldest pending objects of a model with the text to embed; an object without one has an empty text.

    ``index``: (object_type, object_id, model_id, status, retry_count, updated_at).
    """
    kinds = ("memory", "knowledge_artifact", "skill")
    due = index.where((F.col("model_id") == model_id) & (F.col("status") == "pending") & F.col("object_type").isin(*kinds)).orderBy("updated_at", "object_id", "object_type").limit(limit)
    body = F.btrim(F.concat_ws(" ", F.when(F.col("description") != "", F.col("description")), F.when(F.col("body") != "", F.col("body"))))
    texts = [
        memories.where("is_active").select(F.lit("memory").alias("object_type"), F.col("id").alias("object_id"), "content"),
        artifacts.select(F.lit("knowledge_artifact").alias("object_type"), F.col("id").alias("object_id"), "content"),
        skills.select(F.lit("skill").alias("object_type"), F.col("id").alias("object_id"), body.alias("content")),
    ]
    found = reduce(DataFrame.unionByName, texts)
    return due.select("object_type", "object_id", "retry_count").join(found, ["object_type", "object_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def embedding_outcome(index: DataFrame, tried: DataFrame, retries: int = MAX_RETRIES) -> DataFrame:
    """``index`` after a batch: rows of ``tried (object_type, object_id, ok)`` become ready, or pending with one more try, or failed at the last."""
    rows = index.join(tried.select("object_type", "object_id", F.col("ok").alias("_ok")), ["object_type", "object_id"], "left")
    count = F.when(F.col("_ok") == F.lit(False), F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = F.when(F.col("_ok"), "ready").when(F.col("_ok") == F.lit(False), F.when(count >= retries, "failed").otherwise("pending")).otherwise(F.col("status"))
    return rows.withColumns({"status": status, "retry_count": count}).drop("_ok")


def bootstrap_vectors(objects: DataFrame, index: DataFrame, model_id: str) -> DataFrame:
    """(object_type, object_id, scope_id, vec): vectors kept with ``objects`` that go into a model's table, all but those that are ready there."""
    ready = index.where((F.col("model_id") == model_id) & (F.col("status") == "ready")).select("object_type", "object_id")
    return objects.where("vec is not null").join(ready, ["object_type", "object_id"], "left_anti").select("object_type", "object_id", "scope_id", "vec")


def register_model(models: DataFrame, new: DataFrame) -> DataFrame:
    """``models (slug, content_type, is_active, is_ready)`` after registering active ``new`` ones: peers of the same content type become inactive,
    a known slug is replaced, and keeps being ready if it was."""
    peers = new.where("is_active").select("content_type").distinct().withColumn("_peer", F.lit(True))
    old = models.join(new.select("slug"), "slug", "left_anti").join(peers, "content_type", "left")
    kept = old.select("slug", "content_type", (F.col("is_active") & F.col("_peer").isNull()).alias("is_active"), "is_ready")
    was = models.select("slug", F.col("is_ready").alias("_was"))
    added = new.join(was, "slug", "left").select("slug", "content_type", "is_active", (F.col("is_ready") | F.coalesce("_was", F.lit(False))).alias("is_ready"))
    return kept.unionByName(added)


def append_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The events whose session exists, with the session's scope."""
    return events.join(sessions.select("session_id", "scope_id"), "session_id")


def end_sessions(sessions: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """``sessions`` after ``ends (session_id, ended_at, meta)``: a missing time is the present, missing meta stays as it was."""
    e = ends.select("session_id", F.coalesce("ended_at", now).alias("_at"), F.col("meta").alias("_meta"), F.lit(True).alias("_ends"))
    rows = sessions.join(e, "session_id", "left")
    return rows.withColumns({"ended_at": F.when(F.col("_ends"), F.col("_at")).otherwise(F.col("ended_at")), "meta": F.coalesce("_meta", "meta")}).drop("_at", "_meta", "_ends")


def collection_items(items: DataFrame, artifacts: DataFrame, collections: DataFrame) -> DataFrame:
    """(slug, place, artifact_id, title): every collection's artifacts in order of position and time; an item counts once."""
    rows = items.groupBy("collection_id", "artifact_id").agg(F.min(F.struct("position", "added_at")).alias("first"))
    rows = rows.join(collections.select(F.col("id").alias("collection_id"), "slug"), "collection_id").join(artifacts.select(F.col("id").alias("artifact_id"), "title"), "artifact_id")
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy("first.position", "first.added_at", "artifact_id"))
    return rows.select("slug", place.cast("long").alias("place"), "artifact_id", "title")


def edit_artifacts(artifacts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``artifacts (id, status, version, content)`` after ``edits (id, content)``, and the history (artifact_id, version, content) that is kept.

    Only drafts and artifacts in review can be edited; those in review are kept as they were. Of several edits of one the largest text counts.
    """
    e = edits.groupBy("id").agg(F.max("content").alias("_new"))
    rows = artifacts.join(e, "id", "left")
    open_ = F.col("_new").isNotNull() & F.col("status").isin("draft", "in_review")
    history = rows.where(open_ & (F.col("status") == "in_review")).select(F.col("id").alias("artifact_id"), "version", "content")
    after = rows.withColumns({"content": F.when(open_, F.col("_new")).otherwise(F.col("content")), "version": F.col("version") + open_.cast("int")}).drop("_new")
    return after, history


def topic_members(clusters: DataFrame, topic: str) -> DataFrame:
    """(cluster, members, about): how many members every cluster of ``clusters (cluster, content)`` has, and how many of them speak of a topic."""
    about = F.lit(topic == "") | F.contains(F.lower("content"), F.lit(topic.lower()))
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum(about.cast("long")).alias("about"))


def index_files(entities: DataFrame, relations: DataFrame, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations after indexing files again.

    ``symbols (scope_id, entity_type, canonical)`` are added where they are unknown; every relation of the files in ``edges (scope_id,
    subject, predicate, object, source_file)`` is replaced; of equal relations the one with the smallest file stays.
    """
    keys = ["scope_id", "entity_type", "canonical"]
    every = entities.select(*keys).unionByName(symbols.select(*keys)).distinct()
    kept = relations.join(edges.select("scope_id", "source_file").distinct(), ["scope_id", "source_file"], "left_anti")
    both = kept.select("scope_id", "subject", "predicate", "object", "source_file").unionByName(edges.select("scope_id", "subject", "predicate", "object", "source_file"))
    return every, both.groupBy("scope_id", "subject", "predicate", "object").agg(F.min("source_file").alias("source_file"))


def delete_files(relations: DataFrame, files: DataFrame) -> DataFrame:
    """Relations without those that come from the ``files (scope_id, source_file)``."""
    return relations.join(files.distinct(), ["scope_id", "source_file"], "left_anti")


def edit_skills(skills: DataFrame, files: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Skills and their files after ``edits``, and the versions before that are kept.

    ``skills``: (id, version, body, parameters); ``files``: (skill_id, relative_path, content, is_executable); ``edits``: (id, body, parameters, changed_by, files), where
    null ``files`` leave the files as they are and a list replaces them all, an empty one too. An edit with a file that is not valid, or of no known skill, is refused
    as a whole: ``refused (id, relative_path, problem)``. Of several edits of a skill that with the largest (body, parameters, changed_by) counts; of files that
    repeat a path the largest. Gives ``skills``, ``files``, ``history (skill_id, version, body, parameters, changed_by)``, ``history_files`` and ``refused``.
    """
    each = edits.where("id is not null").groupBy("id").agg(F.max_by(F.struct("body", "parameters", "changed_by", "files"), F.struct("body", "parameters", "changed_by")).alias("e")).select("id", "e.*")
    listed = each.select("id", F.explode("files").alias("f")).select("id", "f.*")
    bad = listed.withColumn("problem", file_problem(F.col("relative_path"), F.coalesce("is_executable", F.lit(False)))).where("problem is not null").select("id", "relative_path", "problem")
    unknown = each.join(skills, "id", "left_anti").select("id", F.lit(None).cast("string").alias("relative_path"), F.lit("unknown skill").alias("problem"))
    refused = checkpointed(bad.unionByName(unknown))
    good = checkpointed(each.join(refused.select("id").distinct(), "id", "left_anti"))
    met = skills.join(good.select("id", F.col("body").alias("_body"), F.col("parameters").alias("_parameters"), "changed_by", F.lit(True).alias("_edited")), "id", "left")
    edited = F.coalesce("_edited", F.lit(False))
    after = met.withColumns({"body": F.when(edited, F.col("_body")).otherwise(F.col("body")), "parameters": F.when(edited, F.col("_parameters")).otherwise(F.col("parameters")), "version": F.col("version") + edited.cast("int")})
    history = met.where(edited).select(F.col("id").alias("skill_id"), "version", "body", "parameters", "changed_by")
    own = ["skill_id", "relative_path", "content", "is_executable"]
    kept = files.join(history.select("skill_id", "version"), "skill_id").select("skill_id", "version", *own[1:])
    replaced = good.where("files is not null")
    new = replaced.select(F.col("id").alias("skill_id"), F.explode("files").alias("f")).groupBy("skill_id", "f.relative_path").agg(F.max(F.struct("f.content", "f.is_executable")).alias("f"))
    stay = files.join(replaced.select(F.col("id").alias("skill_id")), "skill_id", "left_anti").select(*own)
    now = stay.unionByName(new.select("skill_id", "relative_path", "f.content", F.coalesce("f.is_executable", F.lit(False)).alias("is_executable")))
    return {"skills": after.select(*skills.columns), "files": now, "history": history, "history_files": kept, "refused": refused}
