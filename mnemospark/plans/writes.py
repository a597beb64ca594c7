"""Registered queries: write paths, scope strings and slugs, and reviewed lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import adapters as A
from mnemospark.functions import text as T
from mnemospark.operators import lifecycle as L
from mnemospark.operators import recall as R
from mnemospark.operators import writes as W
from mnemospark.plans.registry import query
from mnemospark.session import read_table

_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"
_NEW = f"""m AS (SELECT memories.*, vec FROM memories JOIN vectors ON vectors.id = memories.id),
fresh AS (SELECT id + 1000000000 AS id, scope_id, memory_type, content, source_ref, vec FROM m),
near AS (SELECT n.id AS new_id, m.id AS old_id, row_number() OVER (PARTITION BY n.id ORDER BY round(1 - {_COS.format('m.vec', 'n.vec')}, 9), m.id) AS place FROM fresh n JOIN m ON m.scope_id = n.scope_id AND m.is_active WHERE round(1 - {_COS.format('m.vec', 'n.vec')}, 9) <= 0.05)"""


def _created(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every memory with a vector comes in again, under a new number."""
    rows = A.memories(spark, sf_dir).join(A.vectors(spark, sf_dir), "id")
    new = rows.select((F.col("id") + 1_000_000_000).alias("id"), "scope_id", "memory_type", "content", "source_ref", "vec", F.lit(None).cast("long").alias("expires_in"))
    return W.create_memories(new, rows, A.now())


@query("create_memories", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_NEW}
SELECT coalesce(old_id, f.id) AS memory_id, f.id AS new_id, CASE WHEN old_id IS NULL THEN 'created' ELSE 'updated' END AS action FROM fresh f LEFT JOIN near ON near.new_id = f.id AND place = 1""")
def create_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir)[0]


@query("created_rows", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_NEW}, w AS (SELECT coalesce(old_id, f.id) AS id, f.id AS new_id, memory_type, old_id FROM fresh f LEFT JOIN near ON near.new_id = f.id AND place = 1)
SELECT id, max(new_id) AS new_id, old_id IS NOT NULL AS is_update, CASE WHEN old_id IS NULL AND arg_max(memory_type, new_id) = 'working' THEN TIMESTAMP '{A.NOW}' + INTERVAL 1 HOUR END AS expires_at FROM w GROUP BY id, old_id""")
def created_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir)[1].select("id", "new_id", "is_update", "expires_at")


@query("created_chunks")
def created_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.chunk_children(_created(spark, sf_dir)[1]).select("parent_id", "chunk", F.md5("content").alias("content_hash"))


_INDEX = f"""idx AS (SELECT 'memory' AS object_type, doc_id AS object_id, 'model-2' AS model_id, CASE WHEN doc_id % 5 < 3 THEN 'pending' ELSE 'ready' END AS status, CAST(doc_id % 3 AS INT) AS retry_count, TIMESTAMP '{A.NOW}' - to_seconds(60 * (doc_id * 31 % 1009)) AS updated_at FROM documents
  UNION ALL SELECT 'knowledge_artifact', doc_id, 'model-2', 'pending', 0, TIMESTAMP '{A.NOW}' - to_seconds(60 * (doc_id * 17 % 1013)) FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'skill', p_partkey, 'model-2', 'pending', 1, TIMESTAMP '{A.NOW}' - to_seconds(60 * (p_partkey * 13 % 1019)) FROM part)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_type, object_id, model_id, status, retry_count, updated_at) for all memories, artifacts and skills."""
    docs, back = read_table(spark, sf_dir, "documents"), "timestamp_seconds(unix_timestamp(timestamp'" + A.NOW + "') - 60 * ({0})) AS updated_at"
    memory = docs.selectExpr("'memory' AS object_type", "doc_id AS object_id", "'model-2' AS model_id", "CASE WHEN doc_id % 5 < 3 THEN 'pending' ELSE 'ready' END AS status", "CAST(doc_id % 3 AS INT) AS retry_count", back.format("doc_id * 31 % 1009"))
    artifact = docs.where("doc_id % 3 = 0").selectExpr("'knowledge_artifact' AS object_type", "doc_id AS object_id", "'model-2' AS model_id", "'pending' AS status", "0 AS retry_count", back.format("doc_id * 17 % 1013"))
    skill = read_table(spark, sf_dir, "part").selectExpr("'skill' AS object_type", "p_partkey AS object_id", "'model-2' AS model_id", "'pending' AS status", "1 AS retry_count", back.format("p_partkey * 13 % 1019"))
    return memory.unionByName(artifact).unionByName(skill)


@query("embedding_batch", f"""WITH {A.MEMORIES_SQL}, {A.ARTIFACTS_SQL}, {A.SKILLS_SQL}, {_INDEX}
SELECT i.object_type, i.object_id, i.retry_count, md5(coalesce(CASE WHEN i.object_type = 'skill' THEN trim(concat_ws(' ', nullif(s.description, ''), nullif(s.name, ''))) ELSE coalesce(m.content, a.content) END, '')) AS content_hash
FROM idx i LEFT JOIN memories m ON i.object_type = 'memory' AND m.id = i.object_id AND m.is_active LEFT JOIN artifacts a ON i.object_type = 'knowledge_artifact' AND a.id = i.object_id
  LEFT JOIN skills s ON i.object_type = 'skill' AND s.id = i.object_id WHERE i.status = 'pending' ORDER BY i.updated_at, i.object_id, i.object_type LIMIT 500""")
def embedding_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill's name stands for its body."""
    skills = A.skills(spark, sf_dir).select("id", "description", F.col("name").alias("body"))
    found = W.embedding_batch(_index(spark, sf_dir), A.memories(spark, sf_dir), A.artifacts(spark, sf_dir), skills, "model-2", 500)
    return found.select("object_type", "object_id", "retry_count", F.md5("content").alias("content_hash"))


@query("embedding_outcome", f"""WITH {_INDEX} SELECT object_type, object_id,
  CASE WHEN object_type <> 'memory' OR status <> 'pending' THEN status WHEN object_id % 2 = 0 THEN 'ready' WHEN retry_count + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
  CAST(retry_count + CASE WHEN object_type = 'memory' AND status = 'pending' AND object_id % 2 = 1 THEN 1 ELSE 0 END AS INT) AS retry_count FROM idx""")
def embedding_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pending memories those with even numbers could be embedded."""
    index = _index(spark, sf_dir)
    tried = index.where("object_type = 'memory' AND status = 'pending'").select("object_type", "object_id", (F.col("object_id") % 2 == 0).alias("ok"))
    return W.embedding_outcome(index, tried).select("object_type", "object_id", "status", "retry_count")


@query("bootstrap_vectors", f"WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_INDEX} SELECT 'memory' AS object_type, m.id AS object_id, scope_id FROM memories m JOIN vectors v ON v.id = m.id WHERE m.id NOT IN (SELECT object_id FROM idx WHERE object_type = 'memory' AND status = 'ready')")
def bootstrap_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = A.memories(spark, sf_dir).join(A.vectors(spark, sf_dir), "id").select(F.lit("memory").alias("object_type"), F.col("id").alias("object_id"), "scope_id", "vec")
    return W.bootstrap_vectors(objects, _index(spark, sf_dir), "model-2").drop("vec")


_SESSIONS = f"sessions AS (SELECT conv_id AS session_id, 'n' || (conv_id % 25) AS scope_id, CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '{A.NOW}' - INTERVAL 1 DAY END AS ended_at, 'm' || (conv_id % 3) AS meta FROM (SELECT DISTINCT conv_id FROM conversations))"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions of nations."""
    return read_table(spark, sf_dir, "conversations").select("conv_id").distinct().selectExpr(
        "conv_id AS session_id", "concat('n', conv_id % 25) AS scope_id", f"CASE WHEN conv_id % 2 = 0 THEN timestamp'{A.NOW}' - INTERVAL 1 DAY END AS ended_at", "concat('m', conv_id % 3) AS meta"
    )


@query("append_events", f"WITH {_SESSIONS} SELECT event_id, user_id AS session_id, scope_id, event_type FROM events JOIN sessions ON session_id = user_id")
def append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for sessions; events of unknown ones are refused."""
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), "event_type")
    return W.append_events(events, _sessions(spark, sf_dir)).select("event_id", "session_id", "scope_id", "event_type")


@query("end_sessions", f"""WITH {_SESSIONS} SELECT session_id, CASE WHEN session_id % 3 = 0 THEN CASE WHEN session_id % 2 = 0 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '{A.NOW}' END ELSE ended_at END AS ended_at,
  CASE WHEN session_id % 9 = 0 THEN 'over' ELSE meta END AS meta FROM sessions""")
def end_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir)
    ends = rows.where("session_id % 3 = 0").selectExpr("session_id", "CASE WHEN session_id % 2 = 0 THEN timestamp'2024-01-20' END AS ended_at", "CASE WHEN session_id % 9 = 0 THEN 'over' END AS meta")
    return W.end_sessions(rows, ends, A.now()).select("session_id", "ended_at", "meta")


@query("collection_items", f"""WITH {A.ARTIFACTS_SQL}, i AS (SELECT doc_id % 25 AS collection_id, doc_id AS artifact_id, doc_id * 7 % 11 AS position, doc_id % 5 AS added_at FROM documents UNION ALL SELECT doc_id % 25, doc_id, doc_id * 7 % 11 + 1, 0 FROM documents WHERE doc_id % 4 = 0),
f AS (SELECT collection_id, artifact_id, min(struct_pack(position := position, added_at := added_at)) AS first FROM i GROUP BY ALL)
SELECT n_name AS slug, row_number() OVER (PARTITION BY collection_id ORDER BY first.position, first.added_at, artifact_id) AS place, artifact_id, title FROM f JOIN nation ON n_nationkey = collection_id JOIN artifacts ON artifacts.id = artifact_id""")
def collection_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as collections of artifacts, some added twice."""
    docs = read_table(spark, sf_dir, "documents")
    items = docs.selectExpr("doc_id % 25 AS collection_id", "doc_id AS artifact_id", "doc_id * 7 % 11 AS position", "doc_id % 5 AS added_at")
    items = items.unionByName(docs.where("doc_id % 4 = 0").selectExpr("doc_id % 25 AS collection_id", "doc_id AS artifact_id", "doc_id * 7 % 11 + 1 AS position", "0L AS added_at"))
    collections = read_table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS slug")
    return W.collection_items(items, A.artifacts(spark, sf_dir), collections)


@query("edit_artifacts", f"WITH {A.ARTIFACTS_SQL} SELECT id, CAST(1 + CASE WHEN status IN ('draft', 'in_review') THEN 1 ELSE 0 END AS INT) AS version, md5(CASE WHEN status IN ('draft', 'in_review') THEN 'new ' || id ELSE content END) AS content_hash FROM artifacts")
def edit_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All artifacts are edited; published ones cannot be."""
    rows = A.artifacts(spark, sf_dir).select("id", "status", F.lit(1).alias("version"), "content")
    after, _ = W.edit_artifacts(rows, rows.select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("content")))
    return after.select("id", "version", F.md5("content").alias("content_hash"))


@query("edit_history", f"WITH {A.ARTIFACTS_SQL} SELECT id AS artifact_id, 1 AS version, md5(content) AS content_hash FROM artifacts WHERE status = 'in_review'")
def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.artifacts(spark, sf_dir).select("id", "status", F.lit(1).alias("version"), "content")
    return W.edit_artifacts(rows, rows.select("id", F.lit("new").alias("content")))[1].select("artifact_id", "version", F.md5("content").alias("content_hash"))


@query("endorsement_counts", "SELECT user_id AS artifact_id, count(DISTINCT event_id % 7) AS endorsements FROM events WHERE event_type = 'view' GROUP BY user_id")
def endorsement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for endorsements; one counts once a person."""
    rows = read_table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("artifact_id"), (F.col("event_id") % 7).alias("person"))
    return rows.groupBy("artifact_id").agg(F.count_distinct("person").alias("endorsements"))


@query("registered_models", "SELECT lang AS slug, 'text' AS content_type, lang = 'model-3' AS is_active, count(*) > 100 AS is_ready FROM documents GROUP BY lang UNION ALL SELECT 'model-3', 'text', TRUE, FALSE UNION ALL SELECT 'code-1', 'code', TRUE, TRUE")
def registered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for text models that a new active model replaces; code models stay."""
    old = read_table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("slug")).agg((F.count(F.lit(1)) > 100).alias("is_ready"))
    old = old.select("slug", F.lit("text").alias("content_type"), F.lit(True).alias("is_active"), "is_ready")
    models = old.unionByName(spark.createDataFrame([("code-1", "code", True, True)], old.schema))
    return W.register_model(models, spark.createDataFrame([("model-3", "text", True, False)], old.schema))


@query("cluster_topics", f"WITH {A.MEMORIES_SQL} SELECT scope_id AS cluster, count(*) AS members, CAST(count(*) FILTER (contains(lower(content), 'tion')) AS BIGINT) AS about FROM memories WHERE is_active GROUP BY scope_id")
def cluster_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes stand for clusters."""
    return W.topic_members(A.memories(spark, sf_dir).where("is_active").select(F.col("scope_id").alias("cluster"), "content"), "Tion")


_FILES = """rel AS (SELECT 'n' || (l_suppkey % 25) AS scope_id, 's' || l_suppkey AS subject, 'calls' AS predicate, 'p' || l_partkey AS object, 'f' || (l_suppkey % 40) AS source_file FROM lineitem WHERE l_linenumber = 1),
edges AS (SELECT 'n' || (l_suppkey % 25) AS scope_id, 's' || l_suppkey AS subject, 'calls' AS predicate, 'p' || l_partkey AS object, 'f' || (l_suppkey % 40) AS source_file FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 40 < 20)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = read_table(spark, sf_dir, "lineitem")
    cols = ("concat('n', l_suppkey % 25) AS scope_id", "concat('s', l_suppkey) AS subject", "'calls' AS predicate", "concat('p', l_partkey) AS object", "concat('f', l_suppkey % 40) AS source_file")
    return line.where("l_linenumber = 1").selectExpr(*cols), line.where("l_linenumber = 2 AND l_suppkey % 40 < 20").selectExpr(*cols)


@query("index_files", f"""WITH {_FILES}, kept AS (SELECT * FROM rel WHERE (scope_id, source_file) NOT IN (SELECT (scope_id, source_file) FROM edges) UNION ALL SELECT * FROM edges)
SELECT scope_id, subject, predicate, object, min(source_file) AS source_file FROM kept GROUP BY ALL""")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files are indexed again: their old relations go."""
    old, edges = _files(spark, sf_dir)
    none = old.select("scope_id", F.lit("function").alias("entity_type"), F.col("subject").alias("canonical"))
    return W.index_files(none, old, none, edges)[1]


@query("delete_files", f"WITH {_FILES} SELECT * FROM rel WHERE (scope_id, source_file) NOT IN (SELECT (scope_id, source_file) FROM edges)")
def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, edges = _files(spark, sf_dir)
    return W.delete_files(old, edges.select("scope_id", "source_file")).select("scope_id", "subject", "predicate", "object", "source_file")


@query("visible_page", f"WITH {A.ARTIFACTS_SQL} SELECT id, visibility FROM artifacts WHERE status = 'published' AND (owner_scope_id IN ('n1', 'n2', 'n3') OR visibility = 'company') ORDER BY created_at DESC, id LIMIT 50 OFFSET 10")
def visible_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of what some scopes own and of what is company-wide."""
    hit = F.col("owner_scope_id").isin("n1", "n2", "n3") | (F.col("visibility") == "company")
    return A.artifacts(spark, sf_dir).where((F.col("status") == "published") & hit).orderBy(F.desc("created_at"), "id").offset(10).limit(50).select("id", "visibility")


@query("chunk_children", "SELECT conv_id AS parent_id, turn, md5(text) AS content_hash FROM conversations WHERE role <> 'system' ORDER BY conv_id, turn")
def chunk_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the chunks of a conversation, in order."""
    rows = read_table(spark, sf_dir, "conversations").where("role <> 'system'")
    return rows.select(F.col("conv_id").alias("parent_id"), "turn", F.md5("text").alias("content_hash"))


@query("entity_memories", f"""WITH {A.MEMORIES_SQL}, m AS (SELECT 'p' || (id % 200 + 1) AS entity_id, id, row_number() OVER (PARTITION BY id % 200 ORDER BY created_at DESC, id) AS place FROM memories WHERE is_active)
SELECT entity_id, id FROM m WHERE place <= 3""")
def entity_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest memories of every entity."""
    rows = A.memories(spark, sf_dir).where("is_active").selectExpr("concat('p', id % 200 + 1) AS entity_id", "id", "unix_timestamp(created_at) AS score")
    return R.best(rows, 3, min_score=0, by=["entity_id"]).select("entity_id", "id")


@query("combined_scores", f"WITH {A.MEMORIES_SQL} SELECT id, round(0.50 * importance + 0.20 * (access_count / 20.0::DOUBLE) + 0.20 * importance + 0.10 + CASE WHEN id % 3 = 0 THEN 0.10 ELSE 0 END, 6) AS score FROM memories")
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = R.combine_scores(F.col("importance"), F.col("access_count") / 20.0, F.col("importance"), F.lit(1.0), F.col("id") % 3 == 0)
    return A.memories(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


_STRINGS = "s AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN ' team : ' || source || ' ' WHEN 1 THEN 'project:' || lang || ':x' WHEN 2 THEN lang WHEN 3 THEN ':' || lang WHEN 4 THEN 'user: ' ELSE '' END AS scope FROM documents)"


@query("scope_strings", f"""WITH {_STRINGS}, p AS (SELECT id, trim(scope) AS t FROM s), q AS (SELECT id, t, trim(split_part(t, ':', 1)) AS kind, trim(substring(t, strpos(t, ':') + 1)) AS rest FROM p)
SELECT id, CASE WHEN contains(t, ':') AND kind <> '' AND rest <> '' THEN kind END AS kind, CASE WHEN contains(t, ':') AND kind <> '' AND rest <> '' THEN rest END AS external_id,
  regexp_replace(CASE WHEN contains(t, ':') AND kind <> '' AND rest <> '' THEN rest END, '[^a-zA-Z0-9_]', '_', 'g') AS label FROM q""")
def scope_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.expr("CASE doc_id % 6 WHEN 0 THEN concat(' team : ', source, ' ') WHEN 1 THEN concat('project:', lang, ':x') WHEN 2 THEN lang WHEN 3 THEN concat(':', lang) WHEN 4 THEN 'user: ' ELSE '' END")
    parsed = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.scope_parts(scope).alias("p")).select("id", "p.kind", "p.external_id")
    return parsed.withColumn("label", T.path_label(F.col("external_id")))


@query("skill_slugs", r"""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN ' ?? ' END AS slug, CASE WHEN p_partkey % 2 = 0 THEN 'dir\' || p_brand || '.skill.md' ELSE '' END AS file, p_type AS name FROM part),
c AS (SELECT id, list_transform([slug, regexp_replace(regexp_extract(replace(file, '\', '/'), '([^/]*)$', 1), '\.[^.]*$', ''), name], lambda x: regexp_replace(regexp_replace(lower(trim(coalesce(x, ''))), '[^a-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')) AS each FROM n),
s AS (SELECT id, list_filter(each, lambda x: x <> '')[1] AS slug FROM c)
SELECT id, slug, array_to_string(list_transform(list_filter(regexp_split_to_array(slug, '[-_]'), lambda x: x <> ''), lambda x: upper(x[1]) || substring(x, 2)), ' ') AS title FROM s""")
def skill_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = T.first_slug(F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN ' ?? ' END"), F.expr(r"CASE WHEN p_partkey % 2 = 0 THEN concat('dir\\', p_brand, '.skill.md') ELSE '' END"), F.col("p_type"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), slug.alias("slug")).withColumn("title", T.title_of_slug(F.col("slug")))


_ACTIONS = ["submit", "endorse", "endorse", "submit", "retract", "deprecate", "republish", "endorse", "rollback", "submit", "endorse"]


def _replay_sql(rules: str, required: int) -> str:
    """The state machine as a recursion over the numbered events of each artifact."""
    edit = "(e.adm OR e.own)" if rules == "knowledge" else "TRUE"
    can = "(e.adm OR NOT e.own AND f.status = 'in_review')" if rules == "knowledge" else "(NOT e.own AND f.status = 'in_review')"
    back = "e.adm" if rules == "knowledge" else "e.adm AND f.status <> 'draft'"
    again = "coalesce(f.published_at, e.ts)" if rules == "knowledge" else "e.ts"
    count = "len(list_distinct(list_append(f.endorsers, e.actor)))"
    cases = [
        ("f.status = 'deleted'", "f.status"), (f"e.action = 'submit' AND f.status = 'draft' AND {edit}", "'in_review'"), (f"e.action = 'retract' AND f.status = 'in_review' AND {edit}", "'draft'"),
        ("e.action = 'deprecate' AND f.status = 'published' AND e.adm", "'deprecated'"), ("e.action = 'republish' AND f.status = 'deprecated' AND e.adm", "'published'"), (f"e.action = 'rollback' AND {back}", "'draft'"),
        (f"e.action = 'endorse' AND {can} AND {count} >= {required}", "'published'"),
    ] + ([("e.action = 'delete' AND e.adm", "'deleted'")] if rules == "knowledge" else [])
    status = "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases) + " ELSE f.status END"
    return f"""WITH RECURSIVE e AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts, CASE WHEN event_id % 211 = 0 THEN 'delete' ELSE ({_ACTIONS!r})[event_id * 7 % 11 + 1] END AS action,
  'u' || (event_id % 7) AS actor, event_id % 7 < 2 AS adm, event_id % 7 = 3 AS own FROM events),
f AS (SELECT DISTINCT k, 0::BIGINT AS n, 'draft' AS status, []::VARCHAR[] AS endorsers, NULL::TIMESTAMP AS published_at FROM e
  UNION ALL SELECT e.k, e.n, {status}, CASE WHEN e.action = 'endorse' AND {can} AND f.status <> 'deleted' THEN list_distinct(list_append(f.endorsers, e.actor)) ELSE f.endorsers END,
    CASE WHEN f.status <> 'deleted' AND e.action = 'endorse' AND {can} AND {count} >= {required} THEN e.ts WHEN {status} = 'published' AND f.status = 'deprecated' THEN {again} ELSE f.published_at END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
SELECT k AS artifact_id, arg_max(status, n) AS status, CAST(len(arg_max(endorsers, n)) AS INT) AS endorsements, max_by(struct_pack(p := published_at), n).p AS published_at FROM f GROUP BY k"""


def _replayed(spark: SparkSession, sf_dir: str, rules: str, required: int) -> DataFrame:
    """Every user's events as the review of one artifact by seven persons, of whom two are admins and one the author."""
    names = F.array(*[F.lit(a) for a in _ACTIONS])
    action = F.when(F.col("event_id") % 211 == 0, "delete").otherwise(F.element_at(names, (F.col("event_id") * 7 % 11 + 1).cast("int")))
    log = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("artifact_id"), "ts", "event_id", action.alias("action"), F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("actor"),
        (F.col("event_id") % 7 < 2).alias("is_admin"), (F.col("event_id") % 7 == 3).alias("is_author"),
    )
    return L.replay_review(log, "artifact_id", "ts", ["event_id"], rules, required)


@query("knowledge_review", _replay_sql("knowledge", 3))
def knowledge_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "knowledge", 3)


@query("skill_review", _replay_sql("skill", 3))
def skill_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "skill", 3)


_SKILL_EDITS = """sk AS (SELECT p_partkey AS id, CAST(p_size AS INT) AS version, p_name AS body, p_type AS parameters FROM part),
f AS (SELECT p_partkey AS skill_id, 'scripts/run' || n || '.sh' AS relative_path, p_brand || n AS content, TRUE AS is_executable FROM part, range(0, 2) t(n)),
e AS (SELECT p_partkey + 3 AS id, p_name || '!' AS body, p_brand AS parameters, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS form FROM part WHERE p_partkey % 3 = 0),
bad AS (SELECT id FROM e WHERE form = 3 UNION SELECT id FROM e WHERE id NOT IN (SELECT id FROM sk)), good AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM bad))"""


@query("skill_edits", f"""WITH {_SKILL_EDITS}
SELECT 'skill' AS what, sk.id, CAST(sk.version + CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS INT) AS version, coalesce(g.body, sk.body) AS text, '' AS path FROM sk LEFT JOIN good g USING (id)
UNION ALL SELECT 'history', sk.id, sk.version, sk.body, '' FROM sk JOIN good USING (id)
UNION ALL SELECT 'history_file', f.skill_id, sk.version, f.content, f.relative_path FROM f JOIN good ON good.id = skill_id JOIN sk ON sk.id = skill_id
UNION ALL SELECT 'file', skill_id, NULL, content, relative_path FROM f WHERE skill_id NOT IN (SELECT id FROM good WHERE form > 0)
UNION ALL SELECT 'file', id, NULL, body, 'references/note.md' FROM good WHERE form = 1
UNION ALL SELECT 'refused', id, NULL, CASE WHEN form = 3 THEN 'not below references/' ELSE 'unknown skill' END, CASE WHEN form = 3 THEN 'note.md' END FROM e WHERE form = 3 OR id NOT IN (SELECT id FROM sk) AND form <> 3
UNION ALL SELECT 'refused', id, NULL, 'unknown skill', NULL FROM e WHERE form = 3 AND id NOT IN (SELECT id FROM sk)""")
def skill_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part is edited: files stay, are replaced, all go, or one is not valid, which refuses the edit."""
    part = read_table(spark, sf_dir, "part")
    skills = part.selectExpr("p_partkey AS id", "p_size AS version", "p_name AS body", "p_type AS parameters")
    files = part.selectExpr("p_partkey AS skill_id", "explode(sequence(0, 1)) AS n", "p_brand").selectExpr("skill_id", "concat('scripts/run', n, '.sh') AS relative_path", "concat(p_brand, n) AS content", "true AS is_executable")
    one = lambda path: f"array(named_struct('relative_path', '{path}', 'content', concat(p_name, '!'), 'is_executable', false))"
    none = "CAST(array() AS ARRAY<STRUCT<relative_path: STRING, content: STRING, is_executable: BOOLEAN>>)"
    listed = f"CASE p_partkey % 4 WHEN 1 THEN {one('references/note.md')} WHEN 2 THEN {none} WHEN 3 THEN {one('note.md')} END AS files"
    edits = part.where("p_partkey % 3 = 0").selectExpr("p_partkey + 3 AS id", "concat(p_name, '!') AS body", "p_brand AS parameters", "'c1' AS changed_by", listed)
    done = W.edit_skills(skills, files, edits)
    row = lambda d, what, id_, version, text, path: d.select(F.lit(what).alias("what"), F.col(id_).alias("id"), version.cast("int").alias("version"), F.col(text).alias("text"), path.alias("path"))
    null, blank = F.lit(None), F.lit("")
    out = row(done["skills"], "skill", "id", F.col("version"), "body", blank).unionByName(row(done["history"], "history", "skill_id", F.col("version"), "body", blank))
    out = out.unionByName(row(done["history_files"], "history_file", "skill_id", F.col("version"), "content", F.col("relative_path")))
    out = out.unionByName(row(done["files"], "file", "skill_id", null, "content", F.col("relative_path")))
    return out.unionByName(row(done["refused"], "refused", "id", null, "problem", F.col("relative_path")))
