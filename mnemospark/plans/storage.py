"""Registered queries: tables, paging, history and lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import adapters as A
from mnemospark.operators import lifecycle as L
from mnemospark.operators import storage as S
from mnemospark.operators.scoping import newest_versions
from mnemospark.plans.registry import query
from mnemospark.session import read_table


@query("point_lookup", f"WITH {A.MEMORIES_SQL} SELECT id, memory_type, source_ref FROM memories WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read_table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return A.memories(spark, sf_dir).join(keys, "id", "left_semi").select("id", "memory_type", "source_ref")


@query("filtered_scan", f"WITH {A.ARTIFACTS_SQL} SELECT id, status, kind FROM artifacts WHERE status = 'published' AND kind = 'decision' AND title ILIKE '%th%'")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter is optional: an empty value keeps all rows."""
    wanted = {"status": "published", "kind": "decision", "owner_scope_id": ""}
    rows = A.artifacts(spark, sf_dir).where(F.col("title").ilike("%th%"))
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value) if value else rows
    return rows.select("id", "status", "kind")


@query("upsert_entities", """WITH old AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey), new AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_custkey)
SELECT coalesce(new.k, old.k) AS k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new ON old.k = new.k""")
def upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    part = lambda when: orders.where(when).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return S.upsert(part("o_orderdate < timestamp'1996-01-01'"), part("o_orderdate >= timestamp'1996-01-01'"), ["k"])


@query("newest_versions", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_versions(read_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("insert_ignore", """WITH old AS (SELECT DISTINCT l_orderkey AS k, 'old' AS src FROM lineitem WHERE l_returnflag = 'R'), new AS (SELECT DISTINCT o_orderkey AS k, 'new' AS src FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit("old").alias("src")).distinct()
    new = read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("src")).distinct()
    return S.insert_ignore(old, new, ["k"])


@query("soft_delete", f"WITH {A.MEMORIES_SQL} SELECT id, is_active AND memory_type <> 'working' AS is_active, CASE WHEN memory_type = 'episodic' THEN access_count + 1 ELSE access_count END AS access_count FROM memories")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.update_where(A.memories(spark, sf_dir), F.col("memory_type") == "working", {"is_active": F.lit(False)})
    return S.update_where(rows, F.col("memory_type") == "episodic", {"access_count": F.col("access_count") + 1}).select("id", "is_active", "access_count")


@query("delete_expired_grants", f"WITH {A.GRANTS_SQL} SELECT principal_id, scope_id FROM grants WHERE NOT coalesce(expires_at < TIMESTAMP '{A.NOW}', false)")
def delete_expired_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.delete_where(A.grants(spark, sf_dir), F.col("expires_at") < F.lit(A.NOW).cast("timestamp")).select("principal_id", "scope_id")


@query("keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-17', 100) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = {"o_orderdate": F.lit("1995-06-17").cast("timestamp"), "o_orderkey": F.lit(100).cast("long")}
    rows = read_table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return S.keyset_page(rows, ["o_orderdate", "o_orderkey"], after, 100).select("o_orderkey", "o_orderdate")


@query("offset_page", f"WITH {A.MEMORIES_SQL} SELECT id, created_at FROM memories WHERE is_active ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.offset_page(A.memories(spark, sf_dir).where("is_active"), [F.desc("created_at"), F.col("id")], 100, 50).select("id", "created_at")


@query("version_history", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS version, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.versions(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("registry_diff", """WITH a AS (SELECT p_name AS slug, max(p_size) AS v FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), b AS (SELECT p_name AS slug, max(p_size) AS v FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1)
SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN b.slug IS NULL THEN 'installed' WHEN a.slug IS NULL THEN 'orphaned' WHEN a.v <> b.v THEN 'updated' ELSE 'same' END AS state FROM a FULL JOIN b ON a.slug = b.slug""")
def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    side = lambda where, v: part.where(where).groupBy(F.col("p_name").alias("slug")).agg(F.max("p_size").alias(v))
    both = side("p_partkey % 3 <> 0", "here").join(side("p_partkey % 3 <> 1", "there"), "slug", "full")
    state = F.when(F.col("there").isNull(), "installed").when(F.col("here").isNull(), "orphaned").when(F.col("here") != F.col("there"), "updated").otherwise("same")
    return both.select("slug", state.alias("state"))


@query("lifecycle_replay")
def lifecycle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as the log of one artifact."""
    action = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "submit", "view", "endorse", "click", "endorse", "purchase", "deprecate", "error", "republish")]), F.col("event_type"))
    log = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact_id"), "ts", "event_id", action.alias("action"), F.concat(F.lit("u"), F.col("event_id") % 7).alias("actor"))
    return L.replay(log, "artifact_id", ["ts", "event_id"])


_REQUESTS = "requests AS (SELECT doc_id * 10 AS request_id, doc_id AS memory_id, CASE WHEN doc_id % 5 = 0 THEN 'reject' ELSE 'approve' END AS decision, CASE WHEN doc_id % 7 = 0 THEN 'approved' ELSE 'pending' END AS status FROM documents WHERE doc_id % 4 = 1)"


@query("promotion_flow", f"WITH {A.MEMORIES_SQL}, {_REQUESTS} SELECT request_id AS artifact_id, memory_id AS source_memory_id, 'draft' AS status FROM requests JOIN memories ON id = memory_id WHERE status = 'pending' AND decision = 'approve'")
def promotion_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read_table(spark, sf_dir, "documents").where("doc_id % 4 = 1").selectExpr("doc_id * 10 AS request_id", "doc_id AS memory_id", "CASE WHEN doc_id % 5 = 0 THEN 'reject' ELSE 'approve' END AS decision", "CASE WHEN doc_id % 7 = 0 THEN 'approved' ELSE 'pending' END AS status")
    drafts, _ = L.approve_promotions(A.memories(spark, sf_dir), requests)
    return drafts.select("artifact_id", "source_memory_id", "status")


@query("synthesise", f"""WITH {A.ARTIFACTS_SQL}, s AS (SELECT owner_scope_id, id, title, content, CAST((row_number() OVER (PARTITION BY owner_scope_id ORDER BY id) - 1) // {L.LISTED} AS INT) AS part, CAST(count(*) OVER (PARTITION BY owner_scope_id) AS INT) AS sources
  FROM artifacts WHERE status = 'published' AND artifact_kind <> 'digest')
SELECT owner_scope_id, part, sources, md5(string_agg('## ' || title || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY id)) AS content_hash FROM s WHERE sources >= 2 GROUP BY ALL""")
def synthesise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.artifacts(spark, sf_dir).where("status = 'published' AND artifact_kind <> 'digest'").select("owner_scope_id", "id", "title", "content")
    return L.synthesise(rows, "owner_scope_id").select("owner_scope_id", "part", "sources", F.md5("content").alias("content_hash"))


@query("active_memories", f"WITH {A.MEMORIES_SQL} SELECT scope_id, count(*) AS active FROM memories WHERE is_active GROUP BY scope_id")
def active_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.memories(spark, sf_dir).where("is_active").groupBy("scope_id").agg(F.count(F.lit(1)).alias("active"))


@query("delete_cascades", f"""WITH {A.ENTITIES_SQL}, {A.RELATIONS_SQL}, gone AS (SELECT entity_id FROM entities WHERE scope_id IN ('n3', 'n7')), links AS (SELECT doc_id AS memory_id, 'p' || (doc_id % 200 + 1) AS entity_id FROM documents)
SELECT 'entity' AS what, entity_id AS a, scope_id AS b, '' AS c FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM gone)
UNION ALL SELECT 'relation', subject_id, predicate, object_id FROM relations WHERE subject_id NOT IN (SELECT entity_id FROM gone) AND object_id NOT IN (SELECT entity_id FROM gone)
UNION ALL SELECT 'link', CAST(memory_id AS VARCHAR), entity_id, '' FROM links WHERE entity_id NOT IN (SELECT entity_id FROM gone)""")
def delete_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two scopes go, with the relations and links that name them."""
    links = read_table(spark, sf_dir, "documents").selectExpr("doc_id AS memory_id", "concat('p', doc_id % 200 + 1) AS entity_id")
    relations = A.relations(spark, sf_dir).select("subject_id", "predicate", "object_id")
    kept, left = S.delete_cascading(A.entities(spark, sf_dir), F.col("scope_id").isin("n3", "n7"), "entity_id", {"relation": (relations, ["subject_id", "object_id"]), "link": (links, ["entity_id"])})
    row = lambda d, what, a, b, c: d.select(F.lit(what).alias("what"), F.col(a).cast("string").alias("a"), F.col(b).alias("b"), c.alias("c"))
    out = row(kept, "entity", "entity_id", "scope_id", F.lit("")).unionByName(row(left["relation"], "relation", "subject_id", "predicate", F.col("object_id")))
    return out.unionByName(row(left["link"], "link", "memory_id", "entity_id", F.lit("")))
