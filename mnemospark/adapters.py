"""Binds the given tables to the memory model; the only module that knows how.

Scopes are regions, nations and customers; memories and artifacts are documents with the embedding
of the same number; skills are parts; entities are parts and suppliers. Attributes that the
tables lack follow from the keys, so that every run and the SQL oracle see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, read_table

#: More nations than this are joined by a shuffle.
MAX_NATIONS = 10_000

NOW = "2024-02-01 00:00:00"


def now() -> Column:
    """The time that the queries take as the present, so that reruns agree."""
    return F.lit(NOW).cast("timestamp")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, parent_id, path, depth): the tree company (region) > team (nation) > user (customer)."""
    r = read_table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS id", "'company' AS kind", "CAST(NULL AS STRING) AS parent_id", "concat('r', r_regionkey) AS path", "1 AS depth")
    n = read_table(spark, sf_dir, "nation")
    nations = n.selectExpr("concat('n', n_nationkey) AS id", "'team' AS kind", "concat('r', n_regionkey) AS parent_id", "concat('r', n_regionkey, '.n', n_nationkey) AS path", "2 AS depth")
    c = read_table(spark, sf_dir, "customer").join(broadcast_if_small(n.select("n_nationkey", "n_regionkey"), MAX_NATIONS), F.expr("c_nationkey = n_nationkey"))
    users = c.selectExpr("concat('c', c_custkey) AS id", "'user' AS kind", "concat('n', c_nationkey) AS parent_id", "concat('r', n_regionkey, '.n', c_nationkey, '.c', c_custkey) AS path", "3 AS depth")
    return r.unionByName(nations).unionByName(users)


SCOPES_SQL = """scopes AS (
  SELECT 'r' || r_regionkey AS id, 'company' AS kind, CAST(NULL AS VARCHAR) AS parent_id, 'r' || r_regionkey AS path, 1 AS depth FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'team', 'r' || n_regionkey, 'r' || n_regionkey || '.n' || n_nationkey, 2 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'user', 'n' || c_nationkey, 'r' || n_regionkey || '.n' || c_nationkey || '.c' || c_custkey, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def owned_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scopes`` with ``principal_id``, the owner: the group or customer of the scope's own id."""
    return scopes(spark, sf_dir).withColumn("principal_id", F.col("id"))


OWNED_SCOPES_SQL = SCOPES_SQL.replace("scopes AS (", "tree AS (", 1) + ", scopes AS (SELECT *, id AS principal_id FROM tree)"


def system_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(principal_id): the first region."""
    return read_table(spark, sf_dir, "region").where("r_regionkey = 0").selectExpr("concat('r', r_regionkey) AS principal_id")


SYSTEM_ADMINS_SQL = "system_admins AS (SELECT 'r' || r_regionkey AS principal_id FROM region WHERE r_regionkey = 0)"


def asked_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(principal_id, scope_id): every customer and nation asks for its own scope, those above it, a nation and a region beside it."""
    c = read_table(spark, sf_dir, "customer").join(broadcast_if_small(read_table(spark, sf_dir, "nation"), MAX_NATIONS), F.expr("c_nationkey = n_nationkey"))
    each = c.selectExpr("concat('c', c_custkey) AS principal_id", "explode(array(concat('c', c_custkey), concat('n', c_nationkey), concat('r', n_regionkey), concat('n', (c_nationkey + 3) % 25), concat('c', c_custkey + 5), concat('r', (n_regionkey + 1) % 5))) AS scope_id")
    n = read_table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS principal_id", "explode(array(concat('n', n_nationkey), concat('r', n_regionkey), concat('n', (n_nationkey + 1) % 25))) AS scope_id")
    r = read_table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS principal_id", "explode(array(concat('r', r_regionkey), concat('n', r_regionkey), concat('r', (r_regionkey + 1) % 5))) AS scope_id")
    return each.unionByName(n).unionByName(r)


ASKED_SCOPES_SQL = """asked AS (
  SELECT 'c' || c_custkey AS principal_id, unnest(['c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey, 'n' || ((c_nationkey + 3) % 25), 'c' || (c_custkey + 5), 'r' || ((n_regionkey + 1) % 5)]) AS scope_id
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'n' || n_nationkey, unnest(['n' || n_nationkey, 'r' || n_regionkey, 'n' || ((n_nationkey + 1) % 25)]) FROM nation
  UNION SELECT 'r' || r_regionkey, unnest(['r' || r_regionkey, 'n' || r_regionkey, 'r' || ((r_regionkey + 1) % 5)]) FROM region)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, principal_id, permissions, scope_ids, revoked_at, expires_at): one token for every customer, some bound to scopes, revoked, expired or invalid."""
    return read_table(spark, sf_dir, "customer").selectExpr(
        "concat('t', c_custkey) AS token_id", "concat('c', c_custkey) AS principal_id",
        "CASE c_custkey % 5 WHEN 0 THEN array('read') WHEN 1 THEN array('memories:read', 'memories:write', 'skills:read') WHEN 2 THEN array('admin') WHEN 3 THEN array('write', 'graph:read') ELSE array('graph:write', 'read') END AS permissions",
        "CASE WHEN c_custkey % 4 = 0 THEN array(concat('n', c_nationkey)) WHEN c_custkey % 4 = 1 THEN CAST(array() AS ARRAY<STRING>) END AS scope_ids",
        f"CASE WHEN c_custkey % 11 = 0 THEN timestamp'{NOW}' - INTERVAL 1 DAY END AS revoked_at",
        f"CASE WHEN c_custkey % 7 = 0 THEN timestamp'{NOW}' - INTERVAL 1 DAY WHEN c_custkey % 7 = 1 THEN timestamp'{NOW}' + INTERVAL 1 DAY END AS expires_at",
    )


def sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact_id, grantee_scope_id, expires_at): every seventh artifact is shared with a nation or a region."""
    return read_table(spark, sf_dir, "documents").where("doc_id % 21 = 0").selectExpr(
        "doc_id AS artifact_id", "CASE WHEN doc_id % 2 = 0 THEN concat('r', doc_id % 5) ELSE concat('n', doc_id % 25) END AS grantee_scope_id",
        f"CASE WHEN doc_id % 4 = 0 THEN timestamp'{NOW}' - INTERVAL 1 DAY WHEN doc_id % 4 = 1 THEN timestamp'{NOW}' + INTERVAL 1 DAY END AS expires_at",
    )


SHARING_SQL = f"""sharing AS (SELECT doc_id AS artifact_id, CASE WHEN doc_id % 2 = 0 THEN 'r' || (doc_id % 5) ELSE 'n' || (doc_id % 25) END AS grantee_scope_id,
  CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY WHEN doc_id % 4 = 1 THEN TIMESTAMP '{NOW}' + INTERVAL 1 DAY END AS expires_at FROM documents WHERE doc_id % 21 = 0)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories; every fifth belongs to a region, the others to a nation."""
    return read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "CASE WHEN doc_id % 5 = 0 THEN concat('r', doc_id % 5 + doc_id % 3) ELSE concat('n', doc_id % 25) END AS scope_id",
        "element_at(array('semantic', 'episodic', 'procedural', 'working'), CAST(doc_id % 4 + 1 AS INT)) AS memory_type",
        "coalesce(text, '') AS content",
        "CASE WHEN doc_id % 6 = 0 THEN concat('file:src/', source, '/m', doc_id % 9, '.py:', doc_id % 90 + 1) ELSE concat('pr:', doc_id % 50) END AS source_ref",
        "(doc_id * 37 % 100) / 100D AS importance",
        "CAST(doc_id * 13 % 20 AS INT) AS access_count",
        f"timestamp_seconds(unix_timestamp(timestamp'{NOW}') - 3600 * (doc_id * 7 % 4000)) AS created_at",
        f"CASE WHEN doc_id % 3 = 0 THEN NULL ELSE timestamp_seconds(unix_timestamp(timestamp'{NOW}') - 3600 * (doc_id * 7 % 4000) + 1800 * (doc_id % 90)) END AS last_accessed",
        f"CASE WHEN doc_id % 4 = 3 THEN timestamp_seconds(unix_timestamp(timestamp'{NOW}') + 60 * (doc_id % 121 - 60)) END AS expires_at",
        "doc_id % 17 <> 0 AS is_active",
        "CASE WHEN doc_id % 7 = 0 THEN 'code' ELSE 'text' END AS content_kind",
        "CASE WHEN doc_id % 11 = 0 THEN doc_id - doc_id % 3 END AS promoted_to",
        "CASE WHEN doc_id % 4 = 0 THEN 'promoted' WHEN doc_id % 4 = 1 THEN 'nominated' ELSE 'none' END AS promotion_status",
    )


MEMORIES_SQL = f"""memories AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'r' || (doc_id % 5 + doc_id % 3) ELSE 'n' || (doc_id % 25) END AS scope_id,
    (['semantic', 'episodic', 'procedural', 'working'])[doc_id % 4 + 1] AS memory_type, coalesce(text, '') AS content,
    CASE WHEN doc_id % 6 = 0 THEN 'file:src/' || source || '/m' || (doc_id % 9) || '.py:' || (doc_id % 90 + 1) ELSE 'pr:' || (doc_id % 50) END AS source_ref,
    (doc_id * 37 % 100) / 100.0::DOUBLE AS importance, CAST(doc_id * 13 % 20 AS INT) AS access_count,
    TIMESTAMP '{NOW}' - to_seconds(3600 * (doc_id * 7 % 4000)) AS created_at,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE TIMESTAMP '{NOW}' - to_seconds(3600 * (doc_id * 7 % 4000) - 1800 * (doc_id % 90)) END AS last_accessed,
    CASE WHEN doc_id % 4 = 3 THEN TIMESTAMP '{NOW}' + to_seconds(60 * (doc_id % 121 - 60)) END AS expires_at,
    doc_id % 17 <> 0 AS is_active, CASE WHEN doc_id % 7 = 0 THEN 'code' ELSE 'text' END AS content_kind,
    CASE WHEN doc_id % 11 = 0 THEN doc_id - doc_id % 3 END AS promoted_to,
    CASE WHEN doc_id % 4 = 0 THEN 'promoted' WHEN doc_id % 4 = 1 THEN 'nominated' ELSE 'none' END AS promotion_status FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): the embedding that bears a document's number, in double precision."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


VECTORS_SQL = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document as a knowledge artifact."""
    return read_table(spark, sf_dir, "documents").where("doc_id % 3 = 0").selectExpr(
        "doc_id AS id",
        "concat('n', doc_id % 25) AS owner_scope_id",
        "element_at(array('general', 'decision', 'spec', 'meeting', 'retro', 'research'), CAST(doc_id div 3 % 6 + 1 AS INT)) AS kind",
        "element_at(array('project', 'team', 'department', 'company', 'private'), CAST(doc_id div 3 % 5 + 1 AS INT)) AS visibility",
        "CASE WHEN doc_id % 8 = 0 THEN 'draft' WHEN doc_id % 8 = 1 THEN 'in_review' ELSE 'published' END AS status",
        "substring(coalesce(text, ''), 1, 60) AS title",
        "coalesce(text, '') AS content",
        "CASE WHEN doc_id % 2 = 0 THEN substring(coalesce(text, ''), 1, 120) END AS summary",
        "CAST(doc_id % 14 AS INT) AS endorsement_count",
        f"timestamp_seconds(unix_timestamp(timestamp'{NOW}') - 86400 * (doc_id % 400)) AS created_at",
        f"CASE WHEN doc_id % 4 < 3 THEN timestamp_seconds(unix_timestamp(timestamp'{NOW}') - 43200 * (doc_id % 400)) END AS published_at",
        f"CASE WHEN doc_id % 2 = 0 THEN timestamp_seconds(unix_timestamp(timestamp'{NOW}') - 86400 * (doc_id % 200)) END AS last_accessed",
        "CASE WHEN doc_id % 30 = 0 THEN 'digest' ELSE 'artifact' END AS artifact_kind",
    )


ARTIFACTS_SQL = f"""artifacts AS (
  SELECT doc_id AS id, 'n' || (doc_id % 25) AS owner_scope_id,
    (['general', 'decision', 'spec', 'meeting', 'retro', 'research'])[doc_id // 3 % 6 + 1] AS kind,
    (['project', 'team', 'department', 'company', 'private'])[doc_id // 3 % 5 + 1] AS visibility,
    CASE WHEN doc_id % 8 = 0 THEN 'draft' WHEN doc_id % 8 = 1 THEN 'in_review' ELSE 'published' END AS status,
    substring(coalesce(text, ''), 1, 60) AS title, coalesce(text, '') AS content, CASE WHEN doc_id % 2 = 0 THEN substring(coalesce(text, ''), 1, 120) END AS summary,
    CAST(doc_id % 14 AS INT) AS endorsement_count, TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 400 AS INT)) AS created_at,
    CASE WHEN doc_id % 4 < 3 THEN TIMESTAMP '{NOW}' - to_seconds(43200 * (doc_id % 400)) END AS published_at,
    CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 200 AS INT)) END AS last_accessed,
    CASE WHEN doc_id % 30 = 0 THEN 'digest' ELSE 'artifact' END AS artifact_kind FROM documents WHERE doc_id % 3 = 0)"""


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills."""
    return read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('n', p_partkey % 25) AS scope_id", "p_name AS name", "concat(p_type, ' ', p_brand) AS description",
        "CASE p_size % 3 WHEN 0 THEN array('any') WHEN 1 THEN array('coder', 'reviewer') ELSE array('planner') END AS agent_types",
        "CASE WHEN p_partkey % 4 = 0 THEN 'draft' ELSE 'published' END AS status", "p_partkey * 7 % 250 AS invocation_count",
    )


SKILLS_SQL = """skills AS (
  SELECT p_partkey AS id, 'n' || (p_partkey % 25) AS scope_id, p_name AS name, p_type || ' ' || p_brand AS description,
    CASE p_size % 3 WHEN 0 THEN ['any'] WHEN 1 THEN ['coder', 'reviewer'] ELSE ['planner'] END AS agent_types,
    CASE WHEN p_partkey % 4 = 0 THEN 'draft' ELSE 'published' END AS status, p_partkey * 7 % 250 AS invocation_count FROM part)"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member_id, parent_id, role): customers belong to nations, nations to regions."""
    c = read_table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS member_id", "concat('n', c_nationkey) AS parent_id", "element_at(array('member', 'admin', 'owner'), CAST(c_custkey % 3 + 1 AS INT)) AS role")
    n = read_table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS member_id", "concat('r', n_regionkey) AS parent_id", "element_at(array('member', 'admin', 'owner'), n_nationkey % 3 + 1) AS role")
    return c.unionByName(n)


MEMBERSHIPS_SQL = """memberships AS (
  SELECT 'c' || c_custkey AS member_id, 'n' || c_nationkey AS parent_id, (['member', 'admin', 'owner'])[c_custkey % 3 + 1] AS role FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (['member', 'admin', 'owner'])[n_nationkey % 3 + 1] FROM nation)"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(principal_id, scope_id, permissions, expires_at): one grant for every fifth customer."""
    return read_table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").selectExpr(
        "concat('c', c_custkey) AS principal_id", "concat('n', (c_nationkey + 3) % 25) AS scope_id",
        "CASE WHEN c_custkey % 2 = 0 THEN array('memories:read') ELSE array('memories:read', 'memories:write', 'skills:read') END AS permissions",
        f"CASE WHEN c_custkey % 3 = 0 THEN timestamp'{NOW}' - INTERVAL 1 DAY WHEN c_custkey % 3 = 1 THEN timestamp'{NOW}' + INTERVAL 1 DAY END AS expires_at",
    )


GRANTS_SQL = f"""grants AS (
  SELECT 'c' || c_custkey AS principal_id, 'n' || ((c_nationkey + 3) % 25) AS scope_id,
    CASE WHEN c_custkey % 2 = 0 THEN ['memories:read'] ELSE ['memories:read', 'memories:write', 'skills:read'] END AS permissions,
    CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY WHEN c_custkey % 3 = 1 THEN TIMESTAMP '{NOW}' + INTERVAL 1 DAY END AS expires_at FROM customer WHERE c_custkey % 5 = 0)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope_id, subject_id, predicate, object_id, confidence): parts, suppliers and orders as a graph of entities."""
    line = read_table(spark, sf_dir, "lineitem").selectExpr(
        "concat('n', l_suppkey % 25) AS scope_id", "concat('s', l_suppkey) AS subject_id",
        "CASE l_linenumber % 4 WHEN 0 THEN 'imports' WHEN 1 THEN 'calls' WHEN 2 THEN 'uses' ELSE 'defines' END AS predicate",
        "concat('p', l_partkey) AS object_id", "round(1 - l_discount, 2) AS confidence",
    )
    return line.groupBy("scope_id", "subject_id", "predicate", "object_id").agg(F.max("confidence").alias("confidence"))


RELATIONS_SQL = """relations AS (
  SELECT scope_id, subject_id, predicate, object_id, max(c) AS confidence FROM (
    SELECT 'n' || (l_suppkey % 25) AS scope_id, 's' || l_suppkey AS subject_id,
      CASE l_linenumber % 4 WHEN 0 THEN 'imports' WHEN 1 THEN 'calls' WHEN 2 THEN 'uses' ELSE 'defines' END AS predicate,
      'p' || l_partkey AS object_id, round(1 - l_discount, 2) AS c FROM lineitem) GROUP BY ALL)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, scope_id, entity_type, name): suppliers as services, parts as functions, classes and variables."""
    s = read_table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS entity_id", "concat('n', s_suppkey % 25) AS scope_id", "'service' AS entity_type", "concat('s', s_suppkey) AS name")
    kinds = "CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END AS entity_type"
    p = read_table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) AS entity_id", "concat('n', p_partkey % 25) AS scope_id", kinds, "p_name AS name")
    return s.unionByName(p)


ENTITIES_SQL = """entities AS (
  SELECT 's' || s_suppkey AS entity_id, 'n' || (s_suppkey % 25) AS scope_id, 'service' AS entity_type, 's' || s_suppkey AS name FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'n' || (p_partkey % 25), CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END, p_name FROM part)"""
