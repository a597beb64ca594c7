"""Registered queries: scope hierarchy and access control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import adapters as A
from mnemospark.operators import scoping as S
from mnemospark.plans.registry import query


_UP = "up AS (SELECT a.id, u.id AS ancestor_id, a.depth - u.depth AS distance FROM scopes a JOIN scopes u ON a.path = u.path OR starts_with(a.path, u.path || '.'))"
_CLOSURE = "clo AS (SELECT member_id AS principal_id, parent_id AS ancestor_id FROM memberships UNION SELECT c.principal_id, m.parent_id FROM clo c JOIN memberships m ON m.member_id = c.ancestor_id)"


@query("scope_paths", f"WITH {A.SCOPES_SQL} SELECT id, kind, path, len(string_split(path, '.')) AS depth FROM scopes")
def scope_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scopes(spark, sf_dir).select("id", "kind", "path", F.size(F.split("path", r"\.")).cast("long").alias("depth"))


@query("scope_ancestors", f"WITH {A.SCOPES_SQL}, {_UP} SELECT id, ancestor_id, CAST(distance AS INT) AS distance FROM up")
def scope_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ancestors(A.scopes(spark, sf_dir))


@query("scope_descendants", f"WITH {A.SCOPES_SQL}, {_UP} SELECT ancestor_id AS id, count(*) AS descendants FROM up GROUP BY ancestor_id")
def scope_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ancestors(A.scopes(spark, sf_dir)).groupBy(F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("descendants"))


@query("scope_children", f"WITH {A.SCOPES_SQL} SELECT parent_id AS id, count(*) AS children FROM scopes WHERE parent_id IS NOT NULL GROUP BY parent_id")
def scope_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scopes(spark, sf_dir).where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))


@query("scope_fanout", f"WITH {A.SCOPES_SQL}, {_UP} SELECT 'q' || id AS query_id, ancestor_id AS scope_id FROM up WHERE distance <= 1 AND starts_with(id, 'c')")
def scope_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = A.scopes(spark, sf_dir)
    asked = scopes.where("kind = 'user'").select(F.concat(F.lit("q"), "id").alias("query_id"), F.col("id").alias("scope_id"))
    return S.fan_out(scopes, asked, max_depth=1)


@query("scope_lineage", f"WITH {A.SCOPES_SQL} SELECT s.id FROM scopes s, scopes t WHERE t.id = 'n7' AND (s.path = t.path OR starts_with(s.path, t.path || '.') OR starts_with(t.path, s.path || '.'))")
def scope_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = S.ancestors(A.scopes(spark, sf_dir))
    return up.where("ancestor_id = 'n7'").select("id").unionByName(up.where("id = 'n7'").select(F.col("ancestor_id").alias("id"))).distinct()


@query("principal_closure", f"WITH RECURSIVE {A.MEMBERSHIPS_SQL}, {_CLOSURE} SELECT principal_id, ancestor_id FROM clo")
def principal_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.closure(A.memberships(spark, sf_dir))


@query("membership_roles", f"""WITH RECURSIVE {A.MEMBERSHIPS_SQL}, {_CLOSURE}, m AS (SELECT *, CASE role WHEN 'owner' THEN 0 WHEN 'admin' THEN 1 ELSE 2 END AS rank FROM memberships)
SELECT principal_id, group_id, CAST(min(rank) AS INT) AS rank FROM (SELECT member_id AS principal_id, parent_id AS group_id, rank FROM m
  UNION ALL SELECT c.principal_id, m.parent_id, m.rank FROM clo c JOIN m ON m.member_id = c.ancestor_id) GROUP BY ALL""")
def membership_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.membership_roles(A.memberships(spark, sf_dir))


@query("scope_admins", f"WITH {A.MEMBERSHIPS_SQL} SELECT DISTINCT member_id AS principal_id FROM memberships WHERE role IN ('owner', 'admin')")
def scope_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.memberships(spark, sf_dir).where("role IN ('owner', 'admin')").select(F.col("member_id").alias("principal_id")).distinct()


@query("reachable_scopes", f"""WITH RECURSIVE {A.MEMBERSHIPS_SQL}, {A.SCOPES_SQL}, {A.GRANTS_SQL}, {_CLOSURE}, {_UP},
direct AS (SELECT principal_id, ancestor_id AS scope_id FROM clo UNION SELECT principal_id, scope_id FROM grants WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{A.NOW}')
SELECT principal_id, scope_id FROM direct UNION SELECT d.principal_id, u.ancestor_id FROM direct d JOIN up u ON u.id = d.scope_id""")
def reachable_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = A.grants(spark, sf_dir).where(F.col("expires_at").isNull() | (F.col("expires_at") > A.now())).select("principal_id", "scope_id")
    direct = S.closure(A.memberships(spark, sf_dir)).select("principal_id", F.col("ancestor_id").alias("scope_id")).unionByName(live).distinct()
    up = S.ancestors(A.scopes(spark, sf_dir)).select(F.col("id").alias("scope_id"), "ancestor_id")
    return direct.join(up, "scope_id").select("principal_id", F.col("ancestor_id").alias("scope_id")).distinct()


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LIVE = f"expires_at IS NULL OR expires_at > TIMESTAMP '{A.NOW}'"
_ROLE_SQL = "CASE role " + " ".join(f"WHEN '{r}' THEN {_listed(p)}" for r, p in S.ROLES.items()) + " END"
#: Every source of a permission on its own, as path containment between the asked scope and that of the source.
_EFFECTIVE = f"""ancestry AS (SELECT member_id AS principal_id, member_id AS id FROM memberships UNION SELECT parent_id, parent_id FROM memberships UNION SELECT a.principal_id, m.parent_id FROM ancestry a JOIN memberships m ON m.member_id = a.id),
source AS (SELECT principal_id, path, {_listed(S.ROLES["owner"])} AS perms FROM scopes
  UNION ALL SELECT a.principal_id, s.path, {_ROLE_SQL} FROM ancestry a JOIN memberships m ON m.member_id = a.id JOIN scopes s ON s.principal_id = m.parent_id
  UNION ALL SELECT g.principal_id, s.path, g.permissions FROM grants g JOIN scopes s ON s.id = g.scope_id WHERE {_LIVE}),
question AS (SELECT asked.*, path FROM asked JOIN scopes ON id = scope_id),
each AS (SELECT q.principal_id, q.scope_id, unnest(perms) AS p, FALSE AS upward FROM question q JOIN source s ON s.principal_id = q.principal_id AND (s.path = q.path OR starts_with(q.path, s.path || '.'))
  UNION ALL SELECT q.principal_id, q.scope_id, unnest(perms), TRUE FROM question q JOIN source s ON s.principal_id = q.principal_id AND starts_with(s.path, q.path || '.')
  UNION ALL SELECT q.principal_id, q.scope_id, unnest({_listed(S.EVERY_PERMISSION)}), FALSE FROM question q JOIN system_admins USING (principal_id)),
effective AS (SELECT a.principal_id, a.scope_id, coalesce(perms, []) AS perms FROM asked a
  LEFT JOIN (SELECT principal_id, scope_id, list_sort(list(DISTINCT p)) AS perms FROM each WHERE NOT upward OR ends_with(p, ':read') GROUP BY ALL) USING (principal_id, scope_id))"""
_WITH = f"WITH RECURSIVE {A.MEMBERSHIPS_SQL}, {A.OWNED_SCOPES_SQL}, {A.GRANTS_SQL}, {A.SYSTEM_ADMINS_SQL}, {A.ASKED_SCOPES_SQL}, {_EFFECTIVE}"


def _effective(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    return S.effective_permissions(asked, A.owned_scopes(spark, sf_dir), A.memberships(spark, sf_dir), A.grants(spark, sf_dir), A.system_admins(spark, sf_dir), A.now())


@query("effective_permissions", f"{_WITH} SELECT principal_id, scope_id, array_to_string(perms, ',') AS permissions FROM effective")
def effective_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every principal may do in the scopes it asks for."""
    return _effective(spark, sf_dir, A.asked_scopes(spark, sf_dir)).withColumn("permissions", F.array_join("permissions", ","))


_SHORT = "CASE n " + " ".join(f"WHEN '{o}' THEN {_listed([p for p in S.EVERY_PERMISSION if p.endswith(':' + o)])}" for o in ("read", "write", "edit", "delete")) + " ELSE [n] END"


@query("token_permissions", f"""{_WITH},
tokens AS (SELECT 't' || c_custkey AS token_id, 'c' || c_custkey AS principal_id, CASE c_custkey % 5 WHEN 0 THEN ['read'] WHEN 1 THEN ['memories:read', 'memories:write', 'skills:read'] WHEN 3 THEN ['write', 'graph:read'] END AS names,
  CASE WHEN c_custkey % 4 = 0 THEN 'n' || c_nationkey END AS bound FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0),
declared AS (SELECT token_id, principal_id, bound, flatten(list_transform(names, lambda n: {_SHORT})) AS d FROM tokens WHERE names IS NOT NULL),
fits AS (SELECT d.*, e.scope_id, e.perms FROM declared d JOIN effective e USING (principal_id) JOIN scopes s ON s.id = e.scope_id
  WHERE bound IS NULL OR EXISTS (SELECT 1 FROM scopes b WHERE b.id = bound AND (b.path = s.path OR starts_with(s.path, b.path || '.'))))
SELECT 't' || substr(a.principal_id, 2) AS token_id, a.scope_id, coalesce(array_to_string(list_sort(list_distinct(list_intersect(d, perms))), ','), '') AS permissions
FROM asked a LEFT JOIN fits f ON f.principal_id = a.principal_id AND f.scope_id = a.scope_id WHERE starts_with(a.principal_id, 'c')""")
def token_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every token may do in the scopes that its principal asks for."""
    pairs = A.asked_scopes(spark, sf_dir).where("principal_id LIKE 'c%'")
    tokens = A.tokens(spark, sf_dir)
    asked = pairs.join(tokens.select("token_id", "principal_id"), "principal_id").select("token_id", "scope_id")
    found = S.token_permissions(asked, tokens, _effective(spark, sf_dir, pairs), A.owned_scopes(spark, sf_dir), A.now())
    return found.withColumn("permissions", F.array_join("permissions", ","))


@query("promotion_paths", f"""{_WITH} SELECT principal_id, scope_id, CASE WHEN list_has_all(perms, ['memories:write', 'knowledge:write']) THEN 'direct' WHEN list_contains(perms, 'promotions:write') THEN 'review' END AS path,
  CASE WHEN list_has_all(perms, ['memories:write', 'knowledge:write']) THEN 1 WHEN list_contains(perms, 'promotions:write') THEN 3 END AS review_required FROM effective""")
def promotion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a principal may promote memories of a scope; null where it may not."""
    found = _effective(spark, sf_dir, A.asked_scopes(spark, sf_dir)).withColumn("access", S.promotion_access(F.col("permissions")))
    return found.select("principal_id", "scope_id", "access.path", "access.review_required")


@query("is_scope_admin", f"""WITH {A.MEMBERSHIPS_SQL}, {A.OWNED_SCOPES_SQL}, {A.SYSTEM_ADMINS_SQL}, {A.ASKED_SCOPES_SQL},
owners AS (SELECT a.principal_id, a.scope_id, u.principal_id AS owner FROM asked a JOIN scopes t ON t.id = a.scope_id JOIN scopes u ON u.path = t.path OR starts_with(t.path, u.path || '.'))
SELECT principal_id, scope_id, principal_id IN (SELECT principal_id FROM system_admins) OR EXISTS (SELECT 1 FROM owners o WHERE o.principal_id = a.principal_id AND o.scope_id = a.scope_id AND (o.owner = o.principal_id
  OR EXISTS (SELECT 1 FROM memberships m WHERE m.member_id = o.principal_id AND m.parent_id = o.owner AND m.role = 'admin'))) AS is_admin FROM asked a""")
def is_scope_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scope_admin(A.asked_scopes(spark, sf_dir), A.owned_scopes(spark, sf_dir), A.memberships(spark, sf_dir), A.system_admins(spark, sf_dir))


@query("is_principal_admin", f"""WITH RECURSIVE {A.MEMBERSHIPS_SQL}, {A.SYSTEM_ADMINS_SQL}, {A.ASKED_SCOPES_SQL}, up AS (SELECT DISTINCT scope_id AS target_id, scope_id AS id FROM asked
  UNION SELECT u.target_id, m.parent_id FROM up u JOIN memberships m ON m.member_id = u.id)
SELECT principal_id, scope_id AS target_id, principal_id IN (SELECT principal_id FROM system_admins) OR EXISTS (SELECT 1 FROM memberships m JOIN up ON up.id = m.parent_id
  WHERE m.member_id = a.principal_id AND up.target_id = a.scope_id AND m.role = 'admin') AS is_admin FROM asked a""")
def is_principal_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes here bear their owners' ids, so that the asked ones are principals as well."""
    asked = A.asked_scopes(spark, sf_dir).withColumnRenamed("scope_id", "target_id")
    return S.principal_admin(asked, A.memberships(spark, sf_dir), A.system_admins(spark, sf_dir))


@query("visible_scopes", f"""WITH {A.OWNED_SCOPES_SQL}, {A.ASKED_SCOPES_SQL}
SELECT a.principal_id, a.scope_id AS asked_scope, u.id AS scope_id FROM asked a JOIN scopes t ON t.id = a.scope_id JOIN scopes u ON (u.path = t.path OR starts_with(t.path, u.path || '.')) AND u.depth <= 2
UNION SELECT a.principal_id, a.scope_id, s.id FROM asked a JOIN scopes s ON s.principal_id = a.principal_id AND s.kind = 'user'""")
def visible_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of at most two path parts above the asked one, and the principal's own."""
    return S.visible_to_principal(A.owned_scopes(spark, sf_dir), A.asked_scopes(spark, sf_dir).withColumnRenamed("scope_id", "asked_scope"), max_depth=2)


@query("shared_memories", f"WITH {A.MEMORIES_SQL}, {A.GRANTS_SQL} SELECT id FROM memories WHERE is_active AND scope_id IN (SELECT scope_id FROM grants WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{A.NOW}')")
def shared_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = A.grants(spark, sf_dir).where(F.col("expires_at").isNull() | (F.col("expires_at") > A.now())).select("scope_id")
    return A.memories(spark, sf_dir).where("is_active").join(live, "scope_id", "left_semi").select("id")


@query("shared_artifacts", f"WITH {A.SCOPES_SQL}, {A.SHARING_SQL} SELECT DISTINCT id AS asked_scope, artifact_id FROM scopes JOIN sharing ON grantee_scope_id = id WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{A.NOW}'")
def shared_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shared with each scope itself."""
    return S.shared_with(A.scopes(spark, sf_dir).select(F.col("id").alias("asked_scope")), A.sharing(spark, sf_dir), A.now())


@query("promotion_access", f"""WITH {A.MEMBERSHIPS_SQL} SELECT member_id AS principal_id, parent_id AS scope_id, CASE WHEN role IN ('owner', 'admin') THEN 'direct' ELSE 'review' END AS access FROM memberships""")
def promotion_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    access = F.when(F.col("role").isin("owner", "admin"), "direct").otherwise("review")
    return A.memberships(spark, sf_dir).select(F.col("member_id").alias("principal_id"), F.col("parent_id").alias("scope_id"), access.alias("access"))
