"""Scope hierarchy and access control as joins.

Ancestors of a path are exploded and joined by equality, so that containment needs no theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import checkpointed

#: Fixed tables: the operations of every resource, and what each role adds to the one before it.
OPERATIONS = {
    "memories": ("read", "write", "edit", "delete"), "knowledge": ("read", "write", "edit", "delete"), "collections": ("read", "write", "edit", "delete"),
    "skills": ("read", "write", "edit", "delete"), "sessions": ("read", "write"), "graph": ("read",), "scopes": ("read", "write", "edit", "delete"),
    "principals": ("read", "write", "edit", "delete"), "tokens": ("read", "write", "edit", "delete"), "sharing": ("read", "write", "delete"),
    "promotions": ("read", "write", "edit", "delete"),
}
ROLE_ADDS = {
    "member": {
        "memories": ("read", "write"), "knowledge": ("read", "write"), "collections": ("read", "write"), "skills": ("read", "write"), "sessions": ("write",), "graph": ("read",),
        "scopes": ("read",), "principals": ("read",), "tokens": ("read",), "sharing": ("read",), "promotions": ("read", "write"),
    },
    "admin": {
        "memories": ("edit", "delete"), "knowledge": ("edit",), "collections": ("edit",), "skills": ("edit",), "scopes": ("write", "edit"), "principals": ("edit",),
        "tokens": ("edit",), "sharing": ("write",), "promotions": ("edit",),
    },
    "owner": {
        "knowledge": ("delete",), "collections": ("delete",), "skills": ("delete",), "scopes": ("delete",), "principals": ("delete",), "tokens": ("delete",), "sharing": ("delete",),
        "promotions": ("delete",),
    },
}
EVERY_PERMISSION = sorted(f"{r}:{o}" for r, ops in OPERATIONS.items() for o in ops)
ROLES: dict[str, list[str]] = {}
for _role, _adds in ROLE_ADDS.items():
    ROLES[_role] = sorted(set(ROLES[list(ROLES)[-1]] if ROLES else []) | {f"{r}:{o}" for r, ops in _adds.items() for o in ops})


def ancestor_paths(path: Column) -> Column:
    """All prefixes of a dotted path, itself included."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def is_within(path: Column, ancestor: Column) -> Column:
    return (path == ancestor) | path.startswith(F.concat(ancestor, F.lit(".")))


def ancestors(scopes: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance): every scope with each scope above it and itself."""
    up = scopes.select("id", "depth", F.explode(ancestor_paths(F.col("path"))).alias("path"))
    above = scopes.select(F.col("id").alias("ancestor_id"), F.col("depth").alias("above"), "path")
    return up.join(above, "path").select("id", "ancestor_id", (F.col("depth") - F.col("above")).alias("distance"))


def closure(edges: DataFrame, child: str = "member_id", parent: str = "parent_id", max_rounds: int = 40) -> DataFrame:
    """(child, ancestor): all that is reachable by one or more edges. Cycles end.

    Every round joins the relation with itself, so that paths double in length and the number of rounds grows with the logarithm
    of the longest one; a relation that does not settle in ``max_rounds`` rounds is an error, never a part of the answer.
    """
    known = checkpointed(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct())
    size = known.count()
    for _ in range(max_rounds):
        far = known.select("c", F.col("p").alias("mid")).join(known.select(F.col("c").alias("mid"), "p"), "mid").select("c", "p")
        known = checkpointed(known.unionByName(far).distinct())
        before, size = size, known.count()
        if size == before:
            return known.select(F.col("c").alias("principal_id"), F.col("p").alias("ancestor_id"))
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def role_permissions(role: Column) -> Column:
    """What a role allows; roles include those before them, and unknown ones allow nothing."""
    out = F.array().cast("array<string>")
    for name, names in ROLES.items():
        out = F.when(role == name, _texts(names)).otherwise(out)
    return out


def expand_permissions(names: Column) -> Column:
    """``read`` stands for reading every resource that can be read, and so on; full names stay, and names that no resource has go."""
    short = {o: [p for p in EVERY_PERMISSION if p.endswith(f":{o}")] for o in ("read", "write", "edit", "delete")}

    def one(n: Column) -> Column:
        out = F.array(n)
        for o, full in short.items():
            out = F.when(n == o, _texts(full)).otherwise(out)
        return out

    return F.array_intersect(F.array_distinct(F.flatten(F.transform(names, one))), _texts(EVERY_PERMISSION))


def _bits(names: list[str]) -> int:
    return sum(1 << EVERY_PERMISSION.index(n) for n in names)


#: What a short form or a permission stands for, as bits by the place of a permission in the sorted list of all.
_BITS = {p: 1 << k for k, p in enumerate(EVERY_PERMISSION)} | {o: _bits([p for p in EVERY_PERMISSION if p.endswith(f":{o}")]) for o in ("read", "write", "edit", "delete")}
EVERY_BIT, READ_BITS = _bits(EVERY_PERMISSION), _BITS["read"]


def permission_bits(names: Column) -> Column:
    """The bits of some names; short forms stand for several, and names that no resource has for none."""
    known = F.create_map(*[F.lit(x) for n, b in _BITS.items() for x in (n, b)])
    return F.aggregate(names, F.lit(0).cast("long"), lambda m, n: m.bitwiseOR(F.coalesce(F.try_element_at(known, n), F.lit(0).cast("long"))))


def role_bits(role: Column) -> Column:
    out = F.lit(0).cast("long")
    for name, names in ROLES.items():
        out = F.when(role == name, F.lit(_bits(names)).cast("long")).otherwise(out)
    return out


def permissions_of(bits: Column) -> Column:
    """The names of the set bits, sorted."""
    return F.filter(_texts(EVERY_PERMISSION), lambda _, k: F.getbit(bits, k) == 1)


def valid_permissions(names: Column) -> Column:
    """Whether a token may declare these names: some, none of them ``admin``, each a short form or a permission."""
    known = _texts(["read", "write", "edit", "delete", *EVERY_PERMISSION])
    return F.coalesce((F.size(names) > 0) & F.forall(names, lambda n: F.array_contains(known, n)), F.lit(False))


def membership_roles(memberships: DataFrame) -> DataFrame:
    """(principal_id, group_id, rank): the best role by which a principal belongs to a group, directly or through groups; 0 owner, 1 admin, 2 member."""
    rank = F.when(F.col("role") == "owner", 0).when(F.col("role") == "admin", 1).otherwise(2)
    direct = memberships.select(F.col("member_id").alias("principal_id"), F.col("parent_id").alias("group_id"), rank.alias("rank"))
    through = closure(memberships).select("principal_id", F.col("ancestor_id").alias("mid")).join(direct.select(F.col("principal_id").alias("mid"), "group_id", "rank"), "mid").select("principal_id", "group_id", "rank")
    return direct.unionByName(through).groupBy("principal_id", "group_id").agg(F.min("rank").alias("rank"))


def ancestry(memberships: DataFrame) -> DataFrame:
    """(principal_id, ancestor_id): every member and group with itself and all groups above it."""
    each = memberships.select(F.col("member_id").alias("p")).unionByName(memberships.select(F.col("parent_id").alias("p"))).distinct()
    return closure(memberships).unionByName(each.select(F.col("p").alias("principal_id"), F.col("p").alias("ancestor_id"))).distinct()


def held_permissions(scopes: DataFrame, memberships: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """(principal_id, at, bits): what a principal holds right at a scope, as ``permission_bits``: by owning it, by a role in its owner (its own or that of
    a group it belongs to), and by unexpired grants. ``scopes`` has ``principal_id``, the owner."""
    owned = scopes.where("principal_id is not null").select("principal_id", F.col("id").alias("at"), F.lit(_bits(ROLES["owner"])).cast("long").alias("bits"))
    roles = ancestry(memberships).join(memberships.select(F.col("member_id").alias("ancestor_id"), "parent_id", "role"), "ancestor_id").select("principal_id", "parent_id", "role").distinct()
    places = scopes.select(F.col("principal_id").alias("parent_id"), F.col("id").alias("at"))
    by_role = roles.join(places, "parent_id").select("principal_id", "at", role_bits(F.col("role")).alias("bits"))
    live = grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    granted = live.select("principal_id", F.col("scope_id").alias("at"), permission_bits(F.col("permissions")).alias("bits"))
    return owned.unionByName(by_role).unionByName(granted).groupBy("principal_id", "at").agg(F.bit_or("bits").alias("bits"))


def effective_permissions(asked: DataFrame, scopes: DataFrame, memberships: DataFrame, grants: DataFrame, system_admins: DataFrame, now: Column) -> DataFrame:
    """(principal_id, scope_id, permissions) for rows ``asked (principal_id, scope_id)``, sorted, empty where nothing is held.

    System administrators may do all. Others have what they hold at the scope and at those above it, and of what they hold at
    scopes below only the reading. Scopes that do not exist give empty sets; repeated questions are answered once.
    """
    asked = asked.select("principal_id", "scope_id").distinct()
    held = checkpointed(held_permissions(scopes, memberships, grants, now))
    up = ancestors(scopes)
    above = asked.join(up.select(F.col("id").alias("scope_id"), F.col("ancestor_id").alias("at")), "scope_id")
    down = above.join(held, ["principal_id", "at"]).select("principal_id", "scope_id", "bits")
    raised = held.join(up.where("distance > 0").select(F.col("id").alias("at"), F.col("ancestor_id").alias("scope_id")), "at")
    below = raised.join(asked, ["principal_id", "scope_id"]).select("principal_id", "scope_id", F.col("bits").bitwiseAND(F.lit(READ_BITS)).alias("bits"))
    admins = asked.join(system_admins.select("principal_id").distinct(), "principal_id", "left_semi").join(scopes.select(F.col("id").alias("scope_id")), "scope_id", "left_semi")
    every = down.unionByName(below).unionByName(admins.select("principal_id", "scope_id", F.lit(EVERY_BIT).cast("long").alias("bits")))
    found = every.groupBy("principal_id", "scope_id").agg(F.bit_or("bits").alias("bits")).select("principal_id", "scope_id", permissions_of(F.col("bits")).alias("permissions"))
    return asked.join(found, ["principal_id", "scope_id"], "left").select("principal_id", "scope_id", F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"))


def token_permissions(asked: DataFrame, tokens: DataFrame, effective: DataFrame, scopes: DataFrame, now: Column) -> DataFrame:
    """(token_id, scope_id, permissions) for rows ``asked (token_id, scope_id)``: what the token declares and its principal may do there.

    ``tokens``: (token_id, principal_id, permissions, scope_ids, revoked_at, expires_at); ``effective`` as above for its principals.
    Revoked and expired tokens, invalid declarations, and scopes not at or below one of ``scope_ids`` (if there are any) give empty sets.
    """
    good = tokens.where("revoked_at is null").where(F.col("expires_at").isNull() | (F.col("expires_at") >= now)).where(valid_permissions(F.col("permissions")))
    rows = asked.select("token_id", "scope_id").distinct().join(good.select("token_id", "principal_id", expand_permissions(F.col("permissions")).alias("declared"), "scope_ids"), "token_id")
    above = ancestors(scopes).groupBy(F.col("id").alias("scope_id")).agg(F.collect_set("ancestor_id").alias("above"))  # as many as the tree is deep
    fits = (F.coalesce(F.size("scope_ids"), F.lit(0)) <= 0) | F.arrays_overlap("above", F.coalesce("scope_ids", F.array().cast("array<string>")))
    may = rows.join(above, "scope_id").where(fits).join(effective, ["principal_id", "scope_id"])
    found = may.select("token_id", "scope_id", F.array_sort(F.array_intersect("declared", "permissions")).alias("permissions"))
    none = F.array().cast("array<string>")
    return asked.select("token_id", "scope_id").distinct().join(found, ["token_id", "scope_id"], "left").select("token_id", "scope_id", F.coalesce("permissions", none).alias("permissions"))


def promotion_access(permissions: Column) -> Column:
    """``direct`` with one review, ``review`` with three, or null where neither way is open."""
    direct = F.array_contains(permissions, "memories:write") & F.array_contains(permissions, "knowledge:write")
    return F.when(direct, F.struct(F.lit("direct").alias("path"), F.lit(1).alias("review_required"))).when(
        F.array_contains(permissions, "promotions:write"), F.struct(F.lit("review").alias("path"), F.lit(3).alias("review_required"))
    )


def scope_admin(asked: DataFrame, scopes: DataFrame, memberships: DataFrame, system_admins: DataFrame) -> DataFrame:
    """(principal_id, scope_id, is_admin) for ``asked (principal_id, scope_id)``: system administrators, owners of the scope or one above it, and admins of such an owner."""
    asked = asked.select("principal_id", "scope_id").distinct()
    above = asked.join(ancestors(scopes).select(F.col("id").alias("scope_id"), F.col("ancestor_id").alias("at")), "scope_id")
    owners = above.join(scopes.select(F.col("id").alias("at"), F.col("principal_id").alias("owner")), "at")
    admins = memberships.where("role = 'admin'").select(F.col("member_id").alias("principal_id"), F.col("parent_id").alias("owner"))
    yes = owners.where("owner = principal_id").select("principal_id", "scope_id").unionByName(owners.join(admins, ["principal_id", "owner"]).select("principal_id", "scope_id"))
    yes = yes.unionByName(asked.join(system_admins.select("principal_id"), "principal_id", "left_semi").select("principal_id", "scope_id")).distinct()
    return asked.join(yes.withColumn("is_admin", F.lit(True)), ["principal_id", "scope_id"], "left").withColumn("is_admin", F.coalesce("is_admin", F.lit(False)))


def principal_admin(asked: DataFrame, memberships: DataFrame, system_admins: DataFrame) -> DataFrame:
    """(principal_id, target_id, is_admin) for ``asked (principal_id, target_id)``: system administrators, and admins of the target or of a group above it."""
    asked = asked.select("principal_id", "target_id").distinct()
    up = ancestry(memberships).select(F.col("principal_id").alias("target_id"), F.col("ancestor_id").alias("group_id"))
    admins = memberships.where("role = 'admin'").select(F.col("member_id").alias("principal_id"), F.col("parent_id").alias("group_id"))
    yes = asked.join(up, "target_id").join(admins, ["principal_id", "group_id"]).select("principal_id", "target_id")
    yes = yes.unionByName(asked.join(system_admins.select("principal_id"), "principal_id", "left_semi").select("principal_id", "target_id")).distinct()
    return asked.join(yes.withColumn("is_admin", F.lit(True)), ["principal_id", "target_id"], "left").withColumn("is_admin", F.coalesce("is_admin", F.lit(False)))


def visible_to_principal(scopes: DataFrame, asked: DataFrame, max_depth: int = 0) -> DataFrame:
    """(principal_id, asked_scope, scope_id) from ``asked (principal_id, asked_scope)``: the scope and those above it whose path has at most
    ``max_depth`` parts (0: all), and the principal's own user scopes, each once."""
    up = ancestors(scopes).join(scopes.select(F.col("id").alias("ancestor_id"), F.col("depth").alias("above")), "ancestor_id")
    up = up if not max_depth else up.where(F.col("above") <= max_depth)
    shared = asked.join(up.select(F.col("id").alias("asked_scope"), F.col("ancestor_id").alias("scope_id")), "asked_scope").select("principal_id", "asked_scope", "scope_id")
    own = asked.join(scopes.where("kind = 'user'").select("principal_id", F.col("id").alias("scope_id")), "principal_id").select("principal_id", "asked_scope", "scope_id")
    return shared.unionByName(own).distinct()


def fan_out(scopes: DataFrame, asked: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(query_id, scope_id): from (query_id, scope_id) to the scope and all above it, at most ``max_depth`` steps up."""
    up = ancestors(scopes)
    up = up if max_depth is None else up.where(F.col("distance") <= max_depth)
    return asked.join(up.withColumnRenamed("id", "scope_id"), "scope_id").select("query_id", F.col("ancestor_id").alias("scope_id")).distinct()


def newest_versions(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Upsert: of the rows of a key the one with the largest ``order``, then ``tie``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie)))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def shared_with(asked: DataFrame, shared: DataFrame, now: Column) -> DataFrame:
    """(asked_scope, artifact_id): what is shared with exactly the scopes of ``asked (asked_scope)`` and not expired."""
    live = shared.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return asked.join(live.select(F.col("grantee_scope_id").alias("asked_scope"), "artifact_id"), "asked_scope").distinct()


def visible(artifacts: DataFrame, scopes: DataFrame, asked: DataFrame, shared: DataFrame, now: Column) -> DataFrame:
    """(asked_scope, columns of ``artifacts``) for every scope of ``asked (asked_scope)``: what it may see.

    That is its own project artifacts, team and department ones of it and the scopes above it, company ones whose owner is a
    company scope, and those with an unexpired grant in ``shared (artifact_id, grantee_scope_id, expires_at)`` to it or a scope above it.
    """
    up = asked.join(ancestors(scopes).select(F.col("id").alias("asked_scope"), F.col("ancestor_id").alias("at"), "distance"), "asked_scope")
    near = F.when(F.col("visibility") == "project", F.col("distance") == 0).otherwise(F.col("visibility").isin("team", "department"))
    by_owner = artifacts.select("id", "visibility", F.col("owner_scope_id").alias("at")).join(up, "at").where(near).select("asked_scope", "id")
    companies = scopes.where("kind = 'company'").select(F.col("id").alias("owner_scope_id"))
    company = artifacts.where("visibility = 'company'").join(companies, "owner_scope_id", "left_semi").select("id")
    live = shared.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.col("artifact_id").alias("id"), F.col("grantee_scope_id").alias("at"))
    granted = live.join(up, "at").select("asked_scope", "id")
    # every asked scope sees every company artifact: the answer itself is as large
    everyone = company.join(asked.select("asked_scope").distinct())
    found = by_owner.unionByName(granted).unionByName(everyone.select("asked_scope", "id")).distinct()
    return found.join(artifacts, "id")
