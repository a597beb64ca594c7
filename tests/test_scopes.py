from mnemospark import adapters as A
from mnemospark.operators import scoping as S
from mnemospark.plans import QUERIES
from pyspark.sql import functions as F
from test_registry import SF_DIR


def brute(asked, scopes, memberships, grants, admins):
    """(principal, scope) -> permissions, by walking every principal's groups and every scope's path."""
    parents, path, owner, by_owner, held = {}, {}, {}, {}, {}
    for m in memberships:
        parents.setdefault(m.member_id, []).append((m.parent_id, m.role))
    for s in scopes:
        path[s.id], owner[s.id] = s.path, s.principal_id
        by_owner.setdefault(s.principal_id, []).append(s.id)
    for g in grants:
        held.setdefault(g.principal_id, []).append((g.scope_id, set(g.permissions)))
    for p in {q.principal_id for q in asked}:
        mine = held.setdefault(p, [])
        mine += [(s, set(S.ROLES["owner"])) for s in by_owner.get(p, [])]
        walk, seen = [p], {p}
        while walk:
            for group, role in parents.get(walk.pop(), []):
                mine += [(s, set(S.ROLES[role])) for s in by_owner.get(group, [])]
                if group not in seen:
                    seen.add(group)
                    walk.append(group)
    out = {}
    for q in asked:
        got = set()
        if q.scope_id in path:
            here = path[q.scope_id]
            if q.principal_id in admins:
                got |= set(S.EVERY_PERMISSION)
            for at, perms in held[q.principal_id]:
                if here == path[at] or here.startswith(path[at] + "."):
                    got |= perms
                elif path[at].startswith(here + "."):
                    got |= {p for p in perms if p.endswith(":read")}
        out[q.principal_id, q.scope_id] = ",".join(sorted(got))
    return out


def test_permissions_of_every_principal(spark):
    live = A.grants(spark, SF_DIR).where(F.col("expires_at").isNull() | (F.col("expires_at") > A.now()))
    asked, members = A.asked_scopes(spark, SF_DIR).collect(), A.memberships(spark, SF_DIR).collect()
    want = brute(asked, A.owned_scopes(spark, SF_DIR).collect(), members, live.collect(), {"r0"})
    got = {(r.principal_id, r.scope_id): r.permissions for r in QUERIES["effective_permissions"](spark, SF_DIR).collect()}
    assert got == want
    assert {p for p, _ in got} >= {m.member_id for m in members}


def test_upward_reading_ownership_and_administrators(spark):
    scopes = spark.createDataFrame([("a", "a", 1, "A"), ("b", "a.b", 2, "B"), ("c", "a.b.c", 3, "C"), ("x", "x", 1, None)], "id string, path string, depth int, principal_id string")
    members = spark.createDataFrame([("u", "B", "member"), ("C", "u", "admin"), ("u", "C", "owner")], "member_id string, parent_id string, role string")
    grants = spark.createDataFrame([("g", "c", ["skills:edit", "skills:read", "nonsense:read"], None), ("g", "x", ["read"], A.NOW)], "principal_id string, scope_id string, permissions array<string>, expires_at string")
    asked = spark.createDataFrame([(p, s) for p in "BuCgz" for s in "abcxy"] + [("u", "a")], "principal_id string, scope_id string")
    admins = spark.createDataFrame([("z",)], "principal_id string")
    got = {(r.principal_id, r.scope_id): r.permissions for r in S.effective_permissions(asked, scopes, members, grants.withColumn("expires_at", F.col("expires_at").cast("timestamp")), admins, A.now()).collect()}
    reads = lambda role: [p for p in S.ROLES[role] if p.endswith(":read")]
    assert len(got) == 25
    assert got["B", "b"] == got["B", "c"] == S.ROLES["owner"] and got["B", "a"] == reads("owner") and got["B", "x"] == []
    assert got["u", "b"] == sorted({*S.ROLES["member"], *reads("owner")}) and got["u", "c"] == S.ROLES["owner"] and got["u", "a"] == reads("owner")
    assert got["g", "c"] == ["skills:edit", "skills:read"] and got["g", "a"] == got["g", "b"] == ["skills:read"] and got["g", "x"] == []
    assert got["z", "x"] == S.EVERY_PERMISSION and got["z", "y"] == []


def test_closure_of_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100)]
    got = {(r.principal_id, r.ancestor_id) for r in S.closure(spark.createDataFrame(chain, "member_id int, parent_id int")).collect()}
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 51)} | {(i, j) for i in (100, 101, 102) for j in (100, 101, 102)}


def test_token_declarations(spark):
    names = [["read"], ["admin"], [], None, ["graph:write"], ["sharing:delete", "edit"]]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n array<string>").select("i", S.valid_permissions(F.col("n")).alias("ok"), S.expand_permissions(F.col("n")).alias("all")).orderBy("i").collect()
    assert [r.ok for r in rows] == [True, False, False, False, False, True]
    assert set(rows[0]["all"]) == {p for p in S.EVERY_PERMISSION if p.endswith(":read")} and "graph:edit" not in rows[5]["all"]
