import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graph as G
from mnemospark.plans import QUERIES

NAMES = ["pkg.Func", "a.pkg.Func", "Func", "mod::Func", "x#Func", "a::b::c", "a.b#c", "c", "odd:Func", "", "::", "very.long.name.of.pkg.Func", "pkgXFunc"]


@pytest.fixture(scope="module")
def entities(spark):
    kinds = ["function", "package", "variable", "class"]
    return spark.createDataFrame([(k, kinds[k % 4], n) for k, n in enumerate(NAMES)], "entity_id long, entity_type string, canonical string").cache()


def brute(name, limit):
    ends = [(len(c), k) for k, c in enumerate(NAMES) if c == name or any(c.endswith(s + name) for s in (".", "::", "#"))]
    return [k for _, k in sorted(ends)[:limit]] if name else []


def test_suffixes_of_several_parts_are_found_as_by_their_definition(spark, entities):
    names = ["Func", "pkg.Func", "c", "b::c", "b#c", "Xfunc", "", ":", "of.pkg.Func", "nope"]
    got = G.by_suffix(entities, spark.createDataFrame([(n,) for n in names + names], "name string"), 3).collect()
    for n in names:
        assert [r.entity_id for r in sorted((r for r in got if r.name == n), key=lambda r: r.place)] == brute(n, 3), n


def test_exact_names_go_before_suffixes_and_by_kind(spark, entities):
    more = entities.unionByName(spark.createDataFrame([(50, "variable", "dup"), (51, "function", "dup"), (52, "other", "dup"), (53, "other", "only.other")], entities.schema))
    got = {r.name: r.entity_id for r in G.resolve_symbols(more, spark.createDataFrame([(n,) for n in ("dup", "Func", "pkg.Func", "other", "none")], "name string")).collect()}
    assert got == {"dup": 51, "Func": 2, "pkg.Func": 0, "other": 53}


def test_targets_are_resolved_in_stages(spark, entities):
    asked = spark.createDataFrame([("f", "Func"), ("f", "own"), ("g", "Func"), ("h", "Func"), ("h", "b::c"), ("h", "nothing")], "file string, name string")
    local = spark.createDataFrame([("f", "own", 99), ("f", "Func", 98)], "file string, name string, entity_id long")
    imports = spark.createDataFrame([("g", "a.pkg", "pkg"), ("g", "zzz", "very.long.name.of.pkg"), ("h", "none", "none")], "file string, canonical string, name string")
    got = {(r.file, r.name): (r.entity_id, r.stage) for r in G.resolve_targets(asked, local, imports, entities).collect()}
    # a.pkg.Func is a package (no code), so that the plain name of the same import finds pkg.Func
    assert got == {("f", "Func"): (98, 1), ("f", "own"): (99, 1), ("g", "Func"): (0, 2), ("h", "Func"): (2, 4), ("h", "b::c"): (5, 4)}


def test_names_meet_packages_without_a_shuffle_of_their_pairs(spark, monkeypatch):
    n = 500
    asked = spark.range(n).selectExpr("'f' AS file", "concat('name', id) AS name")
    imports = spark.range(n).selectExpr("'f' AS file", "concat('a.pkg', id) AS canonical", "concat('pkg', id) AS name")
    every = [(f"a.pkg{i}.name{i}", f"pkg{i}.name{i + 1}", f"a.pkg{i}::name{i + 2}", f".name{i}.") for i in range(n)]
    entities = spark.createDataFrame([(10 * i + k, "class", c) for i, cs in enumerate(every) for k, c in enumerate(cs)], "entity_id long, entity_type string, canonical string")
    status = spark.sparkContext._jsc.sc()
    written = lambda: (status.listenerBus().waitUntilEmpty(), status.statusStore().executorList(False).apply(0).totalShuffleWrite())[1]
    resolve = lambda: {r.name: (r.entity_id, r.stage) for r in G.resolve_targets(asked, asked.selectExpr("file", "name", "1L AS entity_id").limit(0), imports, entities).collect()}
    # a.pkg{k} bears name{k} by its canonical name, pkg{k - 1} by the plain one; the smaller canonical name goes first
    want = {f"name{k}": (10 * k if not k or f"a.pkg{k}" < f"a.pkg{k - 1}" else 10 * (k - 1) + 1, 2) for k in range(n)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = written()
        assert resolve() == want
        assert written() - before < 1_000_000
        monkeypatch.setattr(G, "MAX_BROADCAST_NAMES", 0)
        assert resolve() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", [1, 2, 500])
def test_same_as_pairs_every_other_type_of_a_name(spark, monkeypatch, block):
    monkeypatch.setattr(G, "SAME_AS_BLOCK", block)
    monkeypatch.setattr(G, "SAME_AS_EDGES", 3)
    rows = [(i * 7 % 23, "ab"[i % 2], "xyz"[i * i % 3]) for i in range(20)] + [(3, "a", "x"), (3, "a", "x"), (3, "a", "y"), (None, "a", "x"), (90, None, "x"), (91, "a", None), (92, "alone", "x"), (93, "", "x"), (94, "", "")]
    want = sorted((i, j) for i, c, t in rows for j, d, u in rows if None not in (i, c, t, j, d, u) and c == d and t != u and i < j)
    e = spark.createDataFrame(rows, "id long, canonical string, t string")
    assert sorted((r.subject_id, r.object_id) for r in G.same_as(e).collect()) == want
    assert G.same_as(e.limit(0)).collect() == []


def test_edges_of_one_name_are_made_by_several_tasks(spark, tmp_path):
    spark.range(4000).selectExpr("id AS p_partkey", "'Red Bolt' AS p_name", "concat('t', id % 4) AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = QUERIES["same_as_edges"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in made) == 6_000_000 and max(r["count"] for r in made) < 5_000_000


EDGES = [("s", "a", "calls", "b"), ("s", "b", "calls", "c"), ("s", "c", "uses", "a"), ("s", "a", "calls", "a"), ("s", "d", "calls", "b"), ("t", "a", "calls", "b")]


def paths(start, hops):
    """Paths by definition: (nodes and steps, relations used)."""
    found = [((n,), ()) for n in start]
    for predicates, direction, ends in hops:
        new = []
        for path, used in found:
            for e in EDGES:
                for d, x, y in (("out", e[1], e[3]), ("in", e[3], e[1])):
                    loop = direction == "both" and d == "in" and x == y
                    if direction in (d, "both") and not loop and x == path[-1] and e not in used and (not predicates or e[2] in predicates) and (ends is None or y in ends):
                        new.append(((*path, e[2], d, y), (*used, e)))
        found = new
    return sorted(p for p, _ in found)


@pytest.mark.parametrize("hops", [[], [((), "out", None)], [(("calls",), "both", None)], [(("calls",), "out", "b"), ((), "in", None)], [((), "both", None), (("uses", "calls"), "both", "abc")], [(("none",), "out", None)]])
def test_paths_equal_their_definition(spark, hops):
    nodes = spark.createDataFrame([(n, "s" if n in "ab" else "t", n) for n in "abcd"], "entity_id string, scope_id string, name string")
    edges = spark.createDataFrame(EDGES, "scope_id string, subject_id string, predicate string, object_id string")
    asked = [G.Hop(p, d, None if e is None else F.col("name").isin(*e)) for p, d, e in hops]
    assert sorted(tuple(r) for r in G.match_paths(nodes, edges, "s", None, asked).collect()) == paths("ab", hops)
    assert sorted(tuple(r) for r in G.match_paths(nodes, edges, "s", F.col("name") == "b", asked).collect()) == paths("b", hops)


def test_a_direction_that_is_not_known_is_an_error(spark, entities):
    with pytest.raises(ValueError, match="sideways"):
        G.match_paths(entities, entities, "s", None, [G.Hop((), "sideways")])
