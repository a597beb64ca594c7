import random

from mnemospark.operators.codeindex import update_index
from mnemospark.sources.ingest import changed_files
from mnemospark.sources.tree import tree_diff, tree_nodes

FILES = "path string, content string"
FIRST = [("a/x.go", "package x\nimport \"fmt\"\n\nfunc A() {\n\tfmt.Println(B())\n}\ntype T struct {\n\tn int\n}\n"), ("b.ts", "class C { run() { go(); } }"), ("doc.md", "# func no() {}"), ("big.go", "package big // " + "x" * 600_000), ("e.go", None)]


def test_an_index_is_written_and_not_again(spark):
    none = spark.createDataFrame([], "path string, digest string")
    one = update_index(spark.createDataFrame(FIRST, FILES), none)
    memories = {r.source_ref: (r.parent_ref, r.content) for r in one.memories.collect()}
    assert memories["file:a/x.go"] == (None, FIRST[0][1]) and memories["file:a/x.go:4"] == ("file:a/x.go", "func A() {\n\tfmt.Println(B())\n}")
    assert set(memories) == {"file:a/x.go", "file:a/x.go:4", "file:a/x.go:7", "file:b.ts", "file:b.ts:1", "file:e.go"} or {"file:a/x.go:4", "file:a/x.go:7", "file:b.ts:1"} <= set(memories)
    assert ("a/x.go", "x.A", "calls", "Println") in {tuple(r) for r in one.relations.collect()}
    assert ("a/x.go", "struct", "x.T") in {tuple(r) for r in one.entities.collect()}
    assert "big.go" not in {r.path for r in one.digests.collect()} and one.replaced.count() == 0
    again = update_index(spark.createDataFrame(FIRST, FILES), one.digests)
    assert [d.count() for d in (again.replaced, again.digests, again.entities, again.relations, again.memories)] == [0] * 5


def test_changed_and_gone_files_are_replaced(spark):
    none = spark.createDataFrame([], "path string, digest string")
    one = update_index(spark.createDataFrame(FIRST, FILES), none)
    second = [(FIRST[0][0], FIRST[0][1].replace("A()", "Z()")), FIRST[2], ("new.rs", "fn f() { g() }")]
    two = update_index(spark.createDataFrame(second, FILES), one.digests)
    assert {r.path for r in two.replaced.collect()} == {"a/x.go", "b.ts", "e.go"}
    fresh = update_index(spark.createDataFrame(second, FILES), none)
    for name in ("entities", "relations", "memories", "digests"):
        kept = two.applied(getattr(one, name), getattr(two, name))
        assert sorted(map(str, kept.collect())) == sorted(map(str, getattr(fresh, name).collect())), name


def listing(seed, n=400):
    r = random.Random(seed)
    return {"/".join(r.choice("abcd") for _ in range(r.randint(1, 5))) + f"/f{r.randrange(9)}": r.randrange(5) for _ in range(n)}


def test_tree_diff_equals_the_flat_one(spark):
    old = listing(1)
    r = random.Random(2)
    new = {p: (d + 1 if r.random() < 0.05 else d) for p, d in old.items() if r.random() > 0.05} | {"a/b/new": 1, "zz/y/x": 2, "top": 3}
    frames = [spark.createDataFrame([(p, str(d)) for p, d in t.items()], "path string, content string") for t in (old, new)]
    found, _ = tree_diff(*[tree_nodes(f.withColumnRenamed("content", "digest")) for f in frames])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, changed_files(*frames).collect()))


def test_equal_subtrees_are_not_opened(spark):
    old = {f"d{i % 50}/e{i % 7}/f{i}": "1" for i in range(3000)}
    new = old | {"d3/e1/f1303": "2"}
    trees = [tree_nodes(spark.createDataFrame(list(t.items()), "path string, digest string")) for t in (old, new)]
    found, seen = tree_diff(*trees)
    assert [tuple(r) for r in found.collect()] == [("d3/e1/f1303", "modify" if "d3/e1/f1303" in old else "insert")]
    assert seen < 200
    same, seen = tree_diff(trees[0], trees[0])
    assert same.count() == 0 and seen == 1


def test_files_that_become_folders_and_empty_listings(spark):
    tree = lambda rows: tree_nodes(spark.createDataFrame(rows, "path string, digest string"))
    found, _ = tree_diff(tree([("a", "1"), ("b/c", "2"), (None, "3")]), tree([("/a/x", "1"), ("b", "2")]))
    assert sorted(map(tuple, found.collect())) == [("a", "delete"), ("a/x", "insert"), ("b", "insert"), ("b/c", "delete")]
    found, _ = tree_diff(tree([]), tree([("a/b", None)]))
    assert [tuple(r) for r in found.collect()] == [("a/b", "insert")]
    assert tree_diff(tree([]), tree([]))[0].count() == 0
