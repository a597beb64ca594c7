import ast
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import code as C
from mnemospark.functions import text as T
from mnemospark.functions.embed import embed, fnv1a, hashed_vector
from mnemospark.functions.vector import cosine_distance, cosine_similarity, fit_dimensions
from mnemospark.operators import components, dedup, graph, lifecycle, recall, scoping, storage
from mnemospark.sources.ingest import changed_files, extract_text, read_files
from mnemospark.streaming import events as E


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def floats(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_cosine(spark):
    assert value(spark, cosine_similarity(floats(1, 2), floats(1, 2))) == pytest.approx(1)
    assert value(spark, cosine_similarity(floats(1, 0), floats(0, 1))) == 0
    assert value(spark, cosine_similarity(floats(0, 0), floats(1, 1))) == 0
    assert value(spark, cosine_similarity(floats(1, 2, 9), floats(1, 2))) == pytest.approx(1)
    assert value(spark, cosine_similarity(F.lit(None).cast("array<double>"), floats(1))) == 0
    assert value(spark, cosine_distance(floats(0, 0), floats(1, 1))) == 2
    assert value(spark, fit_dimensions(floats(1, 2, 3), 2)) == [1, 2]
    assert value(spark, fit_dimensions(floats(1), 3)) == [1, 0, 0]


def test_chunks():
    assert T.chunk_text("") == [] and T.chunk_text(None) == []
    assert T.chunk_text("x" * 1000) == ["x" * 1000]
    parts = T.chunk_text("x" * 2500)
    assert "".join(parts) == "x" * 2500 and max(map(len, parts)) <= 1000
    text = " ".join(f"Sentence number {i} is here." for i in range(100))
    parts = T.chunk_text(text, 300, 2)
    assert all(len(p) <= 300 for p in parts)
    assert parts[1].startswith(" ".join(parts[0].split(". ")[-2:]).split(".")[0][:8])
    assert T.chunk_text("a b. " * 300, 100, 0)[0].endswith(".")
    assert "héé" in T.chunk_text("héé. " * 400, 50, 0)[0]


def test_text_columns(spark):
    assert value(spark, T.content_kind(F.lit("x"), F.lit("file:src/a.go:3"))) == "code"
    assert value(spark, T.content_kind(F.lit("{}\n{}\n"), F.lit("file:a.md"))) == "text"
    assert value(spark, T.content_kind(F.lit("def f():\n    return {}\nplain"), F.lit(None).cast("string"))) == "code"
    assert value(spark, T.content_kind(F.lit(""), F.lit(""))) == "text"
    found = value(spark, T.entity_mentions(F.lit("see file:src/auth.go:42, pr:123 by @first.last on HttpServer and HTTP"), F.lit("pr:9")))
    assert [(e.type, e.canonical) for e in found] == [("file", "src/auth.go"), ("pr", "pr:9"), ("pr", "pr:123"), ("person", "first.last"), ("concept", "httpserver")]
    many = " ".join(f"Ab{chr(97 + i)}Cd{chr(97 + i)}" for i in range(15))
    assert len(value(spark, T.entity_mentions(F.lit(many), F.lit("")))) == 10
    assert value(spark, T.summarise(F.lit("One two. Three four five"), 4)) == "One two."
    assert value(spark, T.summarise(F.lit("one two three"), 2)) == "one two"
    assert value(spark, T.summarise(F.lit(""), 2)) == ""
    assert value(spark, T.lead(F.lit("Short. More"))) == "Short."
    assert value(spark, T.lead(F.lit("x" * 200), 10)) == "x" * 10 + "…"
    assert value(spark, T.slug(F.lit("  My Skill: v2!! "))) == "my-skill-v2"
    assert value(spark, T.source_path(F.lit("file:a/b.py:12"))) == "a/b.py"
    assert sorted(value(spark, T.trigrams(F.lit("Cat")))) == ["  c", " ca", "at ", "cat"]
    assert value(spark, T.jaccard(T.trigrams(F.lit("")), T.trigrams(F.lit("")))) == 0


def test_stemmer_and_cover_density(spark):
    assert T.stem("decisions") == T.stem("decision")
    assert T.stem("running") == "run"
    places = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(t).alias("term")) for a, t in ((0, 0), (3, 1), (4, 0), (9, 1))])
    assert value(spark, T.cover_density(places, 2)) == pytest.approx(1 / 4 + 1 / 2 + 1 / 6)
    assert spark.createDataFrame([("Thé Onions",)], "t string").select(T.english_terms("t")).head()[0][1] == T.stem("onions")


def test_intent_and_decay(spark):
    assert value(spark, recall.intent_boost(F.lit("decision"), "Why this?")) == pytest.approx(0.08)
    assert value(spark, recall.intent_boost(F.lit("spec"), "show me")) == 0
    assert value(spark, recall.intent_boost(F.lit("meeting"), "what about last week")) == pytest.approx(0.08)
    assert value(spark, recall.half_life(F.lit("meeting"))) < value(spark, recall.half_life(F.lit("decision")))


def test_paths(spark):
    assert value(spark, scoping.ancestor_paths(F.lit("a.b.c"))) == ["a", "a.b", "a.b.c"]
    assert value(spark, scoping.is_within(F.lit("ab"), F.lit("a"))) is False
    assert value(spark, scoping.is_within(F.lit("a.b"), F.lit("a"))) is True


def test_closure_with_diamond_and_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "member_id string, parent_id string")
    got = {tuple(r) for r in scoping.closure(edges).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 50), (60, 60), (None, 1)], "src long, dst long")
    got = dict(map(tuple, components.connected_components(edges).collect()))
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_near_pairs_in_tiles(spark):
    rows = [(i, i % 2, [float(i % 3 == 0), 1.0, float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, vec array<double>")
    assert dedup.near_pairs(df, 0.0001, ["g"]).count() == sum(1 for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (a[2] == b[2]))


def test_graph(spark):
    rel = spark.createDataFrame([("hub", "calls", "x", 1.0), ("a", "calls", "hub", 0.5), ("f", "imports", "hub", 0.9), ("hub", "calls", "hub", 0.2)], "subject_id string, predicate string, object_id string, confidence double")
    hub = spark.createDataFrame([("hub",)], "entity_id string")
    assert graph.neighbours(rel, hub).count() == 5
    assert {r.neighbour_id for r in graph.neighbours(rel, hub, ["calls"], "in").collect()} == {"a", "hub"}
    ranks = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["b"] > ranks["a"] == pytest.approx(ranks["c"])


def test_lifecycle(spark):
    log = [(1, 1, "submit", "u"), (1, 2, "endorse", "a"), (1, 3, "endorse", "a"), (1, 4, "endorse", "b"), (1, 5, "submit", "u"), (2, 1, "endorse", "a"), (3, 1, "submit", "u"), (3, 2, "endorse", "a"), (3, 3, "retract", "u")]
    got = {r.k: (r.status, r.endorsements) for r in lifecycle.replay(spark.createDataFrame(log, "k int, at int, action string, actor string"), "k", ["at"]).collect()}
    assert got == {1: ("published", 2), 2: ("draft", 0), 3: ("draft", 0)}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert storage.latest_snapshot(spark, root) is None
    assert storage.write_snapshot(spark.createDataFrame([(1, "a")], "k int, v string"), root) == 1
    now = storage.upsert(storage.read_snapshot(spark, root), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])
    assert storage.write_snapshot(now, root) == 2
    assert {tuple(r) for r in storage.read_snapshot(spark, root).collect()} == {(1, "b"), (2, "c")}
    assert {tuple(r) for r in storage.read_snapshot(spark, root, 1).collect()} == {(1, "a")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Hi </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p></w:document>')
    (tmp_path / "b.docx").write_bytes(buffer.getvalue())
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.status) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("héllo", "ok"), "b.docx": ("Hi there", "ok"), "c.bin": (None, "unsupported format")}
    assert extract_text("x.docx", b"junk")[0] is None
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    after = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content string")
    assert {tuple(r) for r in changed_files(before, after).collect()} == {("b", "modify"), ("c", "delete"), ("d", "insert")}


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "x" * 40000), (5, "a")], "id long, content string")
    got = {r.id: r for r in embed(rows, lambda ts: [hashed_vector(t) for t in ts]).collect()}
    assert [got[i].status for i in (1, 2, 3, 4, 5)] == ["ready", "failed", "failed", "failed", "ready"]
    assert got[1].vec == got[5].vec


def test_code_symbols(spark):
    source = "import os\nfrom a.b import c\n@deco\nclass K(Base):\n    @property\n    def m(self):\n        return c(os.getcwd())\n"
    ast.parse(source)
    rows = {(r.kind, r["name"], r.predicate, r.target) for r in C.python_symbols(spark.createDataFrame([("x/mod.py", source), ("y.py", "def (")], "path string, content string")).collect()}
    assert {("class", "mod.K", "extends", "Base"), ("method", "mod.K.m", "defines", "m"), ("call", "mod.K.m", "calls", "getcwd"), ("module", "mod", "imports", "a.b")} <= rows
    files = [("q.sql", "CREATE TABLE IF NOT EXISTS a.b (x int);"), ("d/Dockerfile", "FROM base:1 AS build\n"), ("m.rs", "use std::io;\npub fn go() {}\ntrait T {}"), ("s.ts", "import {a} from './a'\nconst f = (x) => x\nclass Q extends R {}")]
    found = {(r.path, r.kind, r.predicate, r.target) for r in C.symbols_by_pattern(spark.createDataFrame(files, "path string, content string")).collect()}
    assert {("q.sql", "struct", "defines", "a.b"), ("d/Dockerfile", "file", "imports", "base:1"), ("m.rs", "function", "defines", "go"), ("m.rs", "interface", "defines", "T"), ("s.ts", "class", "extends", "R"), ("s.ts", "file", "imports", "./a")} <= found


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:00:00", i % 2, "click", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), df.schema)
    E.run_to_end(E.tumbling(stream, "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3  # later windows stay open
    E.run_to_end(E.fresh_snapshots(E.event_stream(spark, str(tmp_path / "in"), df.schema), ["user_id"], "1 day"), str(tmp_path / "once"), str(tmp_path / "s2"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2


def test_hashed_vectors_are_those_of_the_published_generators():
    assert [fnv1a(b) for b in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert hashed_vector("x") == hashed_vector("x") != hashed_vector("y")
    assert abs(sum(v * v for v in hashed_vector("é𝄞", 64)) - 1) < 1e-5
    assert hashed_vector(None) == hashed_vector("")


def test_blocks_that_do_not_fit_are_left_out_or_stand_as_stubs(spark):
    rows = spark.createDataFrame([(1, 50, 5), (2, 80, 8), (3, 30, 3), (4, 20, 2), (5, 1, 1)], "id int, tokens long, stub_tokens long")
    got = [(r.id, r.tokens, r.running, r.taken) for r in recall.pack(rows.drop("stub_tokens"), 100, ["id"], ["id"]).orderBy("place").collect()]
    assert got == [(1, 50, 50, True), (2, 0, 50, False), (3, 30, 80, True), (4, 20, 100, True), (5, 0, 100, False)]
    got = [(r.id, r.tokens, r.running, r.stubbed) for r in recall.pack_with_stubs(rows, 100, ["id"], ["id"]).orderBy("place").collect()]
    assert got == [(1, 50, 50, False), (2, 8, 58, True), (3, 30, 88, False), (4, 2, 90, True), (5, 1, 91, False)]


def test_numbers_in_large_groups(spark):
    rows = spark.range(5000).selectExpr("id % 3 = 0 AS g", "id").repartition(5)
    got = {(r.g, r.id): r.place for r in dedup.numbered(rows, "g", "id").collect()}
    for g in (True, False):
        ids = [i for i in range(5000) if (i % 3 == 0) == g]
        assert [got[g, i] for i in ids] == list(range(1, len(ids) + 1))


def test_pairs_by_tiles_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(1300, 4))
    rows = spark.createDataFrame([(i, int(i % 7 == 0), v.tolist()) for i, v in enumerate(vecs)] + [(5000, 0, None), (5001, 0, [0.0] * 4), (5002, 0, [])], "id long, block int, vec array<double>")
    got = {(r.a, r.b) for r in dedup.near_pairs(rows, 0.02, ["block"]).collect()}
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = np.argwhere(1 - u @ u.T <= 0.02)
    assert got == {(int(i), int(j)) for i, j in near if i < j and (i % 7 == 0) == (j % 7 == 0)}
    both = {(r.a, r.b) for r in dedup.similar_pairs(rows.where("id < 400"), rows, 0.98, ["block"]).collect()}
    assert both == {(int(i), int(j)) for i, j in near if i < 400 and (i % 7 == 0) == (j % 7 == 0) and u[i] @ u[j] > 0.98}


def test_reviews_follow_the_rules(spark):
    log = [("k", n, a, w, w == "author", w == "admin") for n, (a, w) in enumerate([("endorse", "x"), ("submit", "x"), ("submit", "author"), ("endorse", "author"), ("endorse", "x"), ("endorse", "x"), ("endorse", "y"), ("deprecate", "x"), ("deprecate", "admin"), ("republish", "admin")])]
    df = spark.createDataFrame(log, "k string, at int, action string, actor string, is_author boolean, is_admin boolean")
    assert tuple(lifecycle.replay_review(df, "k", "at", []).first()) == ("k", "published", 2, 6)
    assert tuple(lifecycle.replay_review(df, "k", "at", [], "skill").first()) == ("k", "published", 2, 9)
    more = df.unionByName(spark.createDataFrame([("k", 20, "delete", "x", False, False), ("k", 21, "rollback", "admin", False, True), ("k", 22, "delete", "admin", False, True), ("k", 23, "submit", "author", True, False)], df.schema))
    assert lifecycle.replay_review(more, "k", "at", []).first().status == "deleted"
    assert lifecycle.replay_review(more, "k", "at", [], "skill").first().status == "in_review"


def test_files_of_skills(spark):
    from mnemospark.functions.skills import file_problem

    cases = [
        ("", False, "empty"), (None, False, "empty"), ("SKILL.md", False, "reserved"), ("/a", False, "absolute"), ("\\a", False, "absolute"), ("a\\b", False, "backslash"), ("scripts/" + "a" * 247, True, None), ("scripts/" + "a" * 248, True, "too long"),
        ("scripts/../x", True, "traversal"), ("scripts/.x", True, "invalid part"), ("scripts//x", True, "invalid part"), ("scripts/x\n", True, "invalid part"), ("run.sh", True, "not below scripts/"), ("note.md", False, "not below references/"), ("references/a.md", False, None), ("data/x.json", False, None),
    ]
    got = spark.createDataFrame([(k, p, e) for k, (p, e, _) in enumerate(cases)], "k int, p string, e boolean").select("k", file_problem(F.col("p"), F.col("e")).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: w for k, (*_, w) in enumerate(cases)}


def test_skills_are_invoked_with_checked_values(spark):
    from mnemospark.functions.skills import invoked

    schema = [("Name", "string", True, None), ("n", "integer", False, None), ("flag", "boolean", False, None), ("mode", "enum", False, ["a", "b"])]
    body = "Hi {{name}} $NAME {{Name}} n={{n}} $N f={{flag}} m=$MODE"
    cases = {
        '{"Name":"Ann","n":3,"flag":true,"mode":"b"}': ("Hi Ann Ann {{Name}} n=3 3 f=true m=b", []),
        '{"Name":"Ann","n":2.50,"extra":1}': ("Hi Ann Ann {{Name}} n=2.5 2.5 f={{flag}} m=$MODE", []),
        '{"Name":"$N","n":4.0}': ("Hi 4 4AME {{Name}} n=4 4 f={{flag}} m=$MODE", []),
        '{"Name":"x","n":0.0000001}': ("Hi x x {{Name}} n=0.0000001 0.0000001 f={{flag}} m=$MODE", []),
        "{}": (None, ["Name: required parameter is missing"]),
        "no json": (None, ["Name: required parameter is missing"]),
        '{"Name":1,"n":"3","flag":"true","mode":"c"}': (None, ["Name: expected string", "n: expected integer", "flag: expected boolean", "mode: not an allowed value"]),
        '{"Name":"x","mode":1}': (None, ["mode: expected string for enum"]),
    }
    kind = "p string, b string, s array<struct<name:string,type:string,required:boolean,values:array<string>>>"
    rows = spark.createDataFrame([(p, body, schema) for p in cases], kind)
    got = {r.p: (r.i.prompt, list(r.i.errors)) for r in rows.select("p", invoked(F.col("b"), F.col("s"), F.col("p")).alias("i")).collect()}
    # $NAME goes before $N, and what it put in is replaced in its turn
    want = dict(cases)
    want['{"Name":"$N","n":4.0}'] = ("Hi 4 4 {{Name}} n=4 4 f={{flag}} m=$MODE", [])
    assert got == want


def test_deleting_takes_children_along(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (None, "x")], "id int, k string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, None), (None, 1), (3, 3)], "a int, b int")
    kept, left = storage.delete_cascading(rows, F.col("k") == "x", "id", {"edges": (edges, ["a", "b"]), "same": (edges, ["a"])})
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.where("k is null or k = 'y'").collect()))
    assert {tuple(r) for r in left["edges"].collect()} == {(2, 3), (3, None), (3, 3)}
    assert {tuple(r) for r in left["same"].collect()} == {(2, 3), (3, None), (3, 3), (None, 1)}
