"""Registered queries: the entity graph, links and code symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import adapters as A
from mnemospark.functions.code import html_edges, python_symbols, symbols_by_pattern
from mnemospark.operators import graph as G
from mnemospark.plans.registry import query
from mnemospark.session import read_table

_REL = A.RELATIONS_SQL


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"))


def _near(name: str, predicates: list[str] | None, direction: str) -> None:
    keep = f"AND predicate IN ({', '.join(repr(p) for p in predicates)})" if predicates else ""
    out = f"SELECT subject_id AS entity_id, object_id AS neighbour_id, predicate, 'out' AS direction, confidence FROM relations WHERE subject_id IN (SELECT id FROM sup) {keep}"
    back = f"SELECT object_id AS entity_id, subject_id AS neighbour_id, predicate, 'in' AS direction, confidence FROM relations WHERE object_id IN (SELECT id FROM sup) {keep}"
    body = {"out": out, "in": back, "both": f"{out} UNION ALL {back}"}[direction]
    side = "SELECT 's' || s_suppkey AS id FROM supplier" if direction != "in" else "SELECT 'p' || p_partkey AS id FROM part"

    @query(name, f"WITH {_REL}, sup AS ({side}) {body}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = _suppliers(spark, sf_dir) if direction != "in" else read_table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"))
        return G.neighbours(A.relations(spark, sf_dir), asked, predicates, direction)


_near("graph_callees", ["calls"], "out")
_near("graph_callers", ["calls"], "in")
_near("graph_dependencies", ["imports", "uses", "extends", "implements", "defines"], "out")
_near("graph_dependents", None, "in")
_near("graph_neighbours", None, "both")


@query("relations_by_confidence", f"WITH {_REL} SELECT subject_id, predicate, object_id, confidence FROM relations WHERE scope_id = 'n3' AND predicate = 'uses' ORDER BY confidence DESC, subject_id, object_id LIMIT 200")
def relations_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.relations(spark, sf_dir).where("scope_id = 'n3' AND predicate = 'uses'")
    return rows.orderBy(F.desc("confidence"), "subject_id", "object_id").limit(200).select("subject_id", "predicate", "object_id", "confidence")


@query("resolve_symbol", """WITH e AS (SELECT p_partkey AS entity_id, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END AS entity_type, replace(lower(p_name), ' ', '.') AS canonical FROM part),
names AS (SELECT DISTINCT regexp_extract(canonical, '([^.]+)$', 1) AS name FROM e UNION SELECT regexp_extract(canonical, '([^.]+[.][^.]+)$', 1) FROM e UNION SELECT canonical FROM e),
c AS (SELECT n.name, entity_id, CASE WHEN canonical = n.name THEN 0 ELSE 1 END AS way, CASE entity_type WHEN 'function' THEN 1 WHEN 'class' THEN 6 ELSE 9 END AS kind, length(canonical) AS n
  FROM names n JOIN e ON canonical = n.name OR ends_with(canonical, '.' || n.name))
SELECT name, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY way, CASE WHEN way = 0 THEN kind ELSE n END, n, entity_id) AS k FROM c) WHERE k = 1""")
def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "part").selectExpr("p_partkey AS entity_id", "CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END AS entity_type", "replace(lower(p_name), ' ', '.') AS canonical")
    forms = [F.regexp_extract("canonical", r"([^.]+)$", 1), F.regexp_extract("canonical", r"([^.]+[.][^.]+)$", 1), F.col("canonical")]
    names = e.select(F.explode(F.array(*forms)).alias("name")).where("name <> ''").distinct()
    return G.resolve_symbols(e, names)


_SYMBOLS = """e AS (SELECT p_partkey AS entity_id, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'package' ELSE 'variable' END AS entity_type,
  replace(lower(p_name), ' ', CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '::' ELSE '#' END) || CASE WHEN p_partkey % 5 = 0 THEN '.' || lower(p_brand) ELSE '' END AS canonical FROM part)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols whose names have several parts, parted in the ways of several languages."""
    return read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS entity_id", "CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'package' ELSE 'variable' END AS entity_type",
        "concat(replace(lower(p_name), ' ', CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '::' ELSE '#' END), CASE WHEN p_partkey % 5 = 0 THEN concat('.', lower(p_brand)) ELSE '' END) AS canonical",
    )


@query("suffix_candidates", f"""WITH {_SYMBOLS}, names AS (SELECT DISTINCT unnest([split_part(lower(p_name), ' ', 2), replace(lower(p_name), ' ', '.'), split_part(lower(p_name), ' ', 2) || '.' || lower(p_brand), lower(p_brand)]) AS name FROM part)
SELECT name, entity_id, CAST(place AS INTEGER) AS place FROM (SELECT n.name, entity_id, row_number() OVER (PARTITION BY n.name ORDER BY length(canonical), entity_id) AS place FROM names n JOIN e
  ON canonical = n.name OR ends_with(canonical, '.' || n.name) OR ends_with(canonical, '::' || n.name) OR ends_with(canonical, '#' || n.name) WHERE n.name <> '') WHERE place <= 5""")
def suffix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = "explode(array(coalesce(try_element_at(split(lower(p_name), ' '), 2), ''), replace(lower(p_name), ' ', '.'), concat(coalesce(try_element_at(split(lower(p_name), ' '), 2), ''), '.', lower(p_brand)), lower(p_brand))) AS name"
    return G.by_suffix(_symbols(spark, sf_dir), read_table(spark, sf_dir, "part").selectExpr(forms))


@query("resolved_targets", f"""WITH {_SYMBOLS}, f AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS n, entity_id, canonical, regexp_extract(canonical, '([^.:#]+)$', 1) AS tail,
  regexp_extract(canonical, '^(.*)[.][^.]*$', 1) AS head FROM lineitem JOIN e ON entity_id = l_partkey),
asked AS (SELECT DISTINCT file, CASE WHEN entity_id % 4 = 0 THEN canonical ELSE tail END AS name FROM f WHERE n IN (2, 4)), own AS (SELECT file, tail AS name, min(entity_id) AS entity_id FROM f WHERE n = 1 GROUP BY ALL),
pkg AS (SELECT DISTINCT file, head AS canonical, unnest([head, regexp_extract(head, '([^.:#]+)$', 1)]) AS head, unnest([0, 1]) AS form FROM f WHERE n = 4 AND head <> ''),
a AS (SELECT a.file, a.name, o.entity_id, 1 AS stage, '' AS package, 0 AS form, 0 AS kind FROM asked a JOIN own o USING (file, name)
  UNION ALL SELECT a.file, a.name, e.entity_id, 2, p.canonical, form, list_position(['function', 'method', 'type', 'struct', 'interface', 'class', 'variable'], entity_type) FROM asked a JOIN pkg p USING (file) JOIN e ON e.canonical = p.head || '.' || a.name WHERE entity_type <> 'package'
  UNION ALL SELECT a.file, a.name, e.entity_id, 4, '', 0, length(e.canonical) FROM asked a JOIN e ON e.canonical = a.name OR ends_with(e.canonical, '.' || a.name) OR ends_with(e.canonical, '::' || a.name) OR ends_with(e.canonical, '#' || a.name))
SELECT file, name, entity_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY stage, package, form, kind, entity_id) AS k FROM a) WHERE k = 1""")
def resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files: their first lines define symbols, their second and fourth use some, their fourth import packages."""
    e = _symbols(spark, sf_dir)
    tail = lambda c: F.regexp_extract(c, "([^.:#]+)$", 1)
    named = e.select("entity_id", "canonical", tail("canonical").alias("tail"), F.regexp_extract("canonical", r"^(.*)[.][^.]*$", 1).alias("head"))
    uses = named.select("entity_id", F.when(F.col("entity_id") % 4 == 0, F.col("canonical")).otherwise(F.col("tail")).alias("name"))
    packages = named.where("head <> ''").select("entity_id", F.col("head").alias("canonical"), tail("head").alias("name"))
    lines = read_table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS file", "l_linenumber AS n", "l_partkey AS entity_id")
    asked = lines.where("n IN (2, 4)").join(uses, "entity_id").select("file", "name")
    local = lines.where("n = 1").join(named, "entity_id").select("file", F.col("tail").alias("name"), "entity_id")
    imports = lines.where("n = 4").join(packages, "entity_id").select("file", "canonical", "name")
    return G.resolve_targets(asked, local, imports, e)


@query("graph_paths", f"""WITH {_REL}, {A.ENTITIES_SQL}, r AS (SELECT * FROM relations)
SELECT a.subject_id AS n0, a.predicate AS p1, 'out' AS d1, a.object_id AS n1, b.predicate AS p2, 'in' AS d2, b.subject_id AS n2
FROM entities s JOIN r a ON a.subject_id = s.entity_id JOIN entities m ON m.entity_id = a.object_id JOIN r b ON b.object_id = m.entity_id JOIN entities t ON t.entity_id = b.subject_id
WHERE s.scope_id = 'n3' AND s.entity_type = 'service' AND a.predicate IN ('calls', 'uses') AND m.entity_type = 'function' AND b.predicate = 'calls' AND t.name <> s.name
  AND NOT (a.scope_id = b.scope_id AND a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.object_id = b.object_id)""")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of a scope, the functions they call or use, and the other services that call these."""
    hops = [G.Hop(("calls", "uses"), "out", F.col("entity_type") == "function"), G.Hop(("calls",), "in", F.col("entity_type") == "service")]
    found = G.match_paths(A.entities(spark, sf_dir), A.relations(spark, sf_dir), "n3", F.col("entity_type") == "service", hops)
    return found.where("n0 <> n2")


@query("cooccurrence_edges", """WITH x AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS a FROM lineitem)
SELECT a.a, b.a AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.a < b.a GROUP BY ALL HAVING count(*) >= 2""")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.co_occurrences(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").where("n >= 2")


@query("same_as_edges", """WITH e AS (SELECT p_partkey AS id, lower(p_name) AS canonical, p_type AS t FROM part)
SELECT a.id AS subject_id, b.id AS object_id, 'same_as' AS predicate FROM e a JOIN e b ON a.canonical = b.canonical AND a.t <> b.t AND a.id < b.id""")
def same_as_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "lower(p_name) AS canonical", "p_type AS t")
    return G.same_as(e).select("subject_id", "object_id", F.lit("same_as").alias("predicate"))


@query("chunk_edges", "SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL")
def chunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chain(read_table(spark, sf_dir, "conversations"), "conv_id", "turn")


def _rank_sql(rounds: int = 20) -> str:
    steps = []
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT r.node, 0.15 / n + 0.85 * (coalesce(got, 0) + coalesce((SELECT sum(rank) FROM r{k} WHERE node NOT IN (SELECT src FROM e)), 0) / n) AS rank "
            f"FROM r{k} r CROSS JOIN cnt LEFT JOIN (SELECT dst, sum(rank / degree) AS got FROM e JOIN deg USING (src) JOIN r{k} ON src = r{k}.node GROUP BY dst) g ON g.dst = r.node)"
        )
    return f"""WITH e AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
nodes AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), cnt AS MATERIALIZED (SELECT count(*) AS n FROM nodes), deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM e GROUP BY src),
r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, cnt), {", ".join(steps)} SELECT node, round(rank, 9) AS rank FROM r{rounds}"""


@query("pagerank", _rank_sql())
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey")).selectExpr("concat('c', o_custkey) AS src", "concat('s', l_suppkey) AS dst")
    placed = read_table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS src", "concat('n', s_nationkey) AS dst")
    return G.pagerank(bought.unionByName(placed)).withColumn("rank", F.round("rank", 9))


@query("graph_augment", f"""WITH {_REL}, {A.MEMORIES_SQL}, m AS (SELECT id, scope_id, 'p' || (id % 200 + 1) AS entity_id, created_at FROM memories WHERE is_active),
hits AS (SELECT 's' || s_suppkey AS entity_id, 0.5 + (s_suppkey % 10) / 20.0::DOUBLE AS score FROM supplier),
near AS (SELECT entity_id, nb, max(confidence) AS c FROM (SELECT subject_id AS entity_id, object_id AS nb, confidence FROM relations UNION ALL SELECT object_id, subject_id, confidence FROM relations) GROUP BY ALL),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id) AS k FROM m) WHERE k <= 3),
found AS (SELECT few.id, score * c * 0.6 AS s, row_number() OVER (PARTITION BY few.id ORDER BY score DESC, hits.entity_id, c DESC, nb) AS place FROM hits JOIN near ON near.entity_id = hits.entity_id JOIN few ON few.entity_id = near.nb
  WHERE starts_with(few.scope_id, 'n') AND few.id % 10 <> 0)
SELECT id, round(s, 6) AS score FROM found WHERE place = 1""")
def graph_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a hit; memories of nations are allowed, and every tenth document is among the results already."""
    hits = read_table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS entity_id", "0.5D + (s_suppkey % 10) / 20D AS score")
    memories = A.memories(spark, sf_dir).where("is_active").selectExpr("id", "scope_id", "concat('p', id % 200 + 1) AS entity_id", "created_at")
    allowed = read_table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS scope_id")
    seen = read_table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"))
    return G.augmented(hits, A.relations(spark, sf_dir), memories, allowed, seen).withColumn("score", F.round("score", 6))


@query("html_links", r"""SELECT page_id, 'imports' AS predicate, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS target FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_edges(read_table(spark, sf_dir, "pages").selectExpr("page_id", "html"))


@query("code_symbols")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of generated sources: every part becomes a small Python module, whose symbols and edges are read back."""
    source = F.format_string(
        "import %s\nfrom %s.core import run\n\nclass %s(Base):\n    def make(self, x):\n        return run(x)\n\ndef build_%s():\n    return %s()\n",
        F.lower(F.split("p_brand", "#")[0]), F.lower(F.element_at(F.split("p_type", " "), -1)), F.initcap(F.element_at(F.split("p_type", " "), -1)), F.col("p_partkey").cast("string"), F.initcap(F.element_at(F.split("p_type", " "), -1)),
    )
    files = read_table(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("path"), source.alias("content"))
    return python_symbols(files)


@query("code_symbols_by_pattern")
def code_symbols_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of generated SQL, shell, Go and JavaScript sources by the patterns of their languages."""
    forms = {
        "sql": "CREATE TABLE t_%s (id INT);\nCREATE VIEW v_%s AS SELECT 1;\n", "sh": "source lib_%s.sh\nrun_%s() {\n  echo 1\n}\n",
        "go": "package p_%s\n\nimport \"fmt\"\n\nfunc Do%s(x int) error { return nil }\n", "js": "import x from './m%s'\nexport class A%s extends B {}\n",
    }
    part = read_table(spark, sf_dir, "part")
    files = None
    for end, form in forms.items():
        one = part.select(F.concat(F.lit("src/f"), "p_partkey", F.lit(f".{end}")).alias("path"), F.format_string(form, F.col("p_partkey").cast("string"), F.col("p_partkey").cast("string")).alias("content"))
        files = one if files is None else files.unionByName(one)
    return symbols_by_pattern(files)


@query("resolved_calls", """WITH sym AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 97 AS name, l_partkey AS symbol FROM lineitem WHERE l_linenumber = 1),
calls AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 97 AS name FROM lineitem WHERE l_linenumber = 2), imp AS (SELECT s_suppkey AS file, s_suppkey + 1 AS target FROM supplier),
c AS (SELECT calls.*, symbol, 1 AS stage FROM calls JOIN sym USING (file, name) UNION ALL SELECT calls.*, symbol, 2 FROM calls JOIN imp USING (file) JOIN sym ON sym.file = imp.target AND sym.name = calls.name
  UNION ALL SELECT calls.*, s.symbol, 3 FROM calls JOIN (SELECT name, min(symbol) AS symbol FROM sym GROUP BY name HAVING count(*) = 1) s USING (name))
SELECT file, name, arg_min(symbol, (stage, symbol)) AS symbol, min(stage) AS stage FROM c GROUP BY file, name""")
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files whose first lines define parts and whose second lines call them."""
    line = read_table(spark, sf_dir, "lineitem")
    symbols = line.where("l_linenumber = 1").selectExpr("l_suppkey AS file", "l_partkey % 97 AS name", "l_partkey AS symbol").distinct()
    calls = line.where("l_linenumber = 2").selectExpr("l_suppkey AS file", "l_partkey % 97 AS name")
    imports = read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS file", "s_suppkey + 1 AS target")
    return G.resolve_calls(calls, symbols, imports)
