"""Registered queries: text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import adapters as A
from mnemospark.functions import text as T
from mnemospark.functions.skills import file_problem, front_matter, invoked, parameter_fits
from mnemospark.functions.vector import fit_dimensions
from mnemospark.plans.registry import query
from mnemospark.session import read_table


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where(F.length("text") > 2000)
    return docs.select("doc_id", F.posexplode(T.chunks("text")).alias("chunk", "content")).select("doc_id", "chunk", F.length("content").alias("n_chars"), F.md5("content").alias("content_hash"))


_EXTENSION = r"lower(regexp_extract(regexp_extract(regexp_replace(substring(source_ref, 6), ':[^:]*$', ''), '([^/]*)$', 1), '^.+(\.[^.]*)$', 1))"
_CODE_LINES = f"list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '{T._FILLED}'))"


@query("classify_content", f"""WITH {A.MEMORIES_SQL}, x AS (SELECT id, content, CASE WHEN starts_with(source_ref, 'file:') THEN {_EXTENSION} ELSE '' END AS extension FROM memories)
SELECT id, CASE WHEN extension IN {T.CODE_EXTENSIONS} THEN 'code' WHEN extension <> '' THEN 'text'
  WHEN len(list_filter({_CODE_LINES}, lambda l: regexp_matches(l, '{T.CODE_LINE}'))) > 0.4 * len({_CODE_LINES}) THEN 'code' ELSE 'text' END AS kind FROM x""")
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.memories(spark, sf_dir).select("id", T.content_kind(F.col("content"), F.col("source_ref")).alias("kind"))


@query("extract_entities")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.memories(spark, sf_dir).select("id", F.explode(T.entity_mentions(F.col("content"), F.col("source_ref"))).alias("e"))
    return found.select("id", "e.type", "e.canonical")


@query("entity_counts", r"""WITH x AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._]+@[A-Za-z0-9.]+', 0))) AS mention FROM documents) SELECT mention, count(*) AS documents FROM x GROUP BY mention""")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), F.lit(0)))
    return read_table(spark, sf_dir, "documents").select(F.explode(found).alias("mention")).groupBy("mention").agg(F.count(F.lit(1)).alias("documents"))


_PARTS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query("summarise", f"""WITH p AS (SELECT doc_id, text, {_PARTS} AS ps FROM documents WHERE text IS NOT NULL), h AS (SELECT *, ps[1:150] AS head FROM p),
c AS (SELECT *, list_position(list_reverse(list_transform(head, lambda w: regexp_matches(w, '[.!?]$'))), true) AS back FROM h)
SELECT doc_id, md5(CASE WHEN len(ps) <= 150 THEN text WHEN back > 0 THEN array_to_string(head[1:len(head) - back + 1], ' ') ELSE array_to_string(head, ' ') END) AS summary_hash FROM c""")
def summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.summarise(F.col("text"))).alias("summary_hash"))


@query("summary_backfill", f"""WITH {A.ARTIFACTS_SQL}, t AS (SELECT id, content AS text FROM artifacts WHERE summary IS NULL AND content <> ''), p AS (SELECT id, text, {_PARTS} AS ps FROM t), h AS (SELECT *, ps[1:150] AS head FROM p),
c AS (SELECT *, list_position(list_reverse(list_transform(head, lambda w: regexp_matches(w, '[.!?]$'))), true) AS back FROM h)
SELECT id, md5(CASE WHEN len(ps) <= 150 THEN text WHEN back > 0 THEN array_to_string(head[1:len(head) - back + 1], ' ') ELSE array_to_string(head, ' ') END) AS summary_hash FROM c""")
def summary_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the artifacts that have none yet."""
    rows = A.artifacts(spark, sf_dir).where("summary IS NULL AND content <> ''")
    return rows.select("id", F.md5(T.summarise(F.col("content"))).alias("summary_hash"))


@query("extract_lead", r"""SELECT doc_id, CASE WHEN regexp_matches(substring(text, 1, 120), '[.\n]') THEN regexp_extract(substring(text, 1, 120), '^([^.\n]*\.?)', 1)
  WHEN length(text) <= 120 THEN text ELSE substring(text, 1, 120) || '…' END AS lead FROM documents WHERE text IS NOT NULL""")
def extract_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.lead(F.col("text")).alias("lead"))


@query("normalise_slug", r"SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug FROM part")
def normalise_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("source_paths", rf"WITH {A.MEMORIES_SQL} SELECT id, regexp_replace(regexp_replace(source_ref, '^file:', ''), ':\d+$', '') AS path FROM memories WHERE starts_with(source_ref, 'file:')")
def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.memories(spark, sf_dir).where(F.col("source_ref").startswith("file:")).select("id", T.source_path(F.col("source_ref")).alias("path"))


@query("token_estimates", "SELECT conv_id, CAST(sum(strlen(coalesce(text, '')) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.estimated_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


@query("embedding_inputs", "SELECT doc_id AS id, strlen(replace(text, chr(0), '')) AS bytes FROM documents WHERE text IS NOT NULL AND strlen(replace(text, chr(0), '')) BETWEEN 1 AND 32000")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that an embedder takes: NUL dropped, not empty, at most 32,000 bytes."""
    clean = F.replace("text", F.lit("\x00"), F.lit(""))
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.octet_length(clean).cast("long").alias("bytes")).where("bytes BETWEEN 1 AND 32000")


@query("fake_embeddings")
def fake_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeatable unit vectors from the texts' hashes, for tests without a provider."""
    from mnemospark.functions.embed import hashed_vectors

    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.select("id", hashed_vectors("text").alias("vec")).select("id", F.size("vec").alias("dimensions"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("first"))


@query("template_fill", r"SELECT p_partkey AS id, replace(replace('Use {{name}} of $BRAND', '{{name}}', p_name), '$BRAND', p_brand) AS prompt FROM part")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.lit("Use {{name}} of $BRAND")
    filled = F.replace(F.replace(form, F.lit("{{name}}"), F.col("p_name")), F.lit("$BRAND"), F.col("p_brand"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), filled.alias("prompt"))


@query("skill_invocations", r"""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Call ' || s_name || ' in ' || s_nationkey || CASE WHEN s_suppkey % 5 = 1 THEN ' fast' ELSE ' $SPEED' END || ': ' || s_name END AS prompt,
  CASE WHEN s_suppkey % 5 = 0 THEN 'nation: expected integer' ELSE '' END AS errors FROM supplier""")
def skill_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill called once for every supplier with values from its row, some of a wrong type."""
    values = "to_json(named_struct('who', s_name, 'speed', CASE WHEN s_suppkey % 5 = 1 THEN 'fast' END))"
    number = "CASE WHEN s_suppkey % 5 = 0 THEN concat('\"', s_nationkey, '\"') WHEN s_suppkey % 5 = 2 THEN concat(s_nationkey, '.0') ELSE CAST(s_nationkey AS STRING) END"
    calls = read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", f"concat('{{\"nation\":', {number}, ',', substring({values}, 2)) AS params")
    one = lambda name, kind, need, *values: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(need).alias("required"), F.array(*[F.lit(v) for v in values]).cast("array<string>").alias("values"))
    schema = F.array(one("who", "string", True), one("nation", "integer", True), one("speed", "enum", False, "fast", "slow"))
    done = calls.select("id", invoked(F.lit("Call {{who}} in $NATION $SPEED: $WHO"), schema, F.col("params")).alias("i"))
    return done.select("id", "i.prompt", F.array_join("i.errors", "; ").alias("errors"))


@query("fitted_dimensions", """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 32 ELSE 80 END AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT id, CAST(n AS INTEGER) AS dimensions, round(list_sum(v[1:n]), 6) AS total, round(coalesce(v[n], 0), 6) AS last FROM e""")
def fitted_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to 32 components or padded to 80, as tables of models with other sizes need them."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    fitted = F.when(F.col("id") % 2 == 0, fit_dimensions(F.col("v"), 32)).otherwise(fit_dimensions(F.col("v"), 80))
    done = rows.select("id", fitted.alias("v"))
    return done.select("id", F.size("v").alias("dimensions"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("v", -1), 6).alias("last"))


_PATHS = """SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'scripts/' WHEN 1 THEN 'references/' WHEN 2 THEN '' ELSE '/' END || regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.sh' ELSE '/..' END AS path,
  page_id % 2 = 0 AS executable FROM pages"""


@query("skill_file_checks", f"""WITH p AS ({_PATHS})
SELECT id, path, CASE WHEN path = '' THEN 'empty' WHEN path = 'SKILL.md' THEN 'reserved' WHEN starts_with(path, '/') THEN 'absolute' WHEN contains(path, chr(92)) THEN 'backslash' WHEN strlen(path) > 255 THEN 'too long'
  WHEN list_contains(string_split(path, '/'), '..') THEN 'traversal' WHEN NOT regexp_full_match(path, '[a-zA-Z0-9][a-zA-Z0-9._-]*(/[a-zA-Z0-9][a-zA-Z0-9._-]*)*') THEN 'invalid part'
  WHEN executable AND NOT starts_with(path, 'scripts/') THEN 'not below scripts/' WHEN NOT executable AND ends_with(path, '.md') AND NOT starts_with(path, 'references/') THEN 'not below references/' END AS problem FROM p""")
def skill_file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as paths of supplementary files."""
    read_table(spark, sf_dir, "pages").createOrReplaceTempView("_skill_file_pages")
    rows = spark.sql(_PATHS.replace("FROM pages", "FROM _skill_file_pages"))
    return rows.select("id", "path", file_problem(F.col("path"), F.col("executable")).alias("problem"))


@query("token_hashes", "SELECT c_custkey AS id, sha256('tok_' || c_name) AS token_hash FROM customer")
def token_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.sha2(F.concat(F.lit("tok_"), "c_name"), 256).alias("token_hash"))


@query("skill_frontmatter", "SELECT p_partkey AS id, p_name AS name, p_type AS description, CASE p_partkey % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'coder,reviewer' ELSE 'planner' END AS agent_types, p_partkey % 5 <> 0 AS closed FROM part WHERE p_partkey % 5 <> 0")
def skill_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as skill files with front matter, read back; heads that are not closed are errors."""
    agents = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "agent_types: [coder, reviewer]\n").otherwise("agent_types:\n  - planner\n")
    end = F.when(F.col("p_partkey") % 5 == 0, "").otherwise("---\n")
    text = F.concat(F.lit("---\nname: "), "p_name", F.lit("\ndescription: "), "p_type", F.lit("\n"), agents, end, F.lit("Do it.\n"))
    parsed = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), front_matter(text).alias("f")).where("f.closed")
    return parsed.select("id", "f.name", "f.description", F.array_join("f.agent_types", ",").alias("agent_types"), "f.closed")


@query("parameter_checks", r"""SELECT o_orderkey AS id, regexp_matches(o_orderstatus, '^[+-]?\d+$') AS as_integer, o_orderstatus IN ('F', 'O') AS as_enum FROM orders""")
def parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, allowed = F.col("o_orderstatus"), F.array(F.lit("F"), F.lit("O"))
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), parameter_fits(F.lit("integer"), value, allowed).alias("as_integer"), parameter_fits(F.lit("enum"), value, allowed).alias("as_enum")
    )
