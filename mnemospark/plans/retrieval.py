"""Registered queries: retrieval, visibility, merging and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import adapters as A
from mnemospark.functions import text as T
from mnemospark.operators import recall as R
from mnemospark.operators import scoping as S
from mnemospark.operators import search
from mnemospark.plans.registry import query
from mnemospark.session import read_table

QUESTION = "why the thing are with this only"
LIMIT = 10

_QVEC = "qv AS (SELECT vec AS q FROM vectors WHERE id = 0)"
_COS = "round(list_dot_product(vec, q) / sqrt(list_dot_product(vec, vec) * list_dot_product(q, q)), 9)"
_DAYS = f"(epoch(TIMESTAMP '{A.NOW}') - epoch({{0}})) / 86400.0"
_RATE = "CASE memory_type WHEN 'working' THEN 0.015 WHEN 'episodic' THEN 0.010 ELSE 0.005 END"
_MSCORE = f"0.50 * vector + 0.10 * text + 0.10 * trigram + 0.20 * importance + 0.10 * exp(-({_RATE}) * {_DAYS.format('coalesce(last_accessed, created_at)')})"
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"
_TRI = f"list_distinct(flatten(list_transform({_WORDS}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_JAC = "coalesce(len(list_intersect({0}, {1})) / nullif(CAST(len({0}) + len({1}) - len(list_intersect({0}, {1})) AS DOUBLE), 0), 0)"


def _query_vector(spark: SparkSession, sf_dir: str, of: int = 0) -> DataFrame:
    """(q): the vector of one document, which stands for an embedded question; empty if there is none."""
    return A.vectors(spark, sf_dir).where(F.col("id") == of).select(F.col("vec").alias("q"))


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.memories(spark, sf_dir).where("is_active")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _index(spark: SparkSession, sf_dir: str, kind: str, table: str = "documents") -> str:
    """The folder of the index of a table's texts; it is built where it is not there yet."""
    source = read_table(spark, sf_dir, table)
    rows = source.selectExpr("doc_id AS id", "text AS content") if table == "documents" else source.selectExpr("p_partkey AS id", "concat(p_type, ' ', p_name) AS content")
    write = search.write_trigram_index if kind == "trigram" else lambda r, f: search.write_word_index(r, f, kind)
    return search.kept(source, f"{table}-{kind}", lambda folder: write(rows, folder))


@query("text_index_terms", f"""WITH w AS (SELECT doc_id AS id, unnest({_WORDS.format("coalesce(text, '')")}) AS term FROM documents), c AS (SELECT id, term, count(*) AS n FROM w GROUP BY ALL)
SELECT term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS occurrences FROM c GROUP BY term""")
def text_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the word index holds of every term."""
    held = spark.read.parquet(_index(spark, sf_dir, "simple"))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("places")).cast("long").alias("occurrences"))


@query("trigram_index_grams", f"""WITH g AS (SELECT doc_id AS id, unnest({_TRI.format("coalesce(text, '')")}) AS term FROM documents)
SELECT term, count(*) AS docs FROM g GROUP BY term""")
def trigram_index_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_index(spark, sf_dir, "trigram")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


@query("recall_text", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_QVEC},
c AS (SELECT m.*, {_COS} AS vector, 0.0 AS text, 0.0 AS trigram FROM memories m JOIN vectors v ON m.id = v.id, qv WHERE is_active),
k AS (SELECT * FROM c ORDER BY vector DESC, id LIMIT 20)
SELECT id, memory_type, round({_MSCORE}, 6) AS score FROM k ORDER BY {_MSCORE} DESC, id LIMIT 10""")
def recall_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.recall_memories(_active(spark, sf_dir), A.now(), "", _query_vector(spark, sf_dir), [A.vectors(spark, sf_dir)], mode="text"), "score")


@query("recall_hybrid", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_QVEC},
a AS (SELECT * FROM memories WHERE is_active),
q AS (SELECT {_WORDS.format("'" + QUESTION + "'")} AS terms, {_TRI.format("'" + QUESTION + "'")} AS tri),
v AS (SELECT a.id, {_COS} AS vector, NULL::DOUBLE AS text, NULL::DOUBLE AS trigram FROM a JOIN vectors ON a.id = vectors.id, qv ORDER BY vector DESC, id LIMIT 20),
w AS (SELECT id, {_WORDS.format('content')} AS ws, terms FROM a, q),
f AS (SELECT id, NULL::DOUBLE, len(list_filter(ws, lambda x: list_contains(terms, x))) / greatest(len(ws), 1)::DOUBLE AS text, NULL::DOUBLE FROM w WHERE list_has_all(ws, terms) ORDER BY text DESC, id LIMIT 20),
g AS (SELECT id, {_TRI.format('content')} AS t, tri FROM a, q),
t AS (SELECT id, NULL::DOUBLE, NULL::DOUBLE, {_JAC.format('t', 'tri')} AS s FROM g WHERE {_JAC.format('t', 'tri')} > 0.1 ORDER BY s DESC, id LIMIT 20),
u AS (SELECT * FROM v UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t),
c AS (SELECT id, coalesce(max(vector), 0) AS vector, coalesce(max(text), 0) AS text, coalesce(max(trigram), 0) AS trigram FROM u GROUP BY id),
s AS (SELECT c.id, memory_type, {_MSCORE} AS sc FROM c JOIN a ON c.id = a.id)
SELECT id, memory_type, round(sc, 6) AS score FROM s ORDER BY sc DESC, id LIMIT 10""")
def recall_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = dict(word_index=_index(spark, sf_dir, "simple"), trigram_index=_index(spark, sf_dir, "trigram"))
    return _rounded(R.recall_memories(_active(spark, sf_dir), A.now(), QUESTION, _query_vector(spark, sf_dir), [A.vectors(spark, sf_dir)], **indexes), "score")


@query("recall_authorised", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_QVEC},
a AS (SELECT * FROM memories WHERE is_active AND scope_id IN ('n1', 'n2', 'n3', 'r1')),
q AS (SELECT {_WORDS.format("'" + QUESTION + "'")} AS terms, {_TRI.format("'" + QUESTION + "'")} AS tri),
v AS (SELECT a.id, {_COS} AS vector, NULL::DOUBLE AS text, NULL::DOUBLE AS trigram FROM a JOIN vectors ON a.id = vectors.id, qv ORDER BY vector DESC, id LIMIT 20),
w AS (SELECT id, {_WORDS.format('content')} AS ws, terms FROM a, q),
f AS (SELECT id, NULL::DOUBLE, len(list_filter(ws, lambda x: list_contains(terms, x))) / greatest(len(ws), 1)::DOUBLE AS text, NULL::DOUBLE FROM w WHERE list_has_all(ws, terms) ORDER BY text DESC, id LIMIT 20),
g AS (SELECT id, {_TRI.format('content')} AS t, tri FROM a, q),
t AS (SELECT id, NULL::DOUBLE, NULL::DOUBLE, {_JAC.format('t', 'tri')} AS s FROM g WHERE {_JAC.format('t', 'tri')} > 0.1 ORDER BY s DESC, id LIMIT 20),
c AS (SELECT id, coalesce(max(vector), 0) AS vector, coalesce(max(text), 0) AS text, coalesce(max(trigram), 0) AS trigram FROM (SELECT * FROM v UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t) GROUP BY id),
s AS (SELECT c.id, memory_type, {_MSCORE} AS sc FROM c JOIN a ON c.id = a.id)
SELECT id, memory_type, round(sc, 6) AS score FROM s ORDER BY sc DESC, id LIMIT 10""")
def recall_authorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid recall of an asker who is authorised for three nations and a region."""
    own = A.scopes(spark, sf_dir).where("id IN ('n1', 'n2', 'n3', 'r1')").select(F.col("id").alias("scope_id"))
    indexes = dict(word_index=_index(spark, sf_dir, "simple"), trigram_index=_index(spark, sf_dir, "trigram"))
    return _rounded(R.recall_memories(_active(spark, sf_dir), A.now(), QUESTION, _query_vector(spark, sf_dir), [A.vectors(spark, sf_dir)], scopes=own, **indexes), "score")


_WINDOW = "created_at BETWEEN TIMESTAMP '2023-09-01' AND TIMESTAMP '2024-01-15'"


@query("recall_modes", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_QVEC}, a AS (SELECT * FROM memories WHERE is_active AND {_WINDOW}),
near AS (SELECT a.*, {_COS} AS vector, vectors.id % 2 AS odd, row_number() OVER (PARTITION BY vectors.id % 2 = 0 ORDER BY {_COS} DESC, a.id) AS place FROM a JOIN vectors ON vectors.id = a.id, qv),
code AS (SELECT a.*, {_COS} AS vector FROM a JOIN vectors ON vectors.id = a.id, qv WHERE content_kind = 'code' ORDER BY vector DESC, a.id LIMIT 20),
u AS (SELECT 'text' AS mode, id, memory_type, importance, last_accessed, created_at, vector, 0.0 AS text, 0.0 AS trigram FROM near WHERE odd = 0 AND place <= 20
  UNION ALL SELECT 'code', id, memory_type, importance, last_accessed, created_at, vector, 0.0, 0.0 FROM code),
s AS (SELECT mode, id, {_MSCORE} AS sc FROM u WHERE memory_type IN ('semantic', 'episodic', 'procedural')),
r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY sc DESC, id) AS place FROM s WHERE sc >= 0.1)
SELECT mode, id, round(sc, 6) AS score FROM r WHERE place <= 10""")
def recall_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text recall from a model's own table (vectors with even numbers), which goes before those kept with the rows, and code recall from the vectors of code."""
    vectors = A.vectors(spark, sf_dir)
    rows = _active(spark, sf_dir)
    code = vectors.join(rows.where("content_kind = 'code'").select("id"), "id", "left_semi")
    asked = dict(types=["semantic", "episodic", "procedural"], since=F.lit("2023-09-01").cast("timestamp"), until=F.lit("2024-01-15").cast("timestamp"), min_score=0.1)
    question = _query_vector(spark, sf_dir)
    text = R.recall_memories(rows, A.now(), "", question, [vectors.where("id % 2 = 0"), vectors], mode="text", **asked)
    by_code = R.recall_memories(rows, A.now(), "", question, [], question, [code], mode="code", **asked)
    both = text.select(F.lit("text").alias("mode"), "id", "score").unionByName(by_code.select(F.lit("code").alias("mode"), "id", "score"))
    return _rounded(both, "score")


@query("near_duplicate_probe", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, m AS (SELECT memories.id, scope_id, is_active, created_at, vec FROM memories JOIN vectors ON vectors.id = memories.id),
new AS (SELECT scope_id, max_by(id, struct_pack(c := created_at, i := id)) AS id FROM m GROUP BY scope_id),
p AS (SELECT n.id AS asked_id, m.id, round(1 - list_dot_product(m.vec, q.vec) / sqrt(list_dot_product(m.vec, m.vec) * list_dot_product(q.vec, q.vec)), 9) AS distance
  FROM new n JOIN m q ON q.id = n.id JOIN m ON m.scope_id = n.scope_id AND m.id <> n.id WHERE m.is_active),
r AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY distance, id) AS place FROM p WHERE distance <= 0.95) SELECT asked_id, id, round(distance, 6) AS distance FROM r WHERE place <= 5""")
def near_duplicate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest memory of every scope against its scope."""
    rows = A.memories(spark, sf_dir).select("id", "scope_id", "is_active", "created_at").join(A.vectors(spark, sf_dir), "id")
    newest = rows.groupBy("scope_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max_by("vec", F.struct("created_at", "id")).alias("vec"))
    return _rounded(R.near_probe(newest, rows, distance=0.95), "distance")


@query("query_similar", f"""WITH {A.MEMORIES_SQL}, {A.SCOPES_SQL}, {A.VECTORS_SQL}, {_QVEC}
SELECT m.id AS object_id, round({_COS}, 6) AS score FROM memories m JOIN vectors v ON v.id = m.id JOIN scopes s ON s.id = m.scope_id, qv WHERE s.path = 'r1' OR starts_with(s.path, 'r1.') ORDER BY {_COS} DESC, m.id LIMIT 20""")
def query_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = A.memories(spark, sf_dir).select(F.lit("memory").alias("object_type"), F.col("id").alias("object_id"), "scope_id").join(A.vectors(spark, sf_dir).withColumnRenamed("id", "object_id"), "object_id")
    return _rounded(R.query_similar(table, A.scopes(spark, sf_dir), _query_vector(spark, sf_dir), "memory", "r1"), "score")


@query("recall_access", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_QVEC},
c AS (SELECT m.*, {_COS} AS vector, 0.0 AS text, 0.0 AS trigram FROM memories m JOIN vectors v ON m.id = v.id, qv WHERE is_active), k AS (SELECT * FROM c ORDER BY vector DESC, id LIMIT 20),
h AS (SELECT id FROM k ORDER BY {_MSCORE} DESC, id LIMIT 10)
SELECT id, CAST(access_count + CASE WHEN id IN (SELECT id FROM h) THEN 1 ELSE 0 END AS INT) AS access_count, CASE WHEN id IN (SELECT id FROM h) THEN TIMESTAMP '{A.NOW}' ELSE last_accessed END AS last_accessed FROM memories""")
def recall_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recall leaves behind: its results were accessed once more."""
    hits = R.recall_memories(_active(spark, sf_dir), A.now(), "", _query_vector(spark, sf_dir), [A.vectors(spark, sf_dir)], mode="text")
    return R.touched(A.memories(spark, sf_dir), hits, A.now()).select("id", "access_count", "last_accessed")


@query("recall_code_fallback", f"""WITH {A.MEMORIES_SQL}, w AS (SELECT id, {_WORDS.format('content')} AS ws FROM memories WHERE is_active AND content_kind = 'code'),
f AS (SELECT id, len(list_filter(ws, lambda x: list_contains(['the', 'that'], x))) / greatest(len(ws), 1)::DOUBLE AS text FROM w WHERE list_has_all(ws, ['the', 'that']))
SELECT id, round(text, 6) AS score FROM f ORDER BY text DESC, id LIMIT 20""")
def recall_code_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No memory here has a code vector, so the code mode falls back to terms."""
    return R.by_terms(_active(spark, sf_dir).where("content_kind = 'code'"), "the that", 20).select("id", F.round("text", 6).alias("score"))


@query("trigram_search", f"""WITH q AS (SELECT {_TRI.format("'econom brass'")} AS b), p AS (SELECT p_partkey AS id, {_TRI.format("p_type || ' ' || p_name")} AS a, b FROM part, q)
SELECT id, round({_JAC.format('a', 'b')}, 6) AS score FROM p WHERE {_JAC.format('a', 'b')} > 0.1 ORDER BY {_JAC.format('a', 'b')} DESC, id LIMIT 50""")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.match_trigrams(spark, _index(spark, sf_dir, "trigram", "part"), "econom brass", 50)
    return found.select("id", F.round("trigram", 6).alias("score"))


@query("ilike_search", "SELECT doc_id AS id, lang FROM documents WHERE text ILIKE '%tion the%' ORDER BY doc_id")
def ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where(F.col("text").ilike("%tion the%")).select(F.col("doc_id").alias("id"), "lang")


@query("suffix_match", "SELECT url, page_id, length(url) AS n FROM pages WHERE url = 'html' OR ends_with(url, '.html') OR ends_with(url, '#top') ORDER BY length(url), page_id LIMIT 100")
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("url") == "html") | F.col("url").endswith(".html") | F.col("url").endswith("#top")
    return read_table(spark, sf_dir, "pages").where(hit).select("url", "page_id", F.length("url").cast("long").alias("n")).orderBy("n", "page_id").limit(100)


@query("fts_simple", f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
f AS (SELECT id, len(list_filter(ws, lambda x: list_contains(['the', 'and', 'with'], x))) / greatest(len(ws), 1)::DOUBLE AS text FROM w WHERE list_has_all(ws, ['the', 'and', 'with']))
SELECT id, round(text, 6) AS score FROM f ORDER BY text DESC, id LIMIT 100""")
def fts_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_words(spark, _index(spark, sf_dir, "simple"), "the and with", 100).select("id", F.round("text", 6).alias("score"))


@query("fts_english")
def fts_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of the question must occur; ranked by cover density."""
    question = "the things of erbles and ertion"
    found = search.match_english(spark, _index(spark, sf_dir, "english"), question, 100)
    return found.select("id", F.round("text", 6).alias("score"), F.lit(" ".join(sorted(set(T.english_words(question)) - {""}))).alias("query_stem"))


_KSCORE = f"""0.50 * 0 + 0.10 * text + 0.10 * 0 + 0.20 * least(endorsement_count / 10.0::DOUBLE, 1.0)
  + 0.10 * CASE WHEN {_DAYS.format('created_at')} <= 0 THEN 1.0 ELSE exp(-0.6931471805599453 * ({_DAYS.format('created_at')}) / CASE kind WHEN 'meeting' THEN 7.0 WHEN 'retro' THEN 14.0 WHEN 'research' THEN 45.0 WHEN 'spec' THEN 60.0 WHEN 'decision' THEN 90.0 ELSE 30.0 END) END
  + 0.10 + CASE WHEN kind = 'decision' THEN 0.08 ELSE 0 END"""
_KFROM = f"""{A.ARTIFACTS_SQL}, w AS (SELECT *, {_WORDS.format('content')} AS ws FROM artifacts WHERE status = 'published'
    AND coalesce(published_at, created_at) BETWEEN TIMESTAMP '2023-06-01' AND TIMESTAMP '{A.NOW}'),
f AS (SELECT *, len(list_filter(ws, lambda x: list_contains(['the', 'and'], x))) / greatest(len(ws), 1)::DOUBLE AS text FROM w WHERE list_has_all(ws, ['the', 'and'])),
s AS (SELECT id, kind, {_KSCORE} AS sc FROM (SELECT * FROM f ORDER BY text DESC, id LIMIT 60))"""


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.artifacts(spark, sf_dir).where("status = 'published'")
    rows = rows.where(F.coalesce("published_at", "created_at").between(F.lit("2023-06-01").cast("timestamp"), A.now()))
    found = R.merged(R.by_terms(rows, "the and", 60))
    scored = rows.drop("content").join(F.broadcast(found), "id")
    return scored.withColumn("score", R.knowledge_score(A.now()) + R.intent_boost(F.col("kind"), QUESTION)).select("id", "kind", "score")


@query("knowledge_recall", f"WITH {_KFROM} SELECT id, kind, round(sc, 6) AS score FROM s ORDER BY sc DESC, id LIMIT 20")
def knowledge_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.best(_knowledge(spark, sf_dir), 20), "score")


_DIGEST = "digests AS (SELECT d.id AS digest_id, s.id AS source_id FROM artifacts d JOIN artifacts s ON s.id BETWEEN d.id + 3 AND d.id + 9 WHERE d.artifact_kind = 'digest' AND d.status = 'published')"


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published digest covers the three artifacts after it."""
    heads = A.artifacts(spark, sf_dir).where("artifact_kind = 'digest' AND status = 'published'").selectExpr("id AS digest_id", "explode(array(id + 3, id + 6, id + 9)) AS source_id")
    return heads.join(A.artifacts(spark, sf_dir).select(F.col("id").alias("source_id")), "source_id", "left_semi")


@query("digest_suppression", f"""WITH {_KFROM}, {_DIGEST}, r AS (SELECT * FROM s ORDER BY sc DESC, id LIMIT 60)
SELECT id, kind, round(sc, 6) AS score FROM r WHERE id NOT IN (SELECT source_id FROM digests WHERE digest_id IN (SELECT id FROM r))""")
def digest_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.without_digested(R.best(_knowledge(spark, sf_dir), 60), _digests(spark, sf_dir)), "score")


@query("artifact_visibility", f"""WITH {A.ARTIFACTS_SQL}, {A.SCOPES_SQL}, {A.SHARING_SQL}, q AS (SELECT id AS asked_scope, path FROM scopes WHERE kind <> 'user')
SELECT q.asked_scope, a.id, a.visibility, a.owner_scope_id FROM q, artifacts a JOIN scopes s ON s.id = a.owner_scope_id
WHERE status = 'published' AND ((visibility = 'project' AND owner_scope_id = asked_scope)
  OR (visibility IN ('team', 'department') AND (s.path = q.path OR starts_with(q.path, s.path || '.')))
  OR (visibility = 'company' AND s.kind = 'company')
  OR a.id IN (SELECT artifact_id FROM sharing g JOIN scopes gs ON gs.id = g.grantee_scope_id WHERE (gs.path = q.path OR starts_with(q.path, gs.path || '.')) AND (g.expires_at IS NULL OR g.expires_at > TIMESTAMP '{A.NOW}')))""")
def artifact_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every nation and region may see."""
    rows = A.artifacts(spark, sf_dir).where("status = 'published'")
    asked = A.scopes(spark, sf_dir).where("kind <> 'user'").select(F.col("id").alias("asked_scope"))
    found = S.visible(rows, A.scopes(spark, sf_dir), asked, A.sharing(spark, sf_dir), A.now())
    return found.select("asked_scope", "id", "visibility", "owner_scope_id")


@query("skill_recall", f"""WITH {A.SKILLS_SQL}, q AS (SELECT {_TRI.format("'large steel'")} AS b), c AS (SELECT *, {_TRI.format("name || ' ' || description")} AS a FROM skills, q WHERE status = 'published'),
s AS (SELECT id, 0.10 * {_JAC.format('a', 'b')} + 0.20 * least(invocation_count / 100.0::DOUBLE, 1.0) + 0.10 AS sc FROM c WHERE {_JAC.format('a', 'b')} > 0.1)
SELECT id, round(sc, 6) AS score FROM s ORDER BY sc DESC, id LIMIT 20""")
def skill_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.skills(spark, sf_dir).where("status = 'published'").withColumn("content", F.concat_ws(" ", "name", "description"))
    score = jac = T.jaccard(T.trigrams(F.col("content")), T.trigrams(F.lit("large steel")))
    found = rows.select("id", jac.alias("trigram"), "invocation_count").where(F.col("trigram") > R.TRIGRAM_CUT)
    score = R.W_TRIGRAM * F.col("trigram") + R.W_IMPORTANCE * F.least(F.col("invocation_count") / 100.0, F.lit(1.0)) + R.W_RECENCY
    return _rounded(R.best(found.select("id", score.alias("score")), 20), "score")


@query("skills_for_agent", f"WITH {A.SKILLS_SQL} SELECT id, name FROM skills WHERE status = 'published' AND (list_contains(agent_types, 'any') OR list_contains(agent_types, 'coder'))")
def skills_for_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.skills(spark, sf_dir).where("status = 'published' AND (array_contains(agent_types, 'any') OR array_contains(agent_types, 'coder'))").select("id", "name")


@query("promoted_dedup", f"""WITH {A.MEMORIES_SQL}, {A.ARTIFACTS_SQL} SELECT id, promoted_to FROM memories m WHERE is_active
AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.id = m.promoted_to AND a.status = 'published')""")
def promoted_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_promoted(_active(spark, sf_dir), A.artifacts(spark, sf_dir).where("status = 'published'")).select("id", "promoted_to")


@query("cross_layer_merge", f"""WITH {A.MEMORIES_SQL}, {_KFROM},
k AS (SELECT id, 'knowledge' AS layer, sc FROM s ORDER BY sc DESC, id LIMIT 20),
m AS (SELECT id, 'memory' AS layer, 0.20 * importance + 0.10 * exp(-({_RATE}) * {_DAYS.format('coalesce(last_accessed, created_at)')}) AS sc, promoted_to FROM memories WHERE is_active),
ml AS (SELECT * FROM m ORDER BY sc DESC, id LIMIT 20),
u AS (SELECT * FROM k UNION ALL SELECT id, layer, sc FROM ml WHERE promoted_to IS NULL OR promoted_to NOT IN (SELECT id FROM k))
SELECT id, layer, round(sc, 6) AS score FROM u WHERE sc >= 0.1 ORDER BY sc DESC, id, layer LIMIT 30""")
def cross_layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    knowledge = R.best(_knowledge(spark, sf_dir), 20)
    zero = {n: F.lit(0.0) for n in ("vector", "text", "trigram")}
    memory = R.best(_active(spark, sf_dir).withColumns(zero).withColumn("score", R.memory_score(A.now())).select("id", "score", "promoted_to"), 20)
    both = knowledge.select("id", F.lit("knowledge").alias("layer"), "score").unionByName(R.without_promoted(memory, knowledge).select("id", F.lit("memory").alias("layer"), "score"))
    return _rounded(both.where("score >= 0.1").orderBy(F.desc("score"), "id", "layer").limit(30), "score")


@query("cross_scope_context", f"""WITH {A.MEMORIES_SQL}, s AS (SELECT scope_id, id, 0.20 * importance + 0.10 * exp(-({_RATE}) * {_DAYS.format('coalesce(last_accessed, created_at)')}) AS sc
  FROM memories WHERE is_active AND scope_id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey < 3) AND created_at >= TIMESTAMP '2023-09-01'),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY sc DESC, id) AS place FROM s) SELECT scope_id, id, round(sc, 6) AS score FROM r WHERE place <= 5""")
def cross_scope_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over all compared scopes, strictly each, with a limit for every scope."""
    asked = read_table(spark, sf_dir, "nation").where("n_regionkey < 3").selectExpr("concat('n', n_nationkey) AS scope_id")
    zero = {n: F.lit(0.0) for n in ("vector", "text", "trigram")}
    rows = _active(spark, sf_dir).where("created_at >= timestamp'2023-09-01'").join(asked, "scope_id", "left_semi")
    return _rounded(R.best(rows.withColumns(zero).withColumn("score", R.memory_score(A.now())).select("scope_id", "id", "score"), 5, by=["scope_id"]), "score")


_KFULL = _KSCORE.replace("0.50 * 0 ", "0.50 * vector ").replace("0.10 * 0 ", "0.10 * trigram ")


@query("knowledge_recall_hybrid", f"""WITH {A.ARTIFACTS_SQL}, {A.VECTORS_SQL}, {_QVEC}, {_DIGEST},
a AS (SELECT * FROM artifacts WHERE status = 'published' AND coalesce(published_at, created_at) BETWEEN TIMESTAMP '2023-06-01' AND TIMESTAMP '{A.NOW}'),
q AS (SELECT {_WORDS.format("'" + QUESTION + "'")} AS terms, {_TRI.format("'" + QUESTION + "'")} AS tri),
v AS (SELECT a.id, {_COS} AS vector, NULL::DOUBLE AS text, NULL::DOUBLE AS trigram FROM a JOIN vectors ON a.id = vectors.id, qv ORDER BY vector DESC, id LIMIT 60),
w AS (SELECT id, {_WORDS.format('content')} AS ws, terms FROM a, q),
f AS (SELECT id, NULL::DOUBLE, len(list_filter(ws, lambda x: list_contains(terms, x))) / greatest(len(ws), 1)::DOUBLE AS text, NULL::DOUBLE FROM w WHERE list_has_all(ws, terms) ORDER BY text DESC, id LIMIT 60),
g AS (SELECT id, {_TRI.format('content')} AS t, tri FROM a, q),
t AS (SELECT id, NULL::DOUBLE, NULL::DOUBLE, {_JAC.format('t', 'tri')} AS s FROM g WHERE {_JAC.format('t', 'tri')} > 0.1 ORDER BY s DESC, id LIMIT 60),
c AS (SELECT id, coalesce(max(vector), 0) AS vector, coalesce(max(text), 0) AS text, coalesce(max(trigram), 0) AS trigram FROM (SELECT * FROM v UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t) GROUP BY id),
s AS (SELECT c.id, kind, {_KFULL} AS sc FROM c JOIN a ON c.id = a.id), r AS (SELECT * FROM s ORDER BY sc DESC, id LIMIT 30)
SELECT id, kind, round(sc, 6) AS score FROM r WHERE id NOT IN (SELECT source_id FROM digests WHERE digest_id IN (SELECT id FROM r))""")
def knowledge_recall_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published knowledge by all three signals, without the sources of digests among the results."""
    rows = A.artifacts(spark, sf_dir).where("status = 'published'").drop("content")
    found = R.recall_knowledge(
        rows, A.now(), QUESTION, _query_vector(spark, sf_dir), [A.vectors(spark, sf_dir)], _index(spark, sf_dir, "simple"), _index(spark, sf_dir, "trigram"), _digests(spark, sf_dir), 30,
        F.lit("2023-06-01").cast("timestamp"), A.now(),
    )
    return _rounded(found, "score")


_SIGNAL = "SELECT layer, scope_id, id, {0} AS vector, {1} AS text, {2} AS trigram FROM ({3}) WHERE k <= 10"


@query("cross_scope_layers", f"""WITH {A.MEMORIES_SQL}, {A.ARTIFACTS_SQL}, {A.VECTORS_SQL}, {_QVEC}, asked AS (SELECT 'n' || n_nationkey AS scope_id, n_nationkey AS k FROM nation WHERE n_regionkey < 3),
m AS (SELECT memories.* FROM memories JOIN asked USING (scope_id) WHERE is_active AND created_at >= TIMESTAMP '2023-09-01' AND k % 5 <> 1 AND k % 7 <> 3),
a AS (SELECT artifacts.*, scope_id FROM artifacts JOIN asked ON owner_scope_id = scope_id WHERE status = 'published' AND coalesce(published_at, created_at) >= TIMESTAMP '2023-09-01' AND k % 4 <> 2 AND k % 7 <> 3),
r AS (SELECT 'memory' AS layer, scope_id, id, content FROM m UNION ALL SELECT 'knowledge', scope_id, id, content FROM a),
q AS (SELECT {_WORDS.format("'" + QUESTION + "'")} AS terms, {_TRI.format("'" + QUESTION + "'")} AS tri),
v AS (SELECT layer, scope_id, r.id, {_COS} AS s, row_number() OVER (PARTITION BY layer, scope_id ORDER BY {_COS} DESC, r.id) AS k FROM r JOIN vectors ON vectors.id = r.id, qv),
w AS (SELECT layer, scope_id, id, {_WORDS.format('content')} AS ws, terms FROM r, q), x AS (SELECT layer, scope_id, id, len(list_filter(ws, lambda x: list_contains(terms, x))) / greatest(len(ws), 1)::DOUBLE AS s FROM w WHERE list_has_all(ws, terms)),
f AS (SELECT *, row_number() OVER (PARTITION BY layer, scope_id ORDER BY s DESC, id) AS k FROM x),
g AS (SELECT layer, scope_id, id, {_TRI.format('content')} AS t, tri FROM r, q), y AS (SELECT layer, scope_id, id, {_JAC.format('t', 'tri')} AS s FROM g WHERE {_JAC.format('t', 'tri')} > 0.1),
t AS (SELECT *, row_number() OVER (PARTITION BY layer, scope_id ORDER BY s DESC, id) AS k FROM y),
c AS (SELECT layer, scope_id, id, coalesce(max(vector), 0) AS vector, coalesce(max(text), 0) AS text, coalesce(max(trigram), 0) AS trigram FROM (
  {_SIGNAL.format('s', 'NULL::DOUBLE', 'NULL::DOUBLE', 'SELECT * FROM v')} UNION ALL {_SIGNAL.format('NULL::DOUBLE', 's', 'NULL::DOUBLE', 'SELECT * FROM f')} UNION ALL {_SIGNAL.format('NULL::DOUBLE', 'NULL::DOUBLE', 's', 'SELECT * FROM t')}) GROUP BY ALL),
ks AS (SELECT c.scope_id, c.id, {_KFULL} AS sc FROM c JOIN a ON a.id = c.id AND a.scope_id = c.scope_id WHERE layer = 'knowledge'), kl AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY sc DESC, id) AS place FROM ks),
ms AS (SELECT c.scope_id, c.id, promoted_to, {_MSCORE} AS sc FROM c JOIN m ON m.id = c.id AND m.scope_id = c.scope_id WHERE layer = 'memory'), ml AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY sc DESC, id) AS place FROM ms),
u AS (SELECT scope_id, 'knowledge' AS layer, id, sc FROM kl WHERE place <= 5
  UNION ALL SELECT scope_id, 'memory', id, sc FROM ml WHERE place <= 5 AND NOT EXISTS (SELECT 1 FROM kl WHERE kl.place <= 5 AND kl.scope_id = ml.scope_id AND kl.id = ml.promoted_to)),
p AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY sc DESC, layer, id) AS place FROM u)
SELECT scope_id, layer, id, round(sc, 6) AS score, NULL AS reason FROM p WHERE place <= 5
UNION ALL SELECT scope_id, 'memory', NULL, NULL, 'forbidden' FROM asked WHERE k % 5 = 1 OR k % 7 = 3 UNION ALL SELECT scope_id, 'knowledge', NULL, NULL, 'forbidden' FROM asked WHERE k % 4 = 2 OR k % 7 = 3""")
def cross_scope_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen nations compared in memories and knowledge; some layers of some are forbidden."""
    nation = read_table(spark, sf_dir, "nation").where("n_regionkey < 3").selectExpr("concat('n', n_nationkey) AS scope_id", "n_nationkey AS k")
    granted = nation.where("k % 5 <> 1 AND k % 7 <> 3").selectExpr("scope_id", "'memory' AS layer").unionByName(nation.where("k % 4 <> 2 AND k % 7 <> 3").selectExpr("scope_id", "'knowledge' AS layer"))
    found, skipped = R.cross_scope_context(
        nation, granted, _active(spark, sf_dir).drop("content"), A.artifacts(spark, sf_dir).where("status = 'published'").drop("content"), A.now(), QUESTION, _query_vector(spark, sf_dir), A.vectors(spark, sf_dir),
        _index(spark, sf_dir, "simple"), _index(spark, sf_dir, "trigram"), 5, F.lit("2023-09-01").cast("timestamp"),
    )
    none = skipped.select("scope_id", "layer", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), "reason")
    return _rounded(found.withColumn("reason", F.lit(None).cast("string")).unionByName(none), "score")


_PACKED = f"""{A.MEMORIES_SQL}, {_KFROM},
u AS (SELECT id, 0 AS layer, sc FROM (SELECT * FROM s ORDER BY sc DESC, id LIMIT 20) UNION ALL (SELECT id, 1, importance FROM memories WHERE is_active ORDER BY importance DESC, id LIMIT 20)),
b AS (SELECT u.id, layer, CASE WHEN layer = 0 AND length(a.summary) > 0 THEN a.summary ELSE coalesce(text, '') END AS content, a.summary, coalesce(text, '') AS body, row_number() OVER (ORDER BY layer, sc DESC, u.id) AS place
  FROM u JOIN documents ON doc_id = u.id LEFT JOIN artifacts a ON a.id = u.id AND layer = 0)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What knowledge and memory recall gave, with the score negated so that blocks sort as they are packed."""
    knowledge = R.best(_knowledge(spark, sf_dir), 20).select("id", F.lit(0).alias("layer"), "score")
    memory = R.best(_active(spark, sf_dir).select("id", F.col("importance").alias("score")), 20).select("id", F.lit(1).alias("layer"), "score")
    found = F.broadcast(knowledge.unionByName(memory))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body")).join(found, "id")
    summaries = A.artifacts(spark, sf_dir).select("id", "summary", F.lit(0).alias("layer"))
    return docs.join(summaries, ["id", "layer"], "left").withColumn("rank", -F.col("score"))


@query("context_pack", f"""WITH RECURSIVE {_PACKED}, t AS (SELECT id, layer, place, strlen(body) // 4 AS tokens FROM b),
fold AS (SELECT place, id, layer, CASE WHEN tokens <= 8000 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 8000 THEN tokens ELSE 0 END AS running, tokens <= 8000 AS taken FROM t WHERE place = 1
  UNION ALL SELECT t.place, t.id, t.layer, CASE WHEN running + tokens <= 8000 THEN tokens ELSE 0 END, running + CASE WHEN running + tokens <= 8000 THEN tokens ELSE 0 END, running + tokens <= 8000 FROM fold JOIN t ON t.place = fold.place + 1)
SELECT id, CAST(layer AS INT) AS layer, CAST(used AS BIGINT) AS tokens, CAST(place AS BIGINT) AS place, CAST(running AS BIGINT) AS running, taken FROM fold""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("tokens", T.estimated_tokens(F.col("body")))
    return R.pack(rows, 8000, ["layer", "rank", "id"], ["id", "layer"])


_LEAD = "CASE WHEN regexp_matches(substring({0}, 1, 120), '[.\n]') THEN regexp_extract(substring({0}, 1, 120), '^([^.\n]*[.]?)', 1) WHEN length({0}) <= 120 THEN {0} ELSE substring({0}, 1, 120) || '…' END"


@query("context_pack_stubs", f"""WITH RECURSIVE {_PACKED},
t AS (SELECT id, layer, place, strlen(content) // 4 AS tokens, strlen(CASE WHEN layer = 0 AND length(summary) > 0 THEN summary ELSE {_LEAD.format("body")} END) // 4 AS stub FROM b),
fold AS (SELECT place, id, layer, CASE WHEN tokens <= 300 THEN tokens ELSE stub END AS used, CASE WHEN tokens <= 300 THEN tokens ELSE stub END AS running, tokens > 300 AS stubbed FROM t WHERE place = 1
  UNION ALL SELECT t.place, t.id, t.layer, CASE WHEN running + tokens <= 300 THEN tokens ELSE stub END, running + CASE WHEN running + tokens <= 300 THEN tokens ELSE stub END, running + tokens > 300 FROM fold JOIN t ON t.place = fold.place + 1)
SELECT id, CAST(layer AS INT) AS layer, CAST(used AS BIGINT) AS tokens, CAST(place AS BIGINT) AS place, CAST(running AS BIGINT) AS running, stubbed FROM fold""")
def context_pack_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir)
    short = (F.col("layer") == 0) & (F.length("summary") > 0)
    content = F.when(short, F.col("summary")).otherwise(F.col("body"))
    stub = F.when(short, F.col("summary")).otherwise(T.lead(F.col("body")))
    rows = rows.withColumns({"tokens": T.estimated_tokens(content), "stub_tokens": T.estimated_tokens(stub)})
    return R.pack_with_stubs(rows, 300, ["layer", "rank", "id"], ["id", "layer"])


@query("orchestrated_recall", f"""WITH {A.MEMORIES_SQL}, {A.VECTORS_SQL}, {_QVEC}, {_KFROM}, {A.SKILLS_SQL},
k AS (SELECT id, sc FROM s ORDER BY sc DESC, id LIMIT 10),
mv AS (SELECT m.*, {_COS} AS vector, 0.0 AS text, 0.0 AS trigram FROM memories m JOIN vectors ON vectors.id = m.id, qv WHERE is_active ORDER BY vector DESC, m.id LIMIT 20),
mm AS (SELECT id, promoted_to, content, {_MSCORE} AS sc FROM mv ORDER BY sc DESC, id LIMIT 10),
g AS (SELECT sk.*, {_TRI.format("name || ' ' || description")} AS a, {_TRI.format("'large steel'")} AS b FROM skills sk WHERE status = 'published' AND (list_contains(agent_types, 'any') OR list_contains(agent_types, 'coder'))),
sv AS (SELECT g.id, {_COS} AS v, NULL::DOUBLE AS f, NULL::DOUBLE AS t FROM g JOIN vectors ON vectors.id = g.id, qv ORDER BY v DESC, g.id LIMIT 20),
sf AS (SELECT id, NULL::DOUBLE AS v, len(list_filter(ws, lambda x: list_contains(['large', 'steel'], x))) / greatest(len(ws), 1)::DOUBLE AS f, NULL::DOUBLE AS t FROM (SELECT id, {_WORDS.format("name || ' ' || description")} AS ws FROM g) WHERE list_has_all(ws, ['large', 'steel']) ORDER BY f DESC, id LIMIT 20),
st AS (SELECT id, NULL::DOUBLE AS v, NULL::DOUBLE AS f, {_JAC.format('a', 'b')} AS t FROM g WHERE {_JAC.format('a', 'b')} > 0.1 ORDER BY t DESC, id LIMIT 20),
sm AS (SELECT id, coalesce(max(v), 0) AS v, coalesce(max(f), 0) AS f, coalesce(max(t), 0) AS t FROM (SELECT * FROM sv UNION ALL SELECT * FROM sf UNION ALL SELECT * FROM st) GROUP BY id),
ss AS (SELECT id, name || ' ' || description AS content, 0.50 * v + 0.10 * f + 0.10 * t + 0.20 * least(invocation_count / 100.0::DOUBLE, 1.0) + 0.10 AS sc FROM sm JOIN g USING (id) ORDER BY sc DESC, id LIMIT 10),
u AS (SELECT 'knowledge' AS layer, k.id, sc, CASE WHEN length(summary) > 0 THEN summary ELSE content END AS content, coalesce(length(summary) > 0, FALSE) AS full_content_available FROM k JOIN artifacts ON artifacts.id = k.id
  UNION ALL SELECT 'memory', id, sc, content, FALSE FROM mm WHERE promoted_to IS NULL OR promoted_to NOT IN (SELECT id FROM k)
  UNION ALL SELECT 'skill', id, sc, content, FALSE FROM ss)
SELECT layer, id, round(sc, 6) AS score, md5(content) AS content_hash, full_content_available FROM u WHERE sc >= 0.1 ORDER BY sc DESC, layer, id LIMIT 20""")
def orchestrated_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories, knowledge with summaries, and skills for one question, without memories that became knowledge."""
    vectors, question = A.vectors(spark, sf_dir), _query_vector(spark, sf_dir)
    memories = R.recall_memories(_active(spark, sf_dir), A.now(), "", question, [vectors], mode="text").select("id", "score").join(_active(spark, sf_dir).select("id", "content", "promoted_to"), "id")
    knowledge = R.best(_knowledge(spark, sf_dir), 10).select("id", "score").join(A.artifacts(spark, sf_dir).select("id", "content", "summary"), "id")
    rows = A.skills(spark, sf_dir).withColumn("content", F.concat_ws(" ", "name", "description"))
    skills = R.recall_skills(rows, "large steel", question, [vectors], agent="coder", limit=10).join(rows.select("id", "content"), "id")
    found = R.combine_layers(memories, knowledge, skills, 20, min_score=0.1)
    return _rounded(found.select("layer", "id", "score", F.md5("content").alias("content_hash"), "full_content_available"), "score")
