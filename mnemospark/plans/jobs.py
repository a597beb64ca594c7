"""Registered queries: near-duplicates, consolidation and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import adapters as A
from mnemospark.operators import dedup as D
from mnemospark.operators import jobs as J
from mnemospark.plans.registry import query
from mnemospark.session import read_table

_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"
_DAYS = f"(epoch(TIMESTAMP '{A.NOW}') - epoch({{0}})) / 86400.0"
_RATE = "CASE memory_type WHEN 'working' THEN 0.015 WHEN 'episodic' THEN 0.010 ELSE 0.005 END"
_PAIRS = f"e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), pairs AS (SELECT a.id AS a, b.id AS b, 1 - {_COS.format('a.v', 'b.v')} AS distance FROM e a JOIN e b ON a.label = b.label AND a.id < b.id)"


def _pairs(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    return D.near_pairs(rows, threshold, ["label"])


@query("near_duplicates", f"WITH {_PAIRS} SELECT a, b, round(distance, 6) AS distance FROM pairs WHERE distance <= 0.7")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 0.7).withColumn("distance", F.round("distance", 6))


_CLUSTERS = f"WITH RECURSIVE {_PAIRS}, link AS (SELECT a, b FROM pairs WHERE distance <= 0.65 UNION SELECT b, a FROM pairs WHERE distance <= 0.65), walk AS (SELECT a AS id, a AS other FROM link UNION SELECT w.id, l.b FROM walk w JOIN link l ON l.a = w.other), clu AS (SELECT id, min(other) AS cluster FROM walk GROUP BY id)"


@query("duplicate_clusters", f"{_CLUSTERS} SELECT id, cluster FROM clu")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clusters(_pairs(spark, sf_dir, 0.65))


@query("merge_clusters", f"""{_CLUSTERS}, {A.MEMORIES_SQL}, m AS (SELECT cluster, memories.id, content, CAST((row_number() OVER (PARTITION BY cluster ORDER BY memories.id) - 1) // {D.LISTED} AS INT) AS part,
  count(*) OVER (PARTITION BY cluster) AS sources, max(importance) OVER (PARTITION BY cluster) AS importance FROM clu JOIN memories ON memories.id = clu.id)
SELECT cluster, part, sources, importance, md5(string_agg(content, chr(10) || chr(10) ORDER BY id)) AS content_hash FROM m GROUP BY cluster, part, sources, importance""")
def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = D.clusters(_pairs(spark, sf_dir, 0.65)).join(A.memories(spark, sf_dir), "id").select("cluster", "id", "importance", "content")
    return D.merge_clusters(members).select("cluster", "part", "sources", "importance", F.md5("content").alias("content_hash"))


@query("consolidation_run", f"""{_CLUSTERS}, {A.MEMORIES_SQL}, m AS (SELECT scope_id, cluster, clu.id FROM clu JOIN memories ON memories.id = clu.id),
n AS (SELECT scope_id, cluster, row_number() OVER (PARTITION BY scope_id ORDER BY count(*) DESC, cluster) AS place FROM m GROUP BY scope_id, cluster)
SELECT scope_id, cluster, id FROM m JOIN n USING (scope_id, cluster) WHERE place <= 10""")
def consolidation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one run of the job takes on: ten clusters of every scope."""
    return D.first_clusters(D.clusters(_pairs(spark, sf_dir, 0.65)), A.memories(spark, sf_dir), 10)


@query("merged_sources", f"""{_CLUSTERS}, {A.MEMORIES_SQL} SELECT id, is_active AND id NOT IN (SELECT id FROM clu) AS is_active FROM memories""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of merged memories become inactive."""
    after, _ = D.merge_job(A.memories(spark, sf_dir), D.clusters(_pairs(spark, sf_dir, 0.65)))
    return after.select("id", "is_active")


@query("merge_audit", f"""{_CLUSTERS}, {A.MEMORIES_SQL} SELECT id AS source_id, cluster AS result, 'merge' AS strategy FROM clu""")
def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge_job(A.memories(spark, sf_dir), D.clusters(_pairs(spark, sf_dir, 0.65)))[1]


@query("mean_vectors", "SELECT label, i - 1 AS at, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return D.mean_vectors(rows, ["label"]).select("label", F.posexplode("vec").alias("at", "x")).select("label", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


@query("consolidation_candidates", f"WITH {A.MEMORIES_SQL} SELECT id, scope_id FROM memories WHERE is_active AND importance < 0.7 AND access_count < 3")
def consolidation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.consolidation_candidates(A.memories(spark, sf_dir)).select("id", "scope_id")


@query("expire_ttl", f"WITH {A.MEMORIES_SQL} SELECT id, is_active AND NOT coalesce(expires_at < TIMESTAMP '{A.NOW}', false) AS is_active FROM memories")
def expire_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.expire(A.memories(spark, sf_dir), A.now()).select("id", "is_active")


@query("decay_step", f"WITH {A.MEMORIES_SQL} SELECT id, round(greatest(0, importance * exp(-({_RATE}) * {_DAYS.format('coalesce(last_accessed, created_at)')})), 6) AS importance FROM memories WHERE is_active")
def decay_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.decay_step(A.memories(spark, sf_dir).where("is_active"), A.now()).select("id", F.round("importance", 6).alias("importance"))


@query("prune_low_value", f"WITH {A.MEMORIES_SQL} SELECT id FROM memories WHERE is_active AND importance < 0.3 AND access_count < 8 AND memory_type IN ('episodic', 'working')")
def prune_low_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = A.memories(spark, sf_dir).where("is_active")
    return J.prune(active, 0.3, 8).where("NOT is_active").select("id")


@query("stale_low_access", f"""WITH {A.ARTIFACTS_SQL} SELECT id AS artifact_id, 'low_access_age' AS signal, CAST(0.3 AS DOUBLE) AS confidence, '{{"days":' || CAST(floor({_DAYS.format('last_accessed')}) AS BIGINT) || '}}' AS evidence
FROM artifacts WHERE status = 'published' AND {_DAYS.format('created_at')} > 180 AND {_DAYS.format('last_accessed')} > 60 AND id % 13 <> 0""")
def stale_low_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth artifact has an open flag already."""
    rows = A.artifacts(spark, sf_dir)
    return J.stale_artifacts(rows, rows.where("id % 13 = 0").select(F.col("id").alias("artifact_id")), A.now())


@query("contradictions", f"""WITH e AS (SELECT vec_id AS id, label AS block, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT v AS q FROM e WHERE id = 1),
s AS (SELECT a.id AS artifact_id, m.id AS memory_id, {_COS.format('a.v', 'm.v')} AS sim FROM e a JOIN e m ON a.block = m.block AND a.id <> m.id, n WHERE {_COS.format('m.v', 'q')} > 0.05)
SELECT artifact_id, min(memory_id) AS memory_id, round(least(0.9, 1.5 * min_by(sim, memory_id)), 6) AS confidence FROM s WHERE sim > 0.2 GROUP BY artifact_id""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").cast("array<double>").alias("vec"), F.lit("").alias("content"))
    negation = rows.where("id = 1").select(F.col("vec").alias("q"))
    return J.contradictions(rows, rows, 0.2, negation, 0.05).withColumn("confidence", F.round("confidence", 6))


@query("flag_digests", f"""WITH {A.ARTIFACTS_SQL}, links AS (SELECT d.id AS digest_id, s.id AS source_id FROM artifacts d JOIN artifacts s ON s.id IN (d.id + 3, d.id + 6, d.id + 9) WHERE d.artifact_kind = 'digest')
SELECT digest_id AS artifact_id, CAST(max(CASE WHEN source_id % 9 = 0 THEN 1.0 ELSE 0.9 END) AS DOUBLE) AS confidence FROM links WHERE source_id % 4 = 1 AND digest_id % 60 <> 0 GROUP BY digest_id""")
def flag_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.artifacts(spark, sf_dir)
    links = rows.where("artifact_kind = 'digest'").selectExpr("id AS digest_id", "explode(array(id + 3, id + 6, id + 9)) AS source_id").join(rows.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    changed = rows.where("id % 4 = 1").selectExpr("id AS source_id", "CASE WHEN id % 9 = 0 THEN 'deleted' ELSE 'modified' END AS change")
    return J.flag_digests(links, changed, rows.where("id % 60 = 0").select(F.col("id").alias("artifact_id")))


@query("pending_embeddings", """SELECT d.doc_id AS id, CAST(length(coalesce(d.text, '')) AS BIGINT) AS n FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL""")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return docs.join(done, "id", "left_anti")


@query("register_model", """SELECT 'document' AS object_type, doc_id AS object_id, 'model-2' AS model_id, 'pending' AS status FROM documents
UNION ALL SELECT 'skill', p_partkey, 'model-2', 'pending' FROM part UNION ALL SELECT 'conversation', conv_id, 'model-2', 'pending' FROM (SELECT DISTINCT conv_id FROM conversations)""")
def register_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new model's index: every object of every kind is pending."""
    kinds = (("document", "documents", "doc_id"), ("skill", "part", "p_partkey"), ("conversation", "conversations", "conv_id"))
    parts = [read_table(spark, sf_dir, t).select(F.lit(k).alias("object_type"), F.col(c).cast("long").alias("object_id")).distinct() for k, t, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns({"model_id": F.lit("model-2"), "status": F.lit("pending")})


@query("unchunked", f"WITH {A.MEMORIES_SQL} SELECT id FROM memories WHERE is_active AND length(content) > 2000 AND id NOT IN (SELECT DISTINCT conv_id FROM conversations) AND promoted_to IS NULL")
def unchunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long memories without chunks; conversations stand for the memories that have some."""
    have = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return A.memories(spark, sf_dir).where("is_active AND length(content) > 2000 AND promoted_to IS NULL").join(have, "id", "left_anti").select("id")


@query("stale_promotions", f"WITH {A.MEMORIES_SQL} SELECT id FROM memories WHERE promotion_status = 'nominated' AND created_at < TIMESTAMP '{A.NOW}' - INTERVAL 24 HOURS")
def stale_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.memories(spark, sf_dir).where((F.col("promotion_status") == "nominated") & (F.col("created_at") < A.now() - F.expr("INTERVAL 24 HOURS"))).select("id")
