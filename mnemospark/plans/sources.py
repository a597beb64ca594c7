"""Registered queries: listings and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.payloads import parsed_embeddings
from mnemospark.operators.codeindex import scanned, update_index
from mnemospark.plans.registry import query
from mnemospark.session import read_table
from mnemospark.sources.ingest import changed_files
from mnemospark.sources.tree import tree_diff, tree_nodes


@query("changed_files", """WITH a AS (SELECT page_id AS path, html AS c FROM pages WHERE page_id % 10 <> 1), b AS (SELECT page_id AS path, CASE WHEN page_id % 10 = 2 THEN html || 'x' ELSE html END AS c FROM pages WHERE page_id % 10 <> 3)
SELECT CAST(coalesce(a.path, b.path) AS VARCHAR) AS path, CASE WHEN a.path IS NULL THEN 'insert' WHEN b.path IS NULL THEN 'delete' ELSE 'modify' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.c IS DISTINCT FROM b.c""")
def pages_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of two commits: some are new, some gone, some changed."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), "page_id", "html")
    before = pages.where("page_id % 10 <> 1").select("path", F.col("html").alias("content"))
    after = pages.where("page_id % 10 <> 3").select("path", F.when(F.col("page_id") % 10 == 2, F.concat("html", F.lit("x"))).otherwise(F.col("html")).alias("content"))
    return changed_files(before, after)


@query("tree_changed", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '') || '/' || page_id AS path, html FROM pages),
a AS (SELECT path, html AS c FROM p WHERE page_id % 100 <> 1), b AS (SELECT path, CASE WHEN page_id % 100 = 2 THEN html || 'x' ELSE html END AS c FROM p WHERE page_id % 100 <> 3)
SELECT regexp_replace(regexp_replace(coalesce(a.path, b.path), '/+', '/', 'g'), '^/', '') AS path, CASE WHEN a.path IS NULL THEN 'insert' WHEN b.path IS NULL THEN 'delete' ELSE 'modify' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.c IS DISTINCT FROM b.c""")
def tree_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of two commits, in the folders of their addresses, compared as trees of digests."""
    pages = read_table(spark, sf_dir, "pages")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", ""), F.lit("/"), F.col("page_id").cast("string"))
    rows = pages.select("page_id", path.alias("path"), "html")
    before = rows.where("page_id % 100 <> 1").select("path", F.md5("html").alias("digest"))
    after = rows.where("page_id % 100 <> 3").select("path", F.md5(F.when(F.col("page_id") % 100 == 2, F.concat("html", F.lit("x"))).otherwise(F.col("html"))).alias("digest"))
    return tree_diff(tree_nodes(before), tree_nodes(after))[0]


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, content): the first script of every page as a source file."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1).alias("content"))


_SCRIPTS_SQL = "s AS (SELECT page_id, 'p' || page_id || '.js' AS path, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS content FROM pages)"


@query("page_script_edges", rf"""WITH {_SCRIPTS_SQL}
SELECT DISTINCT path, path AS subject, 'defines' AS predicate, 'p' || page_id || '.' || unnest(regexp_extract_all(content, 'var ([a-z]+)', 1)) AS object FROM s
UNION ALL SELECT DISTINCT path, path, 'calls', unnest(regexp_extract_all(content, '([a-z]+)[(]', 1)) FROM s""")
def page_script_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scripts of pages define and call."""
    found = scanned(_scripts(spark, sf_dir).select("path", "content")).where("predicate is not null")
    return found.select("path", F.col("name").alias("subject"), "predicate", F.col("target").alias("object"))


@query("code_index_update", rf"""WITH {_SCRIPTS_SQL}
SELECT path, 'replaced' AS what, '' AS source_ref, '' AS content_hash FROM s WHERE page_id % 10 IN (2, 3)
UNION ALL SELECT path, 'memory', 'file:' || path, md5(content) FROM s WHERE page_id % 10 IN (1, 2)
UNION ALL SELECT path, 'entity', 'file', md5(path) FROM s WHERE page_id % 10 IN (1, 2)
UNION ALL SELECT path, 'entity', 'variable', md5(n) FROM (SELECT DISTINCT path, 'p' || page_id || '.' || unnest(regexp_extract_all(content, 'var ([a-z]+)', 1)) AS n FROM s WHERE page_id % 10 IN (1, 2))""")
def code_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index run over page scripts after an earlier one, since when some are new, some changed, some gone."""
    rows = _scripts(spark, sf_dir)
    earlier = F.sha2(F.when(F.col("page_id") % 10 == 2, F.concat("content", F.lit("x"))).otherwise(F.col("content")).cast("binary"), 256)
    run = update_index(rows.where("page_id % 10 <> 3").select("path", "content"), rows.where("page_id % 10 <> 1").select("path", earlier.alias("digest")))
    none = F.lit("")
    out = run.replaced.select("path", F.lit("replaced").alias("what"), none.alias("source_ref"), none.alias("content_hash"))
    out = out.unionByName(run.memories.select("path", F.lit("memory").alias("what"), "source_ref", F.md5("content").alias("content_hash")))
    return out.unionByName(run.entities.select("path", F.lit("entity").alias("what"), F.col("entity_type").alias("source_ref"), F.md5("canonical").alias("content_hash")))


@query("embedding_payloads", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 6 = 3 THEN 2 ELSE 1 END AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS at, round(k * unnest(e), 5) + 0.0 AS value, NULL AS error FROM v WHERE vec_id % 6 <> 5
UNION ALL SELECT vec_id, NULL, NULL, '{"error":"quota of ' || vec_id || '"}' FROM v WHERE vec_id % 6 = 5""")
def embedding_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as services send them, in five shapes and as an error, and read back."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    plain = F.to_json("e")
    forms = [
        F.concat(F.lit('{"object":"list","data":[{"index":0,"embedding":'), plain, F.lit("}]}")),
        F.concat(F.lit('[{"embedding":['), plain, F.lit("]}]")),
        F.concat(F.lit('{"data":[{"index":0,"embedding":'), F.to_json(F.transform("e", lambda x: F.array(x))), F.lit("}]}")),
        F.concat(F.lit('{"data":[{"index":0,"embedding":'), F.to_json(F.array(F.col("e"), F.transform("e", lambda x: 3 * x))), F.lit("}]}")),
        plain,
        F.concat(F.lit('{"error":"quota of '), F.col("vec_id").cast("string"), F.lit('"}')),
    ]
    body = F.coalesce(*[F.when(F.col("vec_id") % 6 == k, f) for k, f in enumerate(forms)])
    found = rows.select("vec_id", parsed_embeddings(body, F.lit(1)).alias("p"))
    good = found.where("p.error is null").select("vec_id", F.posexplode(F.get("p.vectors", F.lit(0))).alias("at", "value"), F.lit(None).cast("string").alias("error"))
    bad = found.where("p.error is not null").select("vec_id", F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("value"), F.col("p.error").alias("error"))
    return good.withColumn("value", F.round("value", 5) + 0.0).unionByName(bad)
