"""Query registrations of this package: thin callables over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate, divergence, html, mixture, negatives, neighbours, pieces, pii, quality, secrets, toxicity, urls
from mnemospark.llm.simhash import simhash_components
from mnemospark.session import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), short_items=True)
    return found.select("doc_id", "item_id", "matched_words", "item_words", "coverage")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan_documents(read_table(spark, sf_dir, "documents"))
    return secrets.digest(findings)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.digest(pii.find_pii(docs, pii.fit_pii(docs)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html.extract_pages(pages, html.fit_pages(pages))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.encode_documents(read_table(spark, sf_dir, "documents"), model))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_toxicity": op2_toxicity,
        "op3_secrets": op3_secrets,
        "op4_quality": op4_quality,
        "op5_pii": op5_pii,
        "op6_simhash": op6_simhash,
        "op7_neighbours": op7_neighbours,
        "op8_urls": op8_urls,
        "op9_mixture": op9_mixture,
        "op10_html": op10_html,
        "op11_pieces": op11_pieces,
        "op12_divergence": op12_divergence,
        "op13_negatives": op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secrets": secrets.oracle_sql(),
        "op8_urls": urls.oracle_sql(),
        "op9_mixture": mixture.ORACLE.format(docs="documents"),
        "op12_divergence": divergence.ORACLE,
        "op13_negatives": negatives.ORACLE,
    }
