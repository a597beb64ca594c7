"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, then the source mix.

Each stage reads what its predecessor wrote and works on all of it.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm.decontaminate import drop_contaminated
from mnemospark.llm.mixture import take_mixture
from mnemospark.llm.secrets import append_ledger, read_ledger, redact_with_ledger
from mnemospark.llm.simhash import drop_near_duplicates
from mnemospark.llm.toxicity import drop_toxic, fit_toxicity
from mnemospark.session import ensure_checkpoint_dir, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model is fitted on the labelled documents that are not held out."""
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), short_items=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become marks.

    Where ``spark.mnemospark.secrets.ledger`` names a folder, only versions that the ledger there lacks are
    scanned, and what this scan learns is appended to it.
    """
    folder = spark.conf.get("spark.mnemospark.secrets.ledger", None)
    redacted, new = redact_with_ledger(docs, read_ledger(spark, folder))
    append_ledger(new, folder)
    return redacted


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many of their words it takes (repeats counted)."""
    return take_mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: SQL cannot express the classifier and the component search; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet and read again, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{at}-{name}")
        docs = spark.read.parquet(f"{root}/{at}-{name}")
    return docs
