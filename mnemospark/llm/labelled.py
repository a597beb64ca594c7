"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5; such rows never train a model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows (text, y) of at most ``per_class`` labelled documents of each class, none of them held out.

    The ids are the first by hash, chosen from the labels alone; only their texts are read on.
    Labels other than 0 and 1, null ids and ids that ``docs`` lacks give no row; of an id that repeats
    with two labels the larger counts, with several texts the smallest. Empty tables give none.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.where("y = 1").orderBy(order).limit(per_class).unionByName(known.where("y = 0").orderBy(order).limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return spread(rows.select("doc_id", "text", "y"), "doc_id")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all cores by a hash of ``key``: they are few, but each is much work."""
    return rows.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism), key)
