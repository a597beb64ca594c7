"""Near-duplicates of memories, their clusters, and merging a cluster into one memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.angular import angular_pairs
from mnemospark.operators.components import connected_components
from mnemospark.session import checkpointed

#: Rows of a part, about; two parts make a tile, which one task compares.
PART = 512
#: More than what a distance and its cosine lose to rounding.
ROUNDING = 1e-12


def near_pairs(rows: DataFrame, threshold: float, block: list[str]) -> DataFrame:
    """(a, b, distance): pairs of ``rows (id, vec, *block)`` of one block within a cosine distance, smaller id first; by parts that pivots leave (see ``angular``)."""
    found = angular_pairs(rows, None, 1 - threshold - ROUNDING, block, PART)
    return found.select("a", "b", (1 - F.col("cosine")).alias("distance")).where(F.col("distance") <= threshold)


def similar_pairs(left: DataFrame, right: DataFrame, least: float, block: list[str]) -> DataFrame:
    """(a, b, similarity): pairs of a row of ``left`` and one of ``right``, both (id, vec, *block), of one block and above a cosine; by parts as above."""
    return angular_pairs(left, right, least, block, PART, inclusive=False).withColumnRenamed("cosine", "similarity")


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): members of every group that pairs connect; the cluster is its smallest id."""
    return connected_components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def first_clusters(members: DataFrame, scopes: DataFrame, most: int = 10) -> DataFrame:
    """(scope_id, cluster, id): per scope the ``most`` largest clusters of ``members (id, cluster)``, ties to the smaller one: what one run of the job takes on."""
    rows = members.join(scopes.select("id", "scope_id"), "id")
    sized = rows.groupBy("scope_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("n"), "cluster"))
    return rows.join(sized.withColumn("_place", place).where(F.col("_place") <= most).select("scope_id", "cluster"), ["scope_id", "cluster"]).select("scope_id", "cluster", "id")


def consolidation_candidates(memories: DataFrame) -> DataFrame:
    return memories.where("is_active AND importance < 0.7 AND access_count < 3")


#: Members of a merged memory that one row lists; further ones follow in further rows.
LISTED = 1000


def merge_clusters(members: DataFrame) -> DataFrame:
    """(cluster, part, sources, importance, content): the memory that a cluster of ``members (cluster, id, importance, content)`` becomes.

    A merged text of more than ``LISTED`` members continues in further parts, so that no row and no task holds a whole large cluster;
    ``sources`` and ``importance`` are those of the whole cluster.
    """
    total = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sources"), F.max("importance").alias("importance"))
    placed = numbered(members.select("cluster", "id", "content"), "cluster", "id").withColumn("part", F.floor((F.col("place") - 1) / LISTED).cast("int"))
    each = F.sort_array(F.collect_list(F.struct("place", "content")))
    text = placed.groupBy("cluster", "part").agg(F.array_join(F.transform(each, lambda x: x.content), "\n\n").alias("content"))
    return text.join(total, "cluster").select("cluster", "part", "sources", "importance", "content")


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with ``place``, their number from 1 within a group by ``order``; a group of any size is numbered over many tasks.

    Rows are range-partitioned by group and order; a task numbers its own, and adds how many of the group earlier tasks hold.
    """
    dealt = rows.repartitionByRange(F.col(group), F.col(order)).withColumn("_pid", F.spark_partition_id())
    dealt = checkpointed(dealt)
    here = F.row_number().over(Window.partitionBy("_pid", group).orderBy(order))
    counts = dealt.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.withColumn("_here", here).join(before.drop("_n"), [group, "_pid"]).withColumn("place", F.col("_here") + F.col("_before")).drop("_pid", "_here", "_before")


def merge_job(memories: DataFrame, members: DataFrame, strategy: str = "merge") -> tuple[DataFrame, DataFrame]:
    """What merging does to the sources and what it records: the memories with merged ones inactive, and audit rows (source_id, result, strategy)."""
    gone = members.select("id", "cluster").distinct()
    after = memories.join(gone.select("id", F.lit(True).alias("_gone")), "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")
    return after, gone.select(F.col("id").alias("source_id"), F.col("cluster").alias("result"), F.lit(strategy).alias("strategy"))


def mean_vectors(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, vec): the mean of the vectors of a group, component by component."""
    parts = rows.select(*group, F.posexplode("vec").alias("at", "x")).groupBy(*group, "at").agg(F.avg("x").alias("x"))
    return parts.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p.x).alias("vec"))


def latest_by(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
