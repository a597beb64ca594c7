"""Tables as immutable snapshots: upsert, insert-or-ignore, update, delete, paging, history.

A table is a folder of numbered snapshots; a writer adds the next number, and readers take the
largest that is complete. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; of rows of ``new`` that repeat a key the one that is largest in its other columns, in their order, stays."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}") for c in new.columns]) if rest else new.distinct()
    return old.join(once.select(*keys), keys, "left_anti").select(*new.columns).unionByName(once)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks are added."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def update_where(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(~F.coalesce(where, F.lit(False)))


def delete_cascading(rows: DataFrame, where: Column, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``rows`` without those that fit, and child tables without what points at them.

    ``children``: by name a table and its columns that hold the key of a parent, any of which is enough; null references point at nothing. A parent key that also remains in
    another row of ``rows`` counts as deleted.
    """
    gone = rows.where(F.coalesce(where, F.lit(False))).select(F.col(key).alias("_gone")).where("_gone is not null").distinct()
    left = {}
    for name, (table, columns) in children.items():
        for c in columns:
            table = table.join(gone, table[c] == gone["_gone"], "left_anti")
        left[name] = table
    return delete_where(rows, where), left


def keyset_page(rows: DataFrame, order: list[str], after: dict[str, Column], size: int) -> DataFrame:
    """The next ``size`` rows after a cursor in ascending order."""
    later = F.struct(*order) > F.struct(*[after[c].alias(c) for c in order])
    return rows.where(later).orderBy(*order).limit(size)


def offset_page(rows: DataFrame, order: list[Column], offset: int, size: int = 20, most: int = 100) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(size, most))


def versions(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Number the states of every key from 1, with the state before."""
    w = Window.partitionBy(key).orderBy(order)
    return changes.withColumn("version", F.row_number().over(w)).withColumn("previous", F.lag(order).over(w))


def write_snapshot(rows: DataFrame, root: str, partition_by: list[str] | None = None) -> int:
    """Write the next snapshot of a table and return its number; readers see it once it is complete."""
    number = (latest_snapshot(rows.sparkSession, root) or 0) + 1
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/v={number}")
    return number


def latest_snapshot(spark: SparkSession, root: str) -> int | None:
    """The largest snapshot whose writing ended, by Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    done = [int(p.getName()[2:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    number = latest_snapshot(spark, root) if number is None else number
    if number is None:
        raise FileNotFoundError(f"no snapshot in {root}")
    return spark.read.parquet(f"{root}/v={number}")
