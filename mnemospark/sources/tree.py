"""Listings as trees of folders with digests, compared level by level: equal subtrees are never opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import checkpointed


def _half(text: Column, first: int) -> Column:
    """Eight bytes of a text's MD5 as a signed number."""
    return F.conv(F.substring(F.md5(text), first, 16), 16, -10).cast("long")


def tree_nodes(files: DataFrame) -> DataFrame:
    """(path, parent, depth, is_file, digest): files and folders of a listing ``files (path, digest)``, from the root (depth 0, empty path) down.

    A folder's digest combines those of its children, two sums of 64 bits over hashes of name and digest, so that a folder of any size is aggregated
    on the map side; that different folders agree in all 128 bits by chance is left out of account. Folders are made from paths, empty ones
    are not seen; an empty listing has no nodes, and of rows that repeat a path the largest digest counts. Leading and repeated slashes do not count.
    """
    clean = F.array_join(F.array_remove(F.split("path", "/"), ""), "/")
    named = files.where("path is not null").select(clean.alias("path"), F.col("digest").cast("string").alias("digest")).where("path <> ''").groupBy("path").agg(F.max("digest").alias("digest"))
    depth = F.size(F.split("path", "/"))
    rows = checkpointed(named.select("path", depth.alias("depth"), F.lit(True).alias("is_file"), F.coalesce("digest", F.lit("")).alias("digest")))
    deepest = rows.agg(F.max("depth")).head()[0] or 0
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    done, level = rows, rows.where(F.col("depth") == deepest)
    for d in range(deepest, 0, -1):
        child = F.concat_ws("/", F.when(F.col("is_file"), "f").otherwise("d"), F.regexp_extract("path", r"([^/]*)$", 1), "digest")
        sums = [F.sum(_half(child, at).cast("decimal(20,0)")).alias(f"h{at}") for at in (1, 17)]
        made = level.groupBy(parent.alias("path")).agg(*sums, F.count(F.lit(1)).alias("n"))
        both = F.concat_ws(":", F.col("h1").cast("string"), F.col("h17").cast("string"), F.col("n").cast("string"))
        folders = checkpointed(made.select("path", F.lit(d - 1).alias("depth"), F.lit(False).alias("is_file"), F.md5(both).alias("digest")))
        done = done.unionByName(folders)
        level = rows.where(F.col("depth") == d - 1).unionByName(folders)
    return done.select("path", F.when(F.col("depth") > 0, parent).alias("parent"), "depth", "is_file", "digest")


def tree_diff(before: DataFrame, after: DataFrame) -> tuple[DataFrame, int]:
    """(path, change) of files between two trees of ``tree_nodes``, kept from earlier runs: ``insert``, ``modify`` or ``delete``; and how many nodes were compared.

    From the root down only the children of folders that differ are joined. A file that became a folder, or the other way, is a delete and inserts.
    """
    asked = None
    found, seen, depth = None, 0, 0
    deepest = max(t.agg(F.max("depth")).head()[0] or 0 for t in (before, after))
    while depth <= deepest:
        sides = []
        for t, name in ((before, "old"), (after, "new")):
            rows = t.where(F.col("depth") == depth)
            rows = rows if asked is None else rows.join(asked, "parent", "left_semi")
            sides.append(rows.select("path", "is_file", F.col("digest").alias(name)))
        met = checkpointed(sides[0].join(sides[1], ["path", "is_file"], "full"))
        seen += met.count()
        odd = met.where(~F.col("old").eqNullSafe(F.col("new")))
        change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("modify").alias("change")
        files = odd.where("is_file").select("path", change)
        found = files if found is None else found.unionByName(files)
        asked = odd.where("not is_file").select(F.col("path").alias("parent"))
        depth += 1
    return found, seen
