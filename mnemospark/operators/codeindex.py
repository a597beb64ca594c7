"""Index of source files: what a second run over changed files adds, and what it replaces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.scan import scan
from mnemospark.session import checkpointed

SCHEMA = "path string, kind string, name string, start_line int, body string, predicate string, target string"
#: Kinds of symbols whose bodies become memories of their own.
SUBSTANTIVE = ("function", "method", "class", "struct", "interface")


def scanned(files: DataFrame) -> DataFrame:
    """Rows of ``files (path, content)``: symbols (path, kind, name, start_line from 1, body) and edges (path, name, predicate, target) of each file that is code.

    Files in other languages, and null paths, give no rows; a null content is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                source = source or ""
                symbols, edges = scan(path, source)
                line, done = 1, 0
                for kind, name, start, end in sorted(symbols, key=lambda s: s[2]):
                    line, done = line + source.count("\n", done, start), start
                    rows.append((path, kind, name, line, source[start:end] or None, None, None))
                rows += [(path, None, subject, None, None, predicate, target) for subject, predicate, target in edges]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int32() if k == 3 else pa.string() for k in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return files.where("path is not null").select("path", "content").mapInArrow(run, SCHEMA)


@dataclass
class Update:
    """What an index run writes: rows of ``replaced (path)`` go from every table, then the others are added."""

    replaced: DataFrame
    digests: DataFrame
    entities: DataFrame
    relations: DataFrame
    memories: DataFrame

    def applied(self, table: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
        """A stored table after this run."""
        return table.join(self.replaced.select(F.col("path").alias(path)), path, "left_anti").unionByName(new)


def update_index(files: DataFrame, known: DataFrame, max_bytes: int = 512 * 1024) -> Update:
    """The run over ``files (path, content)`` after one that left ``known (path, digest)``; files that did not change are not scanned, and without any change nothing is written.

    Entities: (path, entity_type, canonical); relations: (path, subject, predicate, object); memories: (path, source_ref, parent_ref, content), one
    a file (``file:path``) and one for each body of a function, method, class, struct or interface (``file:path:line``), of which it is the parent. Larger files, like files
    that went, leave the index. Paths should be unique.
    """
    hashed = files.where(F.octet_length(F.coalesce("content", F.lit(""))) <= max_bytes).withColumn("digest", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    listed = checkpointed(hashed.select("path", "digest"))
    changed = checkpointed(listed.join(known.select("path", "digest"), ["path", "digest"], "left_anti"))
    gone = known.select("path").join(listed, "path", "left_anti")
    replaced = gone.unionByName(changed.join(known.select("path"), "path", "left_semi").select("path")).distinct()
    sources = hashed.join(changed, ["path", "digest"], "left_semi").select("path", "content")
    found = checkpointed(scanned(sources))
    symbols = found.where("kind is not null")
    ref = F.concat(F.lit("file:"), "path")
    whole = sources.select("path", ref.alias("source_ref"), F.lit(None).cast("string").alias("parent_ref"), F.coalesce("content", F.lit("")).alias("content"))
    parts = symbols.where(F.col("kind").isin(*SUBSTANTIVE) & F.col("body").isNotNull()).select("path", F.concat(ref, F.lit(":"), F.col("start_line").cast("string")).alias("source_ref"), ref.alias("parent_ref"), F.col("body").alias("content"))
    code = symbols.where("kind = 'file'").select("path")
    return Update(
        replaced,
        changed,
        symbols.select("path", F.col("kind").alias("entity_type"), F.col("name").alias("canonical")),
        found.where("predicate is not null").select("path", F.col("name").alias("subject"), "predicate", F.col("target").alias("object")),
        whole.join(code, "path", "left_semi").unionByName(parts),
    )
