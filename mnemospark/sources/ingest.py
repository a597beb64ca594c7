"""Files as documents: text and Word files read by Spark, and the difference between two listings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed name of the text runs of Word documents.
_WORD_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"
MAX_BYTES = 512 * 1024


def extract_text(name: str, content: bytes) -> tuple[str | None, str]:
    """Text of a file and ``ok``, or nothing and the reason. Text and Markdown pass as they are."""
    ext = re.sub(r"^.*\.", "", name.lower())
    if ext in ("txt", "md"):
        return content.decode("utf-8", "replace"), "ok"
    if ext == "docx":
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                tree = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            return None, f"unreadable: {type(e).__name__}"
        return "".join(t.text or "" for t in tree.iter(_WORD_TEXT)), "ok"
    return None, "unsupported format"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, status) of all files below a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract_text(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["path", "text", "status"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, text string, status string")


def changed_files(before: DataFrame, after: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, change) between two listings (path, content): ``insert``, ``modify`` or ``delete`` by content hash; larger files do not count."""
    hashed = lambda df, name: df.where(F.octet_length("content") <= max_bytes).select("path", F.sha2(F.col("content").cast("binary"), 256).alias(name))
    both = hashed(before, "old").join(hashed(after, "new"), "path", "full")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "modify")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")
