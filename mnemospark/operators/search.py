"""Inverted indexes over texts, as Parquet clustered by term: positional ones for words, counted ones for trigrams.

A posting holds all that a score needs, so that a question reads the postings of its own terms and no text at all. The
terms are dealt into buckets, which are folders: files of other buckets are pruned before the scan, and in a bucket's sorted files the row groups
of other terms. A term of very many rows spans several files of its bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.english import cover_rank, english_words, simple_words
from mnemospark.session import ensure_checkpoint_dir

BUCKETS = 32
#: Similarities up to this are no match.
TRIGRAM_CUT = 0.1

#: Words whose terms or trigrams a task remembers.
MOST_SEEN = 100_000


def trigram_set(text: str | None, seen: dict[str, frozenset[str]] | None = None) -> set[str]:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    out: set[str] = set()
    seen = {} if seen is None else seen
    for w in set(simple_words(text)):
        if w not in seen:
            padded = f"  {w} "
            seen[w] = frozenset(padded[k : k + 3] for k in range(len(padded) - 2))
        out |= seen[w]
    return out


def _clustered(postings: DataFrame, folder: str) -> None:
    """Write postings (term, id, ...) by bucket, sorted by term and size; the ids of a bucket are dealt into parts, so that a term of many rows lies in several files."""
    spark = postings.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int")
    dealt = postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("bucket", "term", "size", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _texts(rows: DataFrame) -> DataFrame:
    """Rows (id, content) with an id; those of a table of few files are dealt to all cores first, as each text is much work."""
    known = rows.where("id is not null").select("id", "content")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return known.repartition(cores, "id") if known.rdd.getNumPartitions() < cores else known


def write_word_index(rows: DataFrame, folder: str, analyser: str = "simple") -> None:
    """Index ``rows (id, content)`` by word: postings (term, id, places, size) with the word's places from 0 and the number of words of the text.

    ``english`` keeps stems and leaves out stop words, whose places count. Null texts have no words, rows without an id are left out; ids should be unique.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str] = {}
        for b in batches:
            terms, at, places, sizes = [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                seen = {} if len(seen) > MOST_SEEN else seen
                words = english_words(text, seen) if analyser == "english" else simple_words(text)
                own: dict[str, list[int]] = {}
                for place, w in enumerate(words):
                    if w:
                        own.setdefault(w, []).append(place)
                terms += own
                at += [row] * len(own)
                places += own.values()
                sizes += [len(words)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column(0).take(pa.array(at, pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(sizes, pa.int32())], ["term", "id", "places", "size"])

    _clustered(_texts(rows).mapInArrow(run, f"term string, id {kind}, places array<int>, size int"), folder)


def write_trigram_index(rows: DataFrame, folder: str) -> None:
    """Index ``rows (id, content)`` by trigram: postings (term, id, size) with the number of distinct trigrams of the text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, frozenset[str]] = {}
        for b in batches:
            terms, at, sizes = [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                seen = {} if len(seen) > MOST_SEEN else seen
                own = trigram_set(text, seen)
                terms += own
                at += [row] * len(own)
                sizes += [len(own)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column(0).take(pa.array(at, pa.int32())), pa.array(sizes, pa.int32())], ["term", "id", "size"])

    _clustered(_texts(rows).mapInArrow(run, f"term string, id {kind}, size int"), folder)


def postings(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The postings of some terms; only files of their buckets are listed for the scan."""
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    return spark.read.parquet(folder).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")


def match_words(spark: SparkSession, folder: str, query: str, limit: int | None, among: DataFrame | None = None) -> DataFrame:
    """(id, text): texts of a ``simple`` index that hold every word of the query, by how large a part of the text those words are.

    ``among (id)`` bounds the texts, such as active ones of some scopes, before the limit is applied; without a limit all come, in any order. A query without words matches nothing.
    """
    terms = sorted(set(simple_words(query)))
    found = postings(spark, folder, terms)
    found = found if among is None else found.join(among.select("id").distinct(), "id", "left_semi")
    every = found.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.size("places")).alias("hits"), F.max("size").alias("size")).where(F.col("terms") == len(terms))
    scored = every.select("id", (F.col("hits").cast("double") / F.col("size")).alias("text"))
    return scored if limit is None else scored.orderBy(F.desc("text"), "id").limit(limit)


def match_english(spark: SparkSession, folder: str, query: str, limit: int, among: DataFrame | None = None) -> DataFrame:
    """(id, text): texts of an ``english`` index that hold every term of the query, by cover density; a query of stop words matches nothing."""
    terms = sorted(set(english_words(query)) - {""})
    found = postings(spark, folder, terms)
    found = found if among is None else found.join(among.select("id").distinct(), "id", "left_semi")
    number = F.array_position(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), F.col("term")).cast("int") - 1
    own = found.select("id", F.transform("places", lambda p: F.struct(p.alias("at"), number.alias("term"))).alias("own"))
    every = own.groupBy("id").agg(F.collect_list("own").alias("lists")).where(F.size("lists") == len(terms))  # a list for each term
    ranked = every.select("id", F.sort_array(F.flatten("lists")).alias("places"))
    score = cover_rank(F.col("places"), len(terms)) if terms else F.lit(0.0)
    return ranked.select("id", score.alias("text")).orderBy(F.desc("text"), "id").limit(limit)


def match_trigrams(spark: SparkSession, folder: str, query: str, limit: int | None, among: DataFrame | None = None, cut: float = TRIGRAM_CUT) -> DataFrame:
    """(id, trigram): texts whose trigrams are more than ``cut`` similar to the query's, by shared over all.

    The similarity follows from the postings. A text of far more or fewer trigrams than the query can't pass, which prunes postings by size; for
    others at least ``shared`` postings must meet, and a text without any of the query's rarer trigrams can't reach that.
    """
    terms = sorted(trigram_set(query))
    n = len(terms)
    found = postings(spark, folder, terms).where((F.col("size") > cut * n) & (F.col("size") * cut < n))
    found = found if among is None else found.join(among.select("id").distinct(), "id", "left_semi")
    counted = found.groupBy("id").agg(F.count(F.lit(1)).alias("shared"), F.max("size").alias("size"))
    score = F.col("shared").cast("double") / (n + F.col("size") - F.col("shared"))
    scored = counted.select("id", score.alias("trigram")).where(F.col("trigram") > cut)
    return scored if limit is None else scored.orderBy(F.desc("trigram"), "id").limit(limit)


def similar_texts(folder: str, spark: SparkSession, asked: DataFrame, cut: float) -> DataFrame:
    """(asked_id, id, trigram): for many short questions ``asked (id, content)`` at once the indexed texts more than ``cut`` similar.

    Prefix filter: a question's trigrams are put in order of how many texts have them, and a text must share one of the first ``n - ceil(cut n) + 1``,
    so that only these rarer ones bring candidates; the postings of the others are then counted for candidates alone.
    """
    kind = asked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted(trigram_set(t)) for t in b.column(1).to_pylist()]
            at = [k for k, s in enumerate(sets) for _ in s]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array([g for s in sets for g in s], pa.string()), pa.array([len(s) for s in sets for _ in s], pa.int32())], ["asked_id", "term", "n"])

    index = spark.read.parquet(folder).drop("bucket")
    grams = asked.select("id", "content").mapInArrow(run, f"asked_id {kind}, term string, n int")
    known = index.groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    order = Window.partitionBy("asked_id").orderBy("texts", "term")
    placed = grams.join(known, "term", "left").fillna(0, ["texts"]).withColumn("place", F.row_number().over(order))
    first = F.col("place") <= F.col("n") - F.ceil(F.col("n") * cut) + 1
    fits = (F.col("size") > cut * F.col("n")) & (F.col("size") * cut < F.col("n"))
    candidates = placed.where(first).join(index.withColumnRenamed("id", "_id"), "term").where(fits).select("asked_id", F.col("_id").alias("id")).distinct()
    counted = placed.select("asked_id", "term", "n").join(index, "term").join(candidates, ["asked_id", "id"], "left_semi")
    shared = counted.groupBy("asked_id", "id").agg(F.count(F.lit(1)).alias("shared"), F.max("size").alias("size"), F.max("n").alias("n"))
    score = F.col("shared").cast("double") / (F.col("n") + F.col("size") - F.col("shared"))
    return shared.select("asked_id", "id", score.alias("trigram")).where(F.col("trigram") > cut)


def index_folder(source: DataFrame, name: str) -> str:
    """A folder for an index of a table that is read from files, another one whenever its files change.

    It lies in ``spark.mnemospark.index.dir``, else in the shared checkpoint folder.
    """
    spark = source.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.mnemospark.index.dir", None) or f"{spark.sparkContext.getCheckpointDir()}/indexes"
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    version = files.agg(F.expr("coalesce(bit_xor(xxhash64(file_path, file_size, file_modification_time)), 0)")).head()[0]
    return f"{base}/{name}-{version & (1 << 64) - 1:016x}"


def kept(source: DataFrame, name: str, write: Callable[[str], None]) -> str:
    """The folder of an index of ``source``, written by ``write(folder)`` unless it is there whole."""
    spark, folder = source.sparkSession, index_folder(source, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        write(folder)
    return folder
