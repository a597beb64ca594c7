"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Tokens are summed by source and hash bucket. The threshold that spends a source's budget lies in
one bucket; only that bucket is summed again on finer hash bits, until the bits run out. Taking
documents is then a filter on the hash: nothing is sorted, and a rerun takes the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, checkpointed

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
HASH_BITS = 36
LEVEL_BITS = 12
MAX_BROADCAST_SOURCES = 50_000
_BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null counts 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key per source; nulls are one source, after all others."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def document_hash(doc_id: Column) -> Column:
    """The first 36 bits of the MD5 of the id as text; repeated ids share a hash and go together."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``pos``, the 0-based place of a source by code point, without one task that holds them all."""
    placed = checkpointed(sources.orderBy("key").withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))  # a row per partition
    return placed.join(before, "pid").withColumn("pos", F.col("at") + F.col("before")).drop("pid", "at", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to rows ``(key, source_size)``: weighted shares of all sizes, each at most ``max_repeats`` its source.

    What a source cannot take is reshared by weight among those below their limit, until none is
    above. Each pass fixes at least one more source at its limit; passes exchange two sums only.
    """
    ranked = _ranked(sources)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("pos"), F.lit(len(weights))) + 1).cast("int"))
    ranked = checkpointed(ranked.select("key", "source_size", w.cast("long").alias("w"), (F.col("source_size") * max_repeats).alias("most")))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    full, share = None, None
    while True:
        at_most = F.lit(False) if share is None else F.col("most") <= F.col("w") * F.lit(share)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(at_most, F.col("most"))), F.lit(0)).alias("spent"),
            F.coalesce(F.sum(F.when(~at_most, F.col("w"))), F.lit(0)).alias("w"),
            F.count(F.when(at_most, 1)).alias("full"),
        ).head()
        if row.full == full or not row.w:
            break
        full, share = row.full, float(total - row.spent) / float(row.w)
    share = 0.0 if share is None else share
    target = F.when(F.col("most") <= F.col("w") * F.lit(share), F.col("most").cast("double")).otherwise(F.col("w") * F.lit(share))
    return ranked.select("key", "source_size", target.alias("target"))


def _boundary(rows: DataFrame, budget: DataFrame, level: int) -> DataFrame:
    """The bucket of this level in which each source's cumulated size first exceeds its budget.

    ``rows``: (key, hash, size), only those inside the bucket found so far; ``budget``: (key, left).
    Gives (key, bucket, left, inside): what is left before that bucket, and the bucket's own size.
    """
    shift = HASH_BITS - LEVEL_BITS * (level + 1)
    bucket = F.shiftright("hash", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
    sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("inside"))
    run = sums.withColumn("upto", F.sum("inside").over(Window.partitionBy("key").orderBy("bucket")))  # at most 4096 rows a source
    over = run.join(budget, "key").where("upto > left")
    first = over.groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("inside")).alias("left"), "inside"), "bucket").alias("b"))
    return first.select("key", "b.*")


def mixture_plan(sized: DataFrame) -> DataFrame:
    """One row per source ``(key, source_size, target, whole, threshold, edge)`` from rows ``(key, hash, size)``.

    Every document is taken ``whole`` times, and once more if its hash is below ``threshold``,
    or equal to it where ``edge`` is 1. The last bucket is one hash value; it is taken if that
    brings the source nearer to its target.
    """
    plan = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = checkpointed(plan.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")))
    inside, budget = sized.where("size > 0"), plan.select("key", "left")
    found = None
    for level in range(HASH_BITS // LEVEL_BITS):
        if found is not None:
            known = broadcast_if_small(found.select("key", F.col("prefix").alias("known")), MAX_BROADCAST_SOURCES)
            shift = HASH_BITS - LEVEL_BITS * level
            inside = inside.join(known, "key").where(F.shiftright("hash", shift) == F.col("known")).drop("known")
        step = _boundary(inside, budget, level)
        prefix = F.col("bucket") if found is None else F.shiftleft("prefix", LEVEL_BITS) + F.col("bucket")
        step = step if found is None else step.join(found.select("key", "prefix"), "key")
        found = checkpointed(step.select("key", prefix.alias("prefix"), "left", "inside"))
        budget = found.select("key", "left")
    edge = (F.col("inside") - F.col("rest") < F.col("rest")).cast("long")
    last = found.select("key", F.col("prefix").alias("threshold"), F.col("left").alias("rest"), "inside")
    return plan.join(last, "key", "left").select(
        "key", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"), F.coalesce(edge, F.lit(0)).alias("edge")
    )


def taken(size: Column, hash_: Column) -> Column:
    more = (hash_ < F.col("threshold")) | ((hash_ == F.col("threshold")) & (F.col("edge") == 1))
    return (size * (F.col("whole") + more.cast("long"))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows ``(doc_id, size, source_size, target, taken)``, one per input row.

    A null text has size 0; a null source is a source of its own; rows with null or repeated ids
    are taken together; an empty input gives an empty result. Other columns are ignored.
    """
    sized = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"), document_hash(F.col(id_col)).alias("hash"), word_count(F.col(text_col)).alias("size")
        )
    )
    plan = checkpointed(mixture_plan(sized.select("key", "hash", "size")))
    joined = sized.join(broadcast_if_small(plan, MAX_BROADCAST_SOURCES), "key")
    return joined.select("doc_id", "size", "source_size", "target", taken(F.col("size"), F.col("hash")).alias("taken"))


def take_mixture(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``size``, ``source_size``, ``target``, ``taken``.

    Columns of ``docs`` with one of these four names are replaced; others stay, whatever their names. A null source is one of its own,
    null and empty texts have size 0 and are never taken, rows that repeat an id are taken together, and an empty input gives
    an empty result. The texts are not shuffled.
    """
    own = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in own]
    facts = [source_key(F.col("source")).alias("key"), document_hash(F.col("doc_id")).alias("hash"), word_count(F.col("text")).alias("size")]
    plan = checkpointed(mixture_plan(checkpointed(docs.select(*facts))))
    params = broadcast_if_small(plan.withColumnRenamed("key", "source_key"), MAX_BROADCAST_SOURCES)
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(whole, F.struct(*facts).alias("own")).join(params, F.col("own.key") == F.col("source_key"))
    out = rows.select("row.*", F.col("own.size").alias("size"), "source_size", "target", taken(F.col("own.size"), F.col("own.hash")).alias("taken"))
    return out.where("taken > 0")


#: DuckDB: the same mix over table {docs}, by a plain running sum over single hash values.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS hash,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM {docs}),
src AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key),
ranked AS (SELECT key, source_size, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS w, 3 * source_size AS most FROM src),
run AS (SELECT *, most / CAST(w AS DOUBLE) AS ratio, coalesce(sum(most) OVER (ORDER BY most / CAST(w AS DOUBLE), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
        sum(w) OVER (ORDER BY most / CAST(w AS DOUBLE), key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft FROM ranked),
share AS (SELECT min_by(s, r) AS share FROM (SELECT ratio AS r, CAST((SELECT sum(source_size) FROM src) - spent AS DOUBLE) / CAST(wleft AS DOUBLE) AS s FROM run) WHERE r > s),
tgt AS (SELECT key, source_size, CASE WHEN most <= w * share THEN CAST(most AS DOUBLE) ELSE w * share END AS target FROM ranked, share),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tgt),
budget AS (SELECT *, target - whole * source_size AS rest FROM plan),
points AS (SELECT key, hash, sum(size) AS inside FROM sized WHERE size > 0 GROUP BY key, hash),
cum AS (SELECT key, hash, inside, sum(inside) OVER (PARTITION BY key ORDER BY hash) AS upto FROM points),
cut AS (SELECT key, min(hash) AS threshold, min_by(inside, hash) AS inside, min_by(rest - upto + inside, hash) AS rest
        FROM cum JOIN budget USING (key) WHERE upto > rest GROUP BY key)
SELECT doc_id, size, b.source_size, b.target,
       CAST(size * (b.whole + CASE WHEN hash < threshold OR (hash = threshold AND cut.inside - cut.rest < cut.rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN budget b USING (key) LEFT JOIN cut USING (key)
"""
