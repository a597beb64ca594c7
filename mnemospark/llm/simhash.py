"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are made in Arrow batches. Equal fingerprints collapse first (an aggregation with a
map-side combine, so that a third of all rows being copies costs one row per task). Distinct
fingerprints meet in buckets that the pigeonhole principle makes complete, and each bucket is
compared with vertical bit planes and carry-save counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.components import connected_components
from mnemospark.session import broadcast_if_small, checkpointed

SEED = 42
RADIUS = 3
TILE = 4096
MAX_BROADCAST_IDS = 1_000_000
_CHUNK = 1 << 15


def text_fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased word shingles; null or blank text gives 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[words_per_shingle - 1 :].tolist() if len(words) >= words_per_shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = h[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_mark(text: F.Column) -> F.Column:
    return F.xxhash64(text.cast("binary"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, fp, mark)``: one per input row, ``fp`` the fingerprint as a signed long, ``mark`` a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "mark"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), text_mark(F.col(text_col)).alias("mark"))
    return rows.mapInArrow(run, "doc_id long, fp long, mark long")


class BitPlanes:
    """Fingerprints stored vertically: plane ``b`` is an integer whose bit ``i`` is bit ``b`` of item ``i``."""

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        varying = np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0))
        self.full = (1 << len(fps)) - 1
        self.planes = [(int(b), int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little")) for b in varying]

    def near(self, fp: int, among: int, radius: int) -> int:
        """Items of ``among`` within ``radius`` (at most 3) bits of ``fp``, an item of this block, as a bit set.

        Two carry-save counter planes hold every distance modulo 4; a carry out of the second marks
        the item as beyond the radius, and the block is abandoned once every item is.
        """
        ones = twos = 0
        alive = among
        for b, plane in self.planes:
            d = (plane ^ self.full if fp >> b & 1 else plane) & alive
            carry = ones & d
            ones ^= d
            alive &= ~(twos & carry)
            twos ^= carry
            if not alive:
                return 0
        if radius >= 3:
            return alive
        return alive & ~(ones & twos) if radius == 2 else alive & ~twos if radius == 1 else alive & ~(ones | twos)


def _bits(mask: int) -> list[int]:
    raw = np.frombuffer(mask.to_bytes((mask.bit_length() + 7) // 8 or 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def spanning_links(ids: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links ``(id, smaller-side id)`` that span every group reachable inside one block.

    Every item is compared once with the items not yet reached; items that a query reaches leave
    the block. All links of the block are followed, but only a spanning forest is returned.
    """
    block = BitPlanes(fps)
    values = fps.astype("<u8").tolist()
    left, out = block.full, []
    while left:
        start = (left & -left).bit_length() - 1
        left &= left - 1
        queue = [start]
        while queue and left:
            at = queue.pop()
            if found := block.near(values[at], left, radius):
                left &= ~found
                new = _bits(found)
                out += [(int(ids[at]), int(ids[k])) for k in new]
                queue += new
    return out


def _bucket_keys(fp: str = "fp") -> F.Column:
    """16 keys of 28 bits: a 16-bit block, then a 12-bit block of the 48 bits that are left.

    At most 3 differing bits leave one of 4 blocks equal, then one of 4 blocks of the rest: every
    pair within the radius shares a key, and 28 bits keep buckets small up to billions of rows.
    """
    keys = []
    for a in range(4):
        block = f"(shiftrightunsigned({fp}, {16 * a}) & 65535L)"
        low = f"({fp} & {(1 << (16 * a)) - 1}L)"
        high = f"shiftleft(shiftrightunsigned({fp}, {16 * a + 16}), {16 * a})" if a < 3 else "0L"
        for s in range(4):
            sub = f"(shiftrightunsigned({high} | {low}, {12 * s}) & 4095L)"
            keys.append(f"(shiftleft({4 * a + s}L, 28) | shiftleft({block}, 12) | {sub})")
    return F.expr(f"array({', '.join(keys)})")


def _links(rows: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bucket, columns bucket, i, j, id, fp; a bucket may span batches."""
    held: list[pa.RecordBatch] = []

    def emit(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        key = [t.column(k).to_numpy() for k in range(3)]
        ids, fps = t.column(3).to_numpy(), t.column(4).to_numpy().view("<u8")
        change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
        edges = np.concatenate([[0], change, [len(ids)]])
        stop = len(edges) - 1 if last else len(edges) - 2
        sizes = np.diff(edges)
        out = []
        for g in np.flatnonzero(sizes[:stop] > 1):
            out += spanning_links(ids[edges[g] : edges[g + 1]], fps[edges[g] : edges[g + 1]], radius)
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"]), t.slice(edges[stop])

    for batch in rows:
        if batch.num_rows:
            held.append(batch)
            done, rest = emit(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            yield done
    if held:
        yield emit(pa.Table.from_batches(held).combine_chunks(), True)[0]


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows ``(src, dst)`` that connect distinct fingerprints ``(rep, fp)`` within ``radius`` bits.

    A bucket of more than ``tile`` fingerprints is cut into parts of about that size, and every
    pair of parts becomes a task of its own: no link is lost, and no task holds a whole hot bucket.
    """
    keyed = distinct.select("rep", "fp", F.explode(_bucket_keys()).alias("bucket"))
    hot = checkpointed(keyed.groupBy("bucket").count().where(F.col("count") > tile).select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("parts")))
    if hot.isEmpty():
        cut = keyed.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "fp")
    else:
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        cut = (
            keyed.join(hot, "bucket", "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", part)
            .select("bucket", "rep", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            .select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", "fp")
        )
    dealt = cut.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(lambda it: _links(it, radius), "src long, dst long")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """Rows ``(fp, group, component_id)`` for the fingerprints of rows with an id.

    The nodes are fingerprints, so that different texts under one id are not linked by it: ``group``
    is the smallest fingerprint reachable, ``component_id`` the smallest id of the group's rows.
    """
    reps = checkpointed(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(near_links(reps.select(F.col("fp").alias("rep"), "fp"), radius))
    each = checkpointed(reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("group")))
    return each.join(each.groupBy("group").agg(F.min("rep").alias("component_id")), "group").select("fp", "group", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``, one per input row.

    ``component_id`` is the smallest id reachable over fingerprints that differ in ``radius`` bits
    or fewer. Null and blank texts have fingerprint 0 and link like any other. Rows with a null
    id carry a fingerprint and a null component. Repeated ids give repeated rows. Other columns
    of ``docs`` are ignored, and an empty input gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    out = prints.join(_classes(prints, radius), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Keep one document of every component, that with the smallest id, with all its columns.

    Rows with a null id cannot be compared by id and stay. Different texts under one id are judged
    each by its own component; where several rows of a component bear its smallest id, the text with the smallest
    hash stays, once. Null and empty texts are like any other; an empty input stays empty; other columns, whatever their names, stay. Texts are shuffled only for ids that repeat, or where the losers are too many to broadcast.
    """
    prints = checkpointed(fingerprints(docs))
    rows = prints.where("doc_id is not null").join(_classes(prints, radius), "fp")
    first = F.col("doc_id") == F.col("component_id")
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(~first).alias("lost"))
    odd = checkpointed(ids.where("lost or n > 1").select("doc_id", "n"))
    once = docs.join(broadcast_if_small(odd.select("doc_id"), MAX_BROADCAST_IDS), "doc_id", "left_anti")
    many = broadcast_if_small(odd.where("n > 1").select("doc_id"), MAX_BROADCAST_IDS)
    stay = checkpointed(rows.where(first).join(many, "doc_id", "left_semi").groupBy("group", "doc_id").agg(F.min("mark").alias("mark")).select("doc_id", "mark"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.join(many, "doc_id", "left_semi").select(whole, F.col("doc_id"), text_mark(F.col("text")).alias("mark"))
    again = marked.join(broadcast_if_small(stay, MAX_BROADCAST_IDS), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).unionByName(again.select("row.*"))
