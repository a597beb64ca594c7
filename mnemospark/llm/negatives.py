"""Hard-negative mining by a vertical scan of integer vectors with branch and bound (BOND).

Anchors and candidates are dealt into a grid of cells, a bounded number of each to a cell. A cell lays its candidates
out by dimension and reads, for each anchor, the dimensions in the order of the anchor's magnitude. What the
dimensions not yet read can add at least and at most follows from their extremes in the cell; candidates that can no longer
be among the first leave the bitmap. All arithmetic is on integers, so that the scores and their order are exact.
A first scan finds the nearest rows of an anchor's own label; a second one finds, for the score window
of each of these, the first rows of other labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import checkpointed

#: Anchors and candidates of a cell, about; with 64 components either takes 8 MB.
CELL = 16_384
#: Dimensions read between two looks at the bounds.
STEP = 8
SCALE = 256
#: Doubles hold integers below this exactly, and so does every partial sum of a cell whose scores stay below.
EXACT = 1 << 53
LONG = (1 << 63) - 1

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles: as doubles where these are exact, else as Python integers."""
    if not x.size or np.abs(x).max() < EXACT / SCALE:
        return np.floor(SCALE * x)
    whole = [int(np.floor(SCALE * v)) if abs(v) < EXACT else SCALE * int(v) for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def _kth(values: np.ndarray, k: int) -> int | float:
    """The ``k``-th largest of at least ``k`` values."""
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


class Columns:
    """Candidates of one cell by dimension, sorted by label and id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.rows, self.labels = ids[order], rows[order], labels[order]
        self.dims = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = (f(self.dims, axis=1) if len(ids) else np.zeros(len(self.dims)) for f in (np.min, np.max))

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def scan(self, anchor: np.ndarray, at: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
        """Candidates ``at`` that ``keep(least, most)`` leaves once every dimension is read, and their scores.

        ``keep`` is asked after every few dimensions with the least and the most that each score can still be.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = [self.low[order] * a, self.high[order] * a]
        least, most = np.minimum(*ends)[::-1].cumsum()[::-1], np.maximum(*ends)[::-1].cumsum()[::-1]
        part = np.zeros(len(at), dtype=self.dims.dtype)
        for s in range(0, len(a), STEP):
            if not len(at):
                break
            part = part + a[s : s + STEP] @ self.dims[np.ix_(order[s : s + STEP], at)]
            done = s + STEP >= len(a)
            alive = keep(part if done else part + least[s + STEP], part if done else part + most[s + STEP])
            if not alive.all():
                at, part = at[alive], part[alive]
        return at, part

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The first ``k`` (id, score): larger scores first, ties by the smaller id."""
        if scores.dtype == object:
            pairs = sorted(zip(scores.tolist(), self.ids[at].tolist(), strict=True), key=lambda p: (-p[0], p[1]))[:k]
            return [(i, s) for s, i in pairs]
        best = np.lexsort((self.ids[at], -scores))[:k]
        return [(int(self.ids[at[b]]), int(scores[b])) for b in best]

    def nearest(self, anchor: np.ndarray, row: int, label: int, k: int) -> list[tuple[int, int]]:
        """The first ``k`` other rows of the anchor's label."""

        def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            return most >= _kth(least, k) if len(least) > k else np.ones(len(least), bool)

        own = self.of_label(label)
        at = np.arange(own.start, own.stop)
        return self.first(*self.scan(anchor, at[self.rows[own] != row], keep), k)

    def within(self, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each (low, high), the first ``k`` rows of other labels whose score lies there, ends included."""

        def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            alive = np.zeros(len(least), bool)
            for low, high in windows:
                sure = least[(least >= low) & (most <= high)]
                floor = _kth(sure, k) if len(sure) >= k else low
                alive |= (most >= floor) & (least <= high)
            return alive

        own = self.of_label(label)
        at, scores = self.scan(anchor, np.concatenate([np.arange(own.start), np.arange(own.stop, len(self.ids))]), keep)
        found = []
        for low, high in windows:
            fits = (scores >= low) & (scores <= high)
            found.append(self.first(at[fits], scores[fits], k))
        return found


def score_window(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest integer s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _vectors(t: pa.Table) -> np.ndarray:
    col = t.column("vec").combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1 if len(t) and len(col.values) else 0)


def _cell(anchors: pa.Table, candidates: pa.Table) -> tuple[np.ndarray, np.ndarray, Columns]:
    """Anchor vectors and label codes, and the columns of the candidates, all doubles if every score is exact in them."""
    labels = pa.chunked_array([*anchors.column("label").chunks, *candidates.column("label").chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    a, x = integers(_vectors(anchors)), integers(_vectors(candidates))
    most = [int(np.abs(m).max()) if m.size else 0 for m in (a, x)]
    if object in (a.dtype, x.dtype) or most[0] * most[1] * a.shape[1] >= EXACT:
        a, x = (np.array([int(v) for v in m.ravel().tolist()], dtype=object).reshape(m.shape) for m in (a, x))
    ids, rows = (candidates.column(c).to_numpy() for c in ("id", "row"))
    return a, labels[: len(a)], Columns(x, ids, rows, labels[len(a) :])


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


def _long(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def _sortable(score: int) -> str:
    """A text that sorts as the integer does, of any size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(_NINES)


_NINES = str.maketrans("0123456789", "9876543210")


def _met(anchors: DataFrame, rows: DataFrame, parts: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on every cell of the grid: each group of anchors meets each group of candidates of its own length."""
    of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"i": of(parts[0]), "width": F.size("vec")}).withColumn("j", each(parts[1]))
    right = rows.withColumns({"j": of(parts[1]), "width": F.size("vec")}).withColumn("i", each(parts[0]))
    keys = ["width", "i", "j"]

    def cell(a: pa.Table, x: pa.Table) -> pa.Table:
        return work(a, x) if len(a) and len(x) else work(a.slice(0, 0), x.slice(0, 0))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(256 * x), x as a double; scores are inner products. ``positives`` are an anchor's first other rows of its
    label; for each, the first ``negatives`` rows of other labels come whose score is ``low`` to ``high`` per cent of the positive's.
    Larger scores come first, ties by the smaller id. Rows with a null id, label or vector, or with a null or non-finite
    component take no part; a vector meets those of its own length only, and of no components scores 0. Every row of a repeated id is a row: an
    anchor of its own, and other than its repeats. A negative positive score has an empty window. Scores beyond a long are compared exactly and
    returned as the nearest long. Other columns are ignored; an empty input gives no rows.
    """
    single = embeddings.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    named = embeddings.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    good = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad))
    rows = checkpointed(good.withColumn("row", F.monotonically_increasing_id()))
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("anchors")).head()
    parts = max(1, -(-n.anchors // CELL)), max(rows.sparkSession.sparkContext.defaultParallelism, -(-n["all"] // CELL))

    def near(a: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        if len(a):
            vectors, labels, columns = _cell(a, x)
            for row, v, own in zip(a.column("row").to_pylist(), vectors, labels, strict=True):
                out += [(row, i, str(s), _sortable(s)) for i, s in columns.nearest(v, row, own, positives)]
        return _table([("row", pa.int64()), ("id", pa.int64()), ("score", pa.string()), ("key", pa.string())], out)

    def between(a: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        if len(a):
            vectors, labels, columns = _cell(a, x)
            for row, anchor, v, own, known in zip(*(a.column(c).to_pylist() for c in ("row", "id")), vectors, labels, a.column("known").to_pylist(), strict=True):
                wanted = [(k["place"], k["id"], int(k["score"])) for k in known]
                windows = [score_window(s, low, high) for *_, s in wanted]
                for (place, pid, s), found in zip(wanted, columns.within(v, own, windows, negatives), strict=True):
                    out += [(row, anchor, place, pid, _long(s), i, _long(t), _sortable(t)) for i, t in found]
        names = ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score", "key"]
        return _table([(c, {"place": pa.int32(), "key": pa.string()}.get(c, pa.int64())) for c in names], out)

    anchors = rows.where("asks").select("row", "id", "label", "vec")
    candidates = rows.select("row", "id", "label", "vec")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("key"), "id"))
    nearest = _met(anchors, candidates, parts, near, "row long, id long, score string, key string").withColumn("place", place).where(F.col("place") <= positives)
    known = nearest.groupBy("row").agg(F.collect_list(F.struct("place", "id", "score")).alias("known"))
    asking = checkpointed(anchors.join(known, "row"))
    found = _met(asking, candidates, parts, between, "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long, key string")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("key"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB: every anchor against all rows.
ORACLE = r"""
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""
