"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of how often they occur in either class; a linear
hinge-loss model on the scaled, length-normalised indicators is fitted by dual coordinate descent.
The n-grams are of bytes (1 to 3), of repeats in the word and line sequence, and of the text's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.labelled import held_out, training_rows
from mnemospark.llm.linear import dual_coordinate_descent, platt
from mnemospark.session import checkpointed

#: At most this many labelled documents of each class are used for fitting.
PER_CLASS = 3000
#: And at most this many n-grams of each class in all, which bounds what the driver holds: documents count in the order of their hash.
MOST_IDS = 12_000_000
#: A feature counts if this many of the fitted documents have it.
LEAST_DOCUMENTS = 5
_BI, _TRI, _RUNS, _SIZE = 256, 256 + 65536, (1 << 18) - 128, 1 << 18


def _runs(items: list[bytes]) -> set[int]:
    """Buckets of how long items repeat in a row, and of how many of all items are repeats in a row."""
    if len(items) < 2:
        return set()
    h = np.fromiter(map(hash, items), np.int64, len(items))
    same = h[1:] == h[:-1]
    if not same.any():
        return set()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    longest = int((edge[1::2] - edge[::2]).max())
    return set(range(min(longest.bit_length(), 8))) | {8 + int(7 * same.mean())}


def indicators(text: bytes | None) -> np.ndarray:
    """Sorted ids of the n-grams that the whole text has, the constant feature included."""
    text = text or b""
    seen = np.zeros(_SIZE, bool)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    seen[b] = True
    if len(b) > 1:
        two = b[:-1] << 8 | b[1:]
        seen[two + _BI] = True
        if len(b) > 2:
            mixed = ((two[:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(8)
            seen[mixed % np.uint32(_RUNS - _TRI) + np.uint32(_TRI)] = True
    at = _RUNS
    for x in _runs(text.split()):
        seen[at + x] = True
    for x in _runs(text.split(b"\n")):
        seen[at + 20 + x] = True
    seen[at + 40 + min(len(text).bit_length(), 40)] = True
    seen[_SIZE - 1] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class QualityModel:
    """``ratio``: log-count ratios; ``weight``: hinge-loss weights; a logistic curve turns margins into scores."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        return float(np.dot(self.weight[ids], r) / (np.sqrt(np.dot(r, r)) + 1e-9))

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.offset, -30, 30))))


def fit_features(rows: list[np.ndarray], y: np.ndarray) -> QualityModel:
    """Fit on indicator rows and labels 0 or 1. Without both classes every score is the one class's, or 0.5."""
    if len(set(y.tolist())) < 2:
        zero = np.zeros(_SIZE, np.float32)
        return QualityModel(zero, zero, 1.0, 0.0 if not len(y) else (5.0 if y[0] else -5.0))
    pos, neg = np.ones(_SIZE), np.ones(_SIZE)
    for ids, label in zip(rows, y, strict=True):
        (pos if label else neg)[ids] += 1
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    ratio = np.log((pos / (n1 + 2)) / (neg / (n0 + 2)))
    ratio[pos + neg - 2 < min(LEAST_DOCUMENTS, len(y) // 4)] = 0
    ratio[_SIZE - 1] = 1.0
    indptr, indices = np.cumsum([0] + [len(r) for r in rows]), np.concatenate(rows)
    norm = np.array([np.sqrt(np.dot(ratio[r], ratio[r])) + 1e-9 for r in rows])
    data = ratio[indices] / np.repeat(norm, np.diff(indptr))
    sign = np.where(y == 1, 1.0, -1.0)
    # the rarer class weighs as much as the other
    cost = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    w = dual_coordinate_descent(indptr, indices, data, sign, _SIZE, cost)
    model = QualityModel(ratio.astype(np.float32), w.astype(np.float32), 1.0, 0.0)
    model.slope, model.offset = platt(np.array([model.margin(r) for r in rows]), sign)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, most_ids: int = MOST_IDS) -> QualityModel:
    """Fit on at most ``per_class`` labelled documents and ``most_ids`` n-grams of each class, none of them held out.

    Null texts count as empty; labels that are null or of unknown ids are left out; without labels every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [indicators(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "y", "n", "ids"])

    chosen = training_rows(docs, labels, label, per_class).select(F.col("doc_id").cast("long").alias("doc_id"), "y", F.col("text").cast("binary").alias("t"))
    rows = checkpointed(chosen.mapInArrow(run, "doc_id long, y int, n long, ids binary"))
    upto = F.sum("n").over(Window.partitionBy("y").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))  # at most ``per_class`` rows of three numbers
    few = rows.select("doc_id", "y", "n").withColumn("upto", upto).where(F.col("upto") <= most_ids).select("doc_id")
    kept = rows.join(F.broadcast(few), "doc_id", "left_semi").select("ids", "y").toArrow()
    kept = kept.sort_by([("y", "ascending"), ("ids", "ascending")])  # rows arrive in any order
    y = kept.column("y").to_numpy()
    return fit_features([np.frombuffer(x, np.int32) for x in kept.column("ids").to_pylist()], y)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Rows (doc_id, held_out, score), one per input row, from the whole text and nothing else.

    Null texts score like empty ones; null and repeated ids stay rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array([model.score(t) for t in b.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), score], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
