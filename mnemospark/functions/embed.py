"""Embedders: any function from texts to vectors runs in Arrow batches; a hashed one needs no provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 32
MAX_BYTES = 32_000


#: FNV-1a with 64 bits, and the seed that stands for zero in the xorshift generator.
FNV_OFFSET, FNV_PRIME, ZERO_SEED = 0xCBF29CE484222325, 0x100000001B3, 0xCAFEBABE
_MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & _MASK
    return h


def hashed_vector(text: str | None, n: int = DIMENSIONS) -> list[float]:
    """A unit vector in single precision that only depends on the text: its FNV-1a hash seeds a xorshift generator. Equal texts have distance 0."""
    state, raw = fnv1a((text or "").encode()), []
    for _ in range(n):
        state = state or ZERO_SEED
        state = (state ^ state << 13) & _MASK
        state ^= state >> 7
        state = (state ^ state << 17) & _MASK
        raw.append((state - (1 << 64) if state >> 63 else state) / float(1 << 63))
    norm = sum(v * v for v in raw)
    scale = np.float32(1 / np.sqrt(norm)) if norm > 0 else np.float32(1)
    return [float(np.float32(v) * scale) for v in raw]


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_vectors(text: pd.Series) -> pd.Series:
    return text.map(hashed_vector)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(id, vec, status) of ``rows (id, content)``: ``ready``, or ``failed`` for empty and overlong contents, which are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").replace("\x00", "") for t in b.column(1).to_pylist()]
            good = [k for k, t in enumerate(texts) if t.strip() and len(t.encode("utf-8", "ignore")) <= MAX_BYTES]
            vecs: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(good), batch):
                part = good[at : at + batch]
                for k, v in zip(part, embedder([texts[k] for k in part]), strict=True):
                    vecs[k] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.list_(pa.float64())), pa.array(["failed" if v is None else "ready" for v in vecs])], ["id", "vec", "status"])

    return rows.select(F.col("id").cast("long"), "content").mapInArrow(run, "id long, vec array<double>, status string")
