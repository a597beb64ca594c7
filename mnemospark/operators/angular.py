"""Exact similarity joins by angle: pivots cut blocks into parts, and the triangle inequality leaves most pairs of parts out.

Angles between directions are a metric. Every vector knows its angles to a few pivots of its block; a part holds
vectors of one nearest pivot and of close angles to it. If, for any pivot, the ranges of two parts lie further apart than the largest
angle that is asked for, no pair of theirs can be near, and their rows never meet. What is left is compared exactly, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, checkpointed

PIVOTS = 16
#: Rows of a block, first by hash, that the pivots are chosen among.
SAMPLE = 512
#: Steps of the angle to the nearest pivot in which parts are cut.
STEPS = 256
#: Pivots of so many blocks are broadcast.
MAX_BROADCAST_BLOCKS = 1000
#: More than any rounding of an angle.
SLACK = 1e-6


def cosines(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Cosines of all rows of one side with all of the other; of unequal lengths the shorter counts, and without a direction there is none (NaN)."""
    va, vb = ([np.array(v or [], float) for v in c.to_pylist()] for c in (a, b))
    out = np.full((len(va), len(vb)), np.nan)
    by_length = lambda vs: {n: [k for k, v in enumerate(vs) if len(v) == n] for n in {len(v) for v in vs} if n}
    for m, left in by_length(va).items():
        for n, right in by_length(vb).items():
            d = min(m, n)
            x, y = np.stack([va[k][:d] for k in left]), np.stack([vb[k][:d] for k in right])
            norm = np.sqrt((x * x).sum(axis=1)[:, None] * (y * y).sum(axis=1)[None, :])
            with np.errstate(divide="ignore", invalid="ignore"):
                out[np.ix_(left, right)] = np.where(norm > 0, (x @ y.T) / norm, np.nan)
    return out


def widest(cosine: float) -> float:
    """The largest angle that vectors of at least this cosine can make, with room for rounding."""
    return acos(max(-1.0, min(1.0, cosine - 1e-9))) + SLACK


def pivots(rows: DataFrame, block: list[str]) -> DataFrame:
    """(*block, pivots): for every block of ``rows (vec, *block)`` some of its own vectors, far from each other, chosen in a bounded sample; all of one length."""
    place = F.row_number().over(Window.partitionBy(*block).orderBy(F.xxhash64("vec"), "vec"))
    some = rows.select(*block, "vec").withColumn("_place", place).where(F.col("_place") <= SAMPLE).drop("_place")

    def choose(t: pa.Table) -> pa.Table:
        vecs = [np.array(v, float) for v in t.column("vec").to_pylist()]
        sizes = [len(v) for v in vecs]
        usual = max(set(sizes), key=lambda n: (sizes.count(n), n))
        x = np.stack([v for v in vecs if len(v) == usual])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        taken = [0]
        near = x @ x[0]
        while len(taken) < min(PIVOTS, len(x)) and near.min() < 1 - 1e-9:
            taken.append(int(near.argmin()))
            near = np.maximum(near, x @ x[taken[-1]])
        first = t.slice(0, 1).select(block)
        return first.append_column("pivots", pa.array([x[taken].tolist()], pa.list_(pa.list_(pa.float64()))))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in block)
    return some.groupBy(*block).applyInArrow(choose, f"{kinds}, pivots array<array<double>>")


def _angles(rows: DataFrame, chosen: DataFrame, block: list[str]) -> DataFrame:
    """``rows (id, vec, *block)`` with ``cell``, the nearest pivot (-1: of another length than the pivots), and ``angles`` to all."""
    met = rows.select(*block, "id", "vec").join(broadcast_if_small(chosen, MAX_BROADCAST_BLOCKS), block)
    at = [met.columns.index(c) for c in ("vec", "pivots")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, angles = [], []
            known: dict[bytes, np.ndarray] = {}
            for v, p in zip(b.column(at[0]).to_pylist(), b.column(at[1]), strict=True):
                key = p.values.offset, len(p.values)
                if key not in known:
                    known[key] = np.array(p.as_py(), float)
                pivot, x = known[key], np.array(v, float)
                if len(x) != pivot.shape[1]:
                    cells.append(-1)
                    angles.append([])
                else:
                    a = np.arccos(np.clip(pivot @ x / np.linalg.norm(x), -1, 1))
                    cells.append(int(a.argmin()))
                    angles.append(a.tolist())
            kept = [c for k, c in enumerate(b.columns) if k != at[1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cells, pa.int32()), pa.array(angles, pa.list_(pa.float64()))], [*[n for k, n in enumerate(b.schema.names) if k != at[1]], "cell", "angles"])

    out = met.drop("pivots").schema
    return met.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out)}, cell int, angles array<double>")


def parted(rows: DataFrame, chosen: DataFrame, block: list[str], part_rows: int) -> DataFrame:
    """``rows (id, vec, *block)`` with ``angles`` and their ``part``: about ``part_rows`` rows of one nearest pivot and of close angles to it.

    Parts are cut by counts of angle steps, of which a pivot has at most ``STEPS``; a step of more rows, such as one of copies, is dealt by a hash.
    """
    seen = checkpointed(_angles(rows, chosen, block))
    step = F.when(F.col("cell") < 0, 0).otherwise(F.floor(F.get("angles", F.col("cell")) / np.pi * (STEPS - 1))).cast("int").alias("step")
    seen = seen.withColumn("step", step)
    counts = seen.groupBy(*block, "cell", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*block, "cell").orderBy("step"))
    cut = counts.withColumn("ring", F.floor((upto - F.col("n")) / part_rows).cast("int")).withColumn("deal", F.ceil(F.col("n") / part_rows).cast("int"))
    name = F.concat_ws(".", "cell", "ring", F.when(F.col("deal") > 1, F.concat_ws("-", "step", F.pmod(F.xxhash64("id"), "deal"))).otherwise(F.lit("0")))
    return seen.join(cut.drop("n"), [*block, "cell", "step"]).select(*block, "id", "vec", "angles", name.alias("part"))


def part_ranges(rows: DataFrame, block: list[str]) -> DataFrame:
    """(*block, part, n, low, high): how many rows a part has and the ranges of their angles to all pivots; empty where it has none."""
    ends = [F.struct(F.min(F.get("angles", F.lit(k))).alias("low"), F.max(F.get("angles", F.lit(k))).alias("high")) for k in range(PIVOTS)]
    made = rows.groupBy(*block, "part").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends"))
    of = lambda side: F.transform(F.filter("ends", lambda e: e.low.isNotNull()), lambda e: e[side]).alias(side)
    return made.select(*block, "part", "n", of("low"), of("high"))


def apart(one: str, two: str) -> Column:
    """The least angle between vectors of two parts, as far as the pivots tell."""
    gaps = F.zip_with(
        F.zip_with(F.col(f"{one}.low"), F.col(f"{two}.high"), lambda a, b: a - b), F.zip_with(F.col(f"{two}.low"), F.col(f"{one}.high"), lambda a, b: a - b), lambda a, b: F.greatest(a, b)
    )
    return F.coalesce(F.array_max(gaps), F.lit(0.0))


def tiles(left: DataFrame, right: DataFrame, angle: float, block: list[str], same: bool) -> DataFrame:
    """(*block, i, j): pairs of parts, a left and a right one, that may hold vectors within an angle; of one and the same side each pair once."""
    one, two = part_ranges(left, block).alias("one"), part_ranges(right, block).alias("two")
    on = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in block]
    once = F.col("one.part") <= F.col("two.part") if same else F.lit(True)
    met = one.join(two, [*on, once, apart("one", "two") <= angle])
    return met.select(*[F.col(f"one.{c}").alias(c) for c in block], F.col("one.part").alias("i"), F.col("two.part").alias("j"))


def directed(rows: DataFrame, block: list[str]) -> DataFrame:
    """Rows (id, vec, *block) of a block that is not null that have a direction: no null, empty, all-zero or non-finite vectors."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col("vec").cast("array<double>")
    known = rows.dropna(subset=block)
    return known.where(F.coalesce(F.exists(vec, lambda x: x != 0) & ~F.exists(vec, bad), F.lit(False))).select("id", vec.alias("vec"), *block)


def _largest(rows: DataFrame, block: list[str]) -> int:
    return rows.groupBy(*block).count().agg(F.max("count")).head()[0] or 0


def angular_pairs(left: DataFrame, right: DataFrame | None, least: float, block: list[str], part_rows: int, inclusive: bool = True) -> DataFrame:
    """(a, b, cosine): pairs of rows ``(id, vec, *block)`` of one block with a cosine of ``least`` or more (``inclusive``) or above it.

    Without ``right`` the pairs are of ``left`` with itself, different ids, smaller id first. Rows without a direction, or with a null block, are in no
    pair; of unequal lengths the shorter counts, and rows of a length other than their block's pivots meet all.
    """
    left = directed(left, block)
    two = left if right is None else directed(right, block)
    keys = [*block, "i", "j"]
    if max(_largest(d, block) for d in ([left] if right is None else [left, two])) <= part_rows:  # every block is one tile
        sides = [d.select(*block, F.lit("").alias("i"), F.lit("").alias("j"), "id", "vec") for d in (left, two)]
    else:
        chosen = checkpointed(pivots(two, block))
        one = checkpointed(parted(left, chosen, block, part_rows))
        two = one if right is None else checkpointed(parted(two, chosen, block, part_rows))
        pairs = checkpointed(tiles(one, two, widest(least), block, right is None))
        sides = [d.select(*block, F.col("part").alias(k), "id", "vec").join(pairs, [*block, k]).select(*keys, "id", "vec") for d, k in ((one, "i"), (two, "j"))]
    sides[1] = sides[1].select(*[F.col(c).alias(c) for c in sides[1].columns])  # new columns, as both sides may come from one frame
    itself = right is None

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        near = cosines(x.column("vec"), y.column("vec"))
        u, v = np.nonzero(near >= least if inclusive else near > least)
        a, b = x.column("id").to_numpy()[u], y.column("id").to_numpy()[v]
        if itself:
            keep = a < b if x.num_rows and x.column("i")[0] == x.column("j")[0] else a != b
            u, v, a, b = u[keep], v[keep], np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        return pa.table({"a": a, "b": b, "cosine": near[u, v]})

    kind = left.schema["id"].dataType.simpleString()
    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(compare, f"a {kind}, b {kind}, cosine double")
