"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily.

Equal vectors are one node that knows its smallest ids. Nodes first meet in leaves of random
hyperplane codes; then every node repeatedly introduces its neighbours (forward and reverse) to
each other, by Spark joins of neighbours of neighbours, and each keeps its nearest. A query keeps
a pool of the nearest nodes seen and in every round expands the best ones not expanded yet, each round twice as many
as the last. A bounded sample of the queries is also answered exactly, by one pass over the vectors; the
rounds end when the search finds enough of those answers, or has seen all it can reach. Graph and
search carry the components as given (single or double precision) and compare them in double precision,
so that near copies of one vector are told apart; the results are scored on the originals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, checkpointed

DEGREE = 24
ROUNDS = 3
LEAF = 160
TREES = 2
#: Entries expanded in the first round, and how many rounds there are at most.
EXPAND = 24
SEARCH_ROUNDS = 16
#: A pool holds at least so many entries, and twice as many as are expanded.
POOL = 240
#: The rounds end when this share of the exact answers of at most ``PROBES`` queries is found.
TARGET = 0.95
PROBES = 128
RESCORE = 60
#: A leaf of more than this many times ``LEAF`` nodes is cut into parts.
HOT = 4
#: Queries that one row of a node's asks holds, about.
ASKS = 256
#: A node that more than this many times ``ASKS`` queries ask in one round is a hub.
HUB = 4
MAX_BROADCAST_LEAVES = 100_000
#: Cosines that lie this close may change places when they are scored on the originals.
TIE = 1e-12
_PAIR = np.dtype([("id", "<i8"), ("sim", "<f8")])
_SEEN = np.dtype([("id", "<i8"), ("sim", "<f8"), ("done", "?")])
_OFFERS = 8
#: Rows of an Arrow batch in the search, where a row holds the vectors of all neighbours of a node.
SEARCH_BATCH = 500

Rows = Iterator[pa.RecordBatch]


def by_group(batches: Rows, work: Callable[[pa.Table, np.ndarray], list[pa.RecordBatch]], keys: int = 1) -> Rows:
    """Hand sorted batches on as whole groups: ``work(table, edges)`` gets complete groups only, many at a time.

    Only the rows of the group that is still open are held back.
    """
    held: list[pa.RecordBatch] = []
    for last, batch in _with_end(batches):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if not held:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(len(table) - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])
        if not last:
            edges = edges[:-1]
        if len(edges) > 1:
            yield from work(table.slice(0, edges[-1]), edges)
            held = table.slice(edges[-1]).to_batches()


def _with_end(batches: Rows) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for b in batches:
        yield False, b
    yield True, None


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _raw(col: pa.ChunkedArray) -> list[bytes]:
    return col.to_pylist()


def _units(raw: bytes, width: int, rows: int) -> np.ndarray:
    """Unit vectors in double precision from ``rows`` packed codes, one row each."""
    m = np.frombuffer(raw, "<f4" if len(raw) == 4 * width * rows else "<f8").reshape(rows, width).astype(float)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    raw = col.to_pylist()
    return _units(b"".join(raw), width, len(raw))


def _nearest(pairs: np.ndarray, k: int, not_id: int) -> np.ndarray:
    """The ``k`` nearest of (id, sim) rows, each id once, without ``not_id``; ties to the smaller id."""
    _, first = np.unique(pairs["id"], return_index=True)
    pairs = pairs[first]
    pairs = pairs[pairs["id"] != not_id]
    if len(pairs) > 4 * k:
        pairs = pairs[np.argpartition(-pairs["sim"], 2 * k)[: 2 * k]]
    return pairs[np.lexsort((pairs["id"], -pairs["sim"]))[:k]]


def _packed(sizes: list[np.ndarray], parts: list[np.ndarray]) -> pa.Array:
    """A binary array whose elements are the next ``sizes`` pairs of ``parts``, without a copy for each."""
    n = np.concatenate([np.zeros(1, np.int64), *sizes]).cumsum() * _PAIR.itemsize
    data = np.concatenate(parts) if parts else np.empty(0, _PAIR)
    return pa.Array.from_buffers(pa.binary(), len(n) - 1, [None, pa.py_buffer(n.astype(np.int32)), pa.py_buffer(data.tobytes())])


def usable(vec: Column) -> Column:
    """True for vectors that are not null, empty or all zero and hold no null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.exists(vec, lambda x: x != 0) & ~F.exists(vec, bad), F.lit(False))


def vector_classes(rows: DataFrame, keep: int, dtype: str = "<f8") -> DataFrame:
    """Rows (node, ids, vec, even, code) from usable rows (id, row, vec): one per distinct vector, with its ``keep`` smallest (id, row); ``node`` is the first one's row.

    ``code`` packs the components as ``dtype``, which must hold them exactly; ``even`` is the vector scaled by a power of two,
    which changes no bit of a cosine but lets no square overflow.

    The limit is applied before the shuffle, so that a vector that a third of all rows share costs
    ``keep`` rows a task.
    """
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id", "row"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep).groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids"))

    def run(batches: Rows) -> Rows:
        for b in batches:
            vecs = [np.array(v) for v in b.column(2).to_pylist()]
            even = [np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in vecs]
            codes = [v.astype(dtype).tobytes() for v in vecs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(even, pa.list_(pa.float64())), pa.array(codes, pa.binary())], ["node", "ids", "vec", "even", "code"])

    return few.select(F.col("ids")[0]["row"].alias("node"), "ids", "vec").mapInArrow(run, "node long, ids array<struct<id:long,row:long>>, vec array<double>, even array<double>, code binary")


def _first_lists(nodes: DataFrame, n: int, width: int, degree: int) -> DataFrame:
    """Rows (node, pairs): the nearest in the node's leaf, for each of a few random codes, and in a group dealt by hash.

    The dealt group gives every node a full list, however lonely its leaves are; up to ``LEAF`` nodes all meet.
    """
    groups = max(1, -(-n // LEAF))
    bits = int(np.ceil(np.log2(groups)))

    def leaves(batches: Rows) -> Rows:
        for b in batches:
            x = _matrix(pa.chunked_array([b.column(1)]), width)
            for tree in range(TREES):
                planes = np.random.default_rng(100 + tree).normal(size=(width, bits))
                leaf = ((x @ planes > 0) * (1 << np.arange(bits))).sum(axis=1) * TREES + tree
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), b.column(0), b.column(1)], ["leaf", "node", "code"])

    def work(t: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
        ids, x = t.column("node").to_numpy(), _matrix(t.column("code"), width)
        at, sizes, out = [], [], []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            k = min(degree, z - a - 1)
            sims = x[a:z] @ x[a:z].T
            np.fill_diagonal(sims, -2)
            best = np.argpartition(-sims, k, axis=1)[:, :k]
            pairs = np.empty((z - a, k), _PAIR)
            pairs["id"], pairs["sim"] = ids[a:z][best], np.take_along_axis(sims, best, 1)
            at.append(ids[a:z])
            sizes.append(np.full(z - a, k))
            out.append(pairs.ravel())
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), _packed(sizes, out)], ["node", "pairs"])]

    # parts differ between the codes, or a tight group, whole in one leaf of each, would fall into closed islands
    group = (-1 - F.pmod(F.xxhash64("node"), F.lit(groups))).cast("long")
    dealt = nodes.select("node", "code").mapInArrow(leaves, "leaf long, node long, code binary")
    dealt = checkpointed(dealt.unionByName(nodes.select(group.alias("leaf"), "node", "code")))
    # only leaves that a tight group fills are cut, and the nodes of no leaf pass through one task
    hot = checkpointed(dealt.groupBy("leaf").count().where(F.col("count") > HOT * LEAF).select("leaf", F.ceil(F.col("count") / LEAF).alias("parts")))
    part = F.pmod(F.xxhash64("node", "leaf"), F.coalesce("parts", F.lit(1)))
    cut = dealt.join(broadcast_if_small(hot, MAX_BROADCAST_LEAVES), "leaf", "left").select("leaf", part.alias("part"), "node", "code")
    return cut.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(lambda it: by_group(it, work, 2), "node long, pairs binary")


def _merged(lists: DataFrame, degree: int) -> DataFrame:
    """Rows (node, pairs, floor): one list per node from several, its nearest ``degree``, and how near a newcomer must be."""

    def work(t: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
        ids, raw = t.column(0).to_numpy(), _raw(t.column(1))
        best = [_nearest(np.frombuffer(b"".join(raw[a:z]), _PAIR), degree, ids[a]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        low = [float(p["sim"][-1]) if len(p) >= degree else -2.0 for p in best]
        return [pa.RecordBatch.from_arrays([pa.array(ids[edges[:-1]]), pa.array([p.tobytes() for p in best], pa.binary()), pa.array(low, pa.float64())], ["node", "pairs", "floor"])]

    dealt = lists.select("node", "pairs").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(lambda it: by_group(it, work), "node long, pairs binary, floor double")


def _edges(lists: DataFrame, degree: int) -> DataFrame:
    """Rows (at, other): the neighbours of a node, forward and the nearest ``degree`` reverse ones; some show twice."""

    def run(batches: Rows) -> Rows:
        for b in batches:
            ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            pairs = np.frombuffer(b"".join(raw), _PAIR)
            own = np.repeat(ids, [len(r) // _PAIR.itemsize for r in raw])
            both = [np.concatenate([own, pairs["id"]]), np.concatenate([pairs["id"], own]), np.concatenate([pairs["sim"], pairs["sim"]]), np.repeat([True, False], len(own))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in both], ["at", "other", "sim", "ahead"])

    each = lists.select("node", "pairs").mapInArrow(run, "at long, other long, sim double, ahead boolean")
    # a forward list has no more than ``degree`` rows; the limit applies before the shuffle
    place = F.row_number().over(Window.partitionBy("at", "ahead").orderBy(F.desc("sim"), "other"))
    return each.withColumn("place", place).where(F.col("place") <= degree).select("at", "other")


def _introduced(lists: DataFrame, nodes: DataFrame, width: int, degree: int) -> DataFrame:
    """Rows (node, pairs): what each node learns where two of its neighbours, or it and another, meet at a third."""

    def work(t: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
        ids, low, x = t.column(1).to_numpy(), t.column(2).to_numpy(), _matrix(t.column(3), width)
        at, sizes, out = [np.empty(0, np.int64)], [], []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            _, here = np.unique(ids[a:z], return_index=True)
            here = here + a
            if len(here) < 2:
                continue
            sims = x[here] @ x[here].T
            np.fill_diagonal(sims, -2)
            k = min(_OFFERS, len(here) - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(sims, best, 1)
            useful = value > low[here][:, None]
            n = useful.sum(axis=1)
            pairs = np.empty(int(n.sum()), _PAIR)
            pairs["id"], pairs["sim"] = ids[here][best[useful]], value[useful]
            at.append(ids[here][n > 0])
            sizes.append(n[n > 0])
            out.append(pairs)
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), _packed(sizes, out)], ["node", "pairs"])]

    known = nodes.select("node", "code").join(lists.select("node", "floor"), "node")
    met = _edges(lists, degree).join(known.withColumnRenamed("node", "other"), "other").select("at", "other", "floor", "code")
    # a node is at its own table too
    self_ = known.select(F.col("node").alias("at"), F.col("node").alias("other"), "floor", "code")
    return met.unionByName(self_).repartition("at").sortWithinPartitions("at").mapInArrow(lambda it: by_group(it, work), "node long, pairs binary")


def descent_graph(nodes: DataFrame, n: int, width: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """Rows (node, pairs, floor): every node's nearest neighbours as NN-descent finds them."""
    lists = checkpointed(_merged(_first_lists(nodes, n, width, degree), degree))
    for _ in range(rounds):
        lists = checkpointed(_merged(lists.select("node", "pairs").unionByName(_introduced(lists, nodes, width, degree)), degree))
    return lists


def adjacency(lists: DataFrame, nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """Rows (node, others, codes): the neighbours of a node in both directions with their codes, packed."""

    def work(t: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
        at, others, codes = t.column(0).to_numpy(), t.column(1).to_numpy(), _raw(t.column(2))
        packed = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            ids, here = np.unique(others[a:z], return_index=True)
            packed.append((ids.tobytes(), b"".join(codes[a + k] for k in here)))
        return [pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]]), pa.array([p for p, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], ["node", "others", "codes"])]

    met = _edges(lists, degree).join(nodes.select(F.col("node").alias("other"), "code"), "other").select("at", "other", "code")
    return met.repartition("at").sortWithinPartitions("at").mapInArrow(lambda it: by_group(it, work), "node long, others binary, codes binary")


def _pick(pool: np.ndarray, expand: int) -> np.ndarray:
    """Indices of the best entries of a sorted pool that are not expanded yet."""
    return np.flatnonzero(~pool["done"])[:expand]


def exact_floors(probes: DataFrame, nodes: DataFrame, width: int, k: int) -> dict[int, tuple[float, int]]:
    """Per node of ``probes (query, code)``, a bounded sample, the cosine of its ``k``-th nearest other node, and ``k`` or how many there are; by one pass over all nodes."""
    asked = probes.select("query", "code").collect()
    if not asked:
        return {}
    ids, want = np.array([r.query for r in asked]), _units(b"".join(r.code for r in asked), width, len(asked))

    def run(batches: Rows) -> Rows:
        best = np.full((len(ids), k), -2.0)
        for b in batches:
            if b.num_rows:
                sims = want @ _matrix(pa.chunked_array([b.column(1)]), width).T
                sims[ids[:, None] == b.column(0).to_numpy()[None, :]] = -2.0
                best = -np.partition(-np.concatenate([best, sims], axis=1), k - 1, axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(best.ravel())], ["query", "sim"])

    each = nodes.select("node", "code").mapInArrow(run, "query long, sim double").where("sim > -2")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim")))
    top = each.withColumn("place", place).where(F.col("place") <= k).groupBy("query").agg(F.min("sim").alias("floor"), F.count(F.lit(1)).alias("n")).collect()
    return {r.query: (r.floor, r.n) for r in top}


def found_share(state: DataFrame, floors: dict[int, tuple[float, int]]) -> float:
    """How much of the exact answers the pools of the probes hold."""

    def run(batches: Rows) -> Rows:
        for b in batches:
            got = []
            for q, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                pool = np.frombuffer(raw, _SEEN)
                floor, n = floors[q]
                got.append(min(n, int(((pool["sim"] >= floor - TIE) & (pool["id"] != q)).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], ["got"])

    row = state.where(F.col("query").isin(list(floors))).select("query", "seen").mapInArrow(run, "got long").agg(F.sum("got").alias("got")).head()
    return (row.got or 0) / sum(n for _, n in floors.values())


def greedy_search(starts: DataFrame, graph: DataFrame, nodes: DataFrame, width: int, k: int = 5, target: float = TARGET, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """Rows (query, seen) from rows (query, code, start): a pool of (id, sim, done) entries, nearest first; ``start`` is the query's own node.

    Every round expands the best unexpanded entries of each pool by a join with the graph, where a node
    answers all that ask it at once. It ends as the module says.
    """
    graph = graph.repartition("node").persist(StorageLevel.MEMORY_AND_DISK)
    floors = exact_floors(starts.orderBy(F.xxhash64("query")).limit(PROBES), nodes, width, k)
    salts = max(1, starts.count() // ASKS)

    def first(batches: Rows) -> Rows:
        for b in batches:
            seen = []
            for s in b.column(2).to_pylist():
                one = np.zeros(1, _SEEN)
                one["id"], one["sim"] = s, 1.0
                seen.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seen, pa.binary())], ["query", "code", "seen"])

    def asking(expand: int, pool: int) -> Callable[[Rows], Rows]:
        def ask(batches: Rows) -> Rows:
            for b in batches:
                at, query, code, low = [], [], [], []
                for q, c, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    mine = np.frombuffer(raw, _SEEN)
                    near = mine["id"][_pick(mine, expand)].tolist()
                    at += near
                    query += [q] * len(near)
                    code += [c] * len(near)
                    low += [float(mine["sim"][-1]) if len(mine) >= pool else -2.0] * len(near)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(query, pa.int64()), pa.array(code, pa.binary()), pa.array(low, pa.float64())], ["node", "query", "code", "low"])

        return ask

    def answer(batches: Rows) -> Rows:
        for b in batches:
            query, out = [], []
            asks = b.column(0)
            edges = asks.offsets.to_numpy()
            flat = asks.values
            qs, codes_, lows = (flat.field(k) for k in range(3))
            qs, lows, raw = qs.to_numpy(), lows.to_numpy(), codes_.to_pylist()
            for r, (others, codes) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                a, z = edges[r], edges[r + 1]
                ids = np.frombuffer(others, "<i8")
                sims = _units(b"".join(raw[a:z]), width, z - a) @ _units(codes, width, len(ids)).T
                good = sims > lows[a:z, None]
                for at in np.flatnonzero(good.any(axis=1)):
                    found = np.zeros(int(good[at].sum()), _SEEN)
                    found["id"], found["sim"] = ids[good[at]], sims[at][good[at]]
                    query.append(qs[a + at])
                    out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array([None] * len(query), pa.binary()), pa.array(out, pa.binary())], ["query", "code", "seen"])

    def merging(expand: int, pool: int) -> Callable[[pa.Table, np.ndarray], list[pa.RecordBatch]]:
        def merge(t: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
            query, code, raw = t.column(0).to_numpy(), _raw(t.column(1)), _raw(t.column(2))
            codes, out = [], []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                own = next(k for k in range(a, z) if code[k] is not None)
                mine = np.frombuffer(raw[own], _SEEN).copy()
                mine["done"][_pick(mine, expand)] = True
                every = np.concatenate([mine, *[np.frombuffer(raw[k], _SEEN) for k in range(a, z) if k != own]])
                every = every[np.lexsort((~every["done"], every["id"]))]
                every = every[np.concatenate([[True], every["id"][1:] != every["id"][:-1]])]
                out.append(every[np.lexsort((every["id"], -every["sim"]))[:pool]].tobytes())
                codes.append(code[own])
            return [pa.RecordBatch.from_arrays([pa.array(query[edges[:-1]]), pa.array(codes, pa.binary()), pa.array(out, pa.binary())], ["query", "code", "seen"])]

        return merge

    state = checkpointed(starts.select("query", "code", "start").mapInArrow(first, "query long, code binary, seen binary"))
    expand, spent, share = EXPAND, 0, 0.0
    for _ in range(rounds):
        spent += expand
        pool = max(POOL, 2 * spent)
        asked = state.mapInArrow(asking(expand, pool), "node long, query long, code binary, low double")
        told = _met(asked, graph, salts).mapInArrow(answer, "query long, code binary, seen binary")
        work = merging(expand, pool)
        state = checkpointed(state.unionByName(told).repartition("query").sortWithinPartitions("query").mapInArrow(lambda it, work=work: by_group(it, work), "query long, code binary, seen binary"))
        before, share = share, found_share(state, floors) if floors else 1.0
        if share >= target or share == before and _settled(state):
            break
        expand *= 2
    graph.unpersist()
    return state.select("query", "seen")


def _met(asked: DataFrame, graph: DataFrame, salts: int) -> DataFrame:
    """Rows (asks, others, codes): nodes with those that ask them, about ``ASKS`` a row.

    Nodes lie where the graph has them, and their asks are sent there. A hub that very many queries ask at once is an exception: its asks are dealt
    into parts, and its neighbours are sent to each.
    """
    several = F.collect_list(F.struct("query", "code", "low")).alias("asks")
    hubs = asked.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB * ASKS)
    hubs = checkpointed(hubs.select("node", F.ceil(F.col("n") / ASKS).cast("int").alias("parts")))
    few = broadcast_if_small(hubs, MAX_BROADCAST_LEAVES)
    salt = F.pmod(F.xxhash64("query"), F.lit(salts)).alias("salt")
    plain = asked.join(broadcast_if_small(hubs.select("node"), MAX_BROADCAST_LEAVES), "node", "left_anti").repartition("node").groupBy("node", salt).agg(several)
    met = plain.hint("shuffle_hash").join(graph, "node").select("asks", "others", "codes")
    if hubs.isEmpty():
        return met
    dealt = asked.join(few, "node").withColumn("salt", F.pmod(F.xxhash64("query"), "parts").cast("int")).groupBy("node", "salt").agg(several)
    sent = graph.join(few, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return met.unionByName(dealt.join(sent, ["node", "salt"]).select("asks", "others", "codes"))


def _settled(state: DataFrame) -> bool:
    """True if no pool has anything left to expand."""

    def run(batches: Rows) -> Rows:
        for b in batches:
            open_ = sum(1 for raw in b.column(0).to_pylist() if len(_pick(np.frombuffer(raw, _SEEN), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([open_], pa.int64())], ["open"])

    return not state.select("seen").mapInArrow(run, "open long").where("open > 0").limit(1).count()


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_neighbours(embeddings: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest other rows found for every query row, ties to the smaller id.

    Unusable vectors (see ``usable``) and null ids take no part; vectors of different lengths have no cosine,
    so each length is searched by itself. Rows that repeat an id are rows of their own: each is a candidate for its repeats, and each that asks gets its own
    ``k`` results under the same query id. Fewer than ``k`` other rows give fewer results; an empty input gives none. Other columns are ignored.
    """
    dtype = "<f4" if embeddings.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = checkpointed(rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("row", F.monotonically_increasing_id()))
    lengths = sorted(r.d for r in rows.select(F.size("vec").alias("d")).distinct().collect())
    found = [_of_length(rows.where(F.size("vec") == d), d, k, dtype) for d in lengths or [1]]
    return reduce(DataFrame.unionByName, found)


def _of_length(rows: DataFrame, width: int, k: int, dtype: str) -> DataFrame:
    """``nearest_neighbours`` of rows (id, row, vec, asks) whose vectors have ``width`` components; ``row`` is unique."""
    classes = checkpointed(vector_classes(rows.select("id", "row", "vec"), k + 1, dtype))
    n = classes.count()
    graph = checkpointed(adjacency(descent_graph(classes, n, width), classes))
    asks = checkpointed(rows.where("asks").join(classes.select("node", "code", "vec"), "vec").select(F.col("id").alias("query_id"), F.col("row").alias("own_row"), "node"))
    starts = checkpointed(asks.select("node").distinct().join(classes, "node").select(F.col("node").alias("query"), "code", F.col("node").alias("start")))
    with _batches_of(rows.sparkSession, SEARCH_BATCH):
        seen = greedy_search(starts, graph, classes, width, k)

    def best(batches: Rows) -> Rows:
        for b in batches:
            query, node = [], []
            for q, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                pool = np.frombuffer(raw, _SEEN)
                tied = int((pool["sim"] >= pool["sim"][min(k + 1, len(pool) - 1)] - TIE).sum())
                near = pool["id"][: max(RESCORE, tied)].tolist()
                near = near if q in near else [q, *near]
                query += [q] * len(near)
                node += near
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(node, pa.int64())], ["query", "node"])

    pairs = seen.mapInArrow(best, "query long, node long")
    own = classes.select(F.col("node").alias("query"), F.col("even").alias("own"))
    scored = pairs.join(classes.select("node", "ids", "even"), "node").join(own, "query").select("query", "ids", cosine(F.col("own"), F.col("even")).alias("score"))
    # the k + 1 best rows of a query's vector hold the k best of each of its rows
    flat = scored.select("query", "score", F.explode("ids").alias("n")).select("query", "score", F.col("n.id").alias("vec_id"), F.col("n.row").alias("row"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    top = flat.withColumn("place", place).where(F.col("place") <= k + 1).select("query", "vec_id", "row", "score")
    each = asks.withColumnRenamed("node", "query").join(top, "query").where("row <> own_row")
    rank = F.row_number().over(Window.partitionBy("own_row").orderBy(F.desc("score"), "vec_id", "row"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
