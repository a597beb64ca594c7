import numpy as np
from pyspark.sql import functions as F

from mnemospark.llm import neighbours
from mnemospark.llm.neighbours import _PAIR, DEGREE, _first_lists, _merged, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=5):
    keep = {}
    for i, v, *_ in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            keep[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in keep:
        if q % 50 == 0:
            unit = lambda x: x / np.linalg.norm(x)
            out[q] = sorted((-round(float(unit(keep[q]) @ unit(keep[i])), 9), i) for i in keep if i != q)[:k]
    return out


def check(spark, rows, least):
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q for q, w in want.items() if w} == set(by)
    hit = total = 0
    for q, w in want.items():
        mine = sorted(by.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert len(mine) == len(w)
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(mine, mine[1:]))
        hit += len({m[1] for m in mine} & {i for _, i in w})
        total += len(w)
    assert hit >= least * total
    return by, want


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), 1, "x") for i in range(1500)]
    check(spark, rows, 0.95)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), 1, "x") for i in range(120)]
    same = [float(x) for x in range(1, 9)]
    rows += [(200 + i, same, 1, "x") for i in range(60)]
    rows += [(500, None, 1, "x"), (550, [0.0] * 8, 1, "x"), (600, [1.0, None] + [1.0] * 6, 1, "x"), (650, [float("nan")] * 8, 1, "x"), (700, [float("inf")] * 8, 1, "x"), (750, [1.0, 2.0], 1, "x"), (None, same, 1, "x")]
    by, want = check(spark, rows, 0.95)
    for q in (200, 250):
        assert [m[1] for m in sorted(by[q])] == [i for _, i in want[q]]


def test_few_and_none(spark):
    rows = [(0, [1.0] * 8, 1, "x"), (1, [2.0] * 7 + [1.0], 1, "x")]
    check(spark, rows, 1.0)
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest_neighbours(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def unit_recall(spark, x, asks, k=5):
    """Share of the true ``k`` nearest of every ``asks``-th row of ``x`` that are found."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % asks == 0, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), asks):
        sims = u @ u[q]
        sims[q] = -2
        hit += len(got[q] & set(np.argsort(-sims)[:k].tolist()))
    return hit / (k * len(range(0, len(x), asks)))


def test_near_copies_are_told_apart(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=64)
    near = one + 0.003 * rng.normal(size=(1200, 64))
    peak = 0.003 * rng.normal(size=(800, 64))
    peak[:, 5] += 1
    assert unit_recall(spark, np.concatenate([near, peak]).astype(np.float32), 40) >= 0.95


def test_opposite_vectors_and_outliers_are_met(spark):
    rows = [(0, [1.0, 2.0] * 4, 1, "x"), (1, [-1.0, -2.0] * 4, 1, "x")]
    check(spark, rows, 1.0)
    rng = np.random.default_rng(8)
    nodes = [(i, v.astype("<f8").tobytes()) for i, v in enumerate(np.concatenate([5 + 0.1 * rng.normal(size=(900, 8)), rng.normal(size=(40, 8))]))]
    lists = _merged(_first_lists(spark.createDataFrame(nodes, "node long, code binary"), len(nodes), 8, DEGREE), DEGREE).collect()
    assert len(lists) == len(nodes)
    assert {len(r.pairs) // _PAIR.itemsize for r in lists} == {DEGREE}


def test_recall_holds_as_the_table_grows(spark):
    rng = np.random.default_rng(12)
    for n, asks in ((2000, 20), (12000, 50)):
        assert unit_recall(spark, rng.normal(size=(n, 64)).astype(np.float32), asks) >= 0.9


def test_lengths_and_scales_are_searched_each_by_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 1, "x") for i in range(100)]
    rows += [(1000 + i, rng.normal(size=3).tolist(), 1, "x") for i in range(60)]
    rows += [(2000 + i, (rng.normal(size=5) * 10.0 ** (3 * (i % 12))).tolist(), 1, "x") for i in range(60)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vecs = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    assert set(got) == {0, 50, 1000, 1050, 2000, 2050}
    for q, mine in got.items():
        unit = lambda x: x / np.linalg.norm(x)
        want = sorted((-round(float(unit(vecs[q]) @ unit(v)), 9), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))[:5]
        assert {i for _, i, _ in mine} == {i for _, i in want}
    wide = [(0, [1e200, 2e200], 1, "x"), (1, [2e-200, 4e-200], 1, "x"), (2, [-1e200, 1.0], 1, "x")]
    far = nearest_neighbours(spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int, score string"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in far] == [1, 2] and abs(far[0].score - 1) < 1e-9


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(9)
    vecs = [(i // 2, rng.normal(size=8).astype(np.float32)) for i in range(300)] + [(50, v) for v in np.repeat(rng.normal(size=(1, 8)), 9, axis=0).astype(np.float32)]
    rows = [(i, v.tolist(), 1, "x") for i, v in vecs]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    u = np.stack([v / np.linalg.norm(v) for _, v in [(i, v.astype(float)) for i, v in vecs]])
    want = {}
    for n, (q, _) in enumerate(vecs):
        if q % 50 == 0:
            order = sorted((-round(float(u[n] @ u[m]), 9), i) for m, (i, _) in enumerate(vecs) if m != n)[:5]
            want.setdefault(q, []).extend((k, i, -s) for k, (s, i) in enumerate(order, 1))
    assert {q: sorted(x[:2] for x in mine) for q, mine in got.items()} == {q: sorted(x[:2] for x in w) for q, w in want.items()}


def test_hubs_that_all_queries_ask_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKS", 4)
    monkeypatch.setattr(neighbours, "HUB", 2)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=16)
    assert unit_recall(spark, (centre + 0.05 * rng.normal(size=(600, 16))).astype(np.float32), 6) >= 0.95
    asked = spark.createDataFrame([(n % 3, q, b"", 0.0) for q in range(60) for n in range(q % 3 + 1)], "node long, query long, code binary, low double")
    graph = spark.createDataFrame([(n, b"a", b"b") for n in range(3)], "node long, others binary, codes binary")
    met = neighbours._met(asked, graph, 1)
    assert "salt" in "".join(line for line in met._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(node" in line)
    found = met.collect()
    assert sorted(q.query for r in found for q in r.asks) == sorted(r.query for r in asked.collect())
    assert max(len(r.asks) for r in found) < 20
