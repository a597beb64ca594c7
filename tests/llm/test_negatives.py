import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, row string, key int, width string"


def brute(rows, k=5, m=10):
    """Rows (id, vector, label) to the expected tuples, in plain Python integers."""
    good = [(n, i, [math.floor(256 * x) if abs(x) < 2**50 else 256 * int(x) for x in v], y) for n, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, a, v, y in good:
        if a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), i, z) for o, i, w, z in good if o != n and len(w) == len(v)]
        for s, p, _ in sorted((x for x in scored if x[2] == y), key=lambda x: (-x[0], x[1]))[:k]:
            fits = sorted((x for x in scored if x[2] != y and 30 * s <= 100 * x[0] <= 90 * s), key=lambda x: (-x[0], x[1]))[:m]
            out += [(a, p, r, i, negatives._long(s), negatives._long(t)) for r, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", 0, "w") for i, v, y in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect())


def test_equals_brute_force_with_ties_repeats_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL", 40)
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(r.choice([11, 11, 11, 2]))], r.randrange(3)) for i in range(400)]
    rows += rows[:7] + [(100, [0.5] * 11, 1), (100, [0.25] * 11, 1), (101, [0.5] * 11, 2), (102, [], 1), (200, [], 1), (103, [], 0)]
    rows += [(None, [1.0] * 11, 1), (300, None, 1), (104, [1.0] * 11, None), (105, [1.0] * 10 + [None], 1), (106, [float("nan")] * 11, 1), (107, [float("inf")] * 11, 1)]
    assert mined(spark, rows) == brute(rows)


def test_components_beyond_doubles_are_exact(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 8, 14, 15]) for _ in range(4)], r.randrange(2)) for i in range(150)]
    rows += [(200, [1e300, 1.0, 0.0, 0.0], 0), (201, [1e300, 2.0, 0.0, 0.0], 0), (202, [5e299, 2.0, 0.0, 0.0], 1), (203, [5e299, 3.0, 0.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_sortable_texts_sort_as_integers_do():
    r = random.Random(5)
    numbers = [r.choice([-1, 1]) * r.randrange(10 ** r.randrange(1, 60)) for _ in range(500)] + [0, 9, 10, -9, -10, -99, -100]
    assert sorted(numbers) == sorted(numbers, key=negatives._sortable)


@pytest.mark.parametrize("score", [-7, 0, 1, 9, 10, 11, 999, 10**20])
def test_windows_are_the_integers_that_satisfy_the_bounds(score):
    low, high = negatives.score_window(score, 30, 90)
    for s in {low - 1, low, low + 1, high - 1, high, high + 1}:
        assert (30 * score <= 100 * s <= 90 * score) == (low <= s <= high)


def test_scan_leaves_candidates_before_all_dimensions_are_read():
    rng = np.random.default_rng(0)
    vectors = np.floor(256 * rng.normal(size=(2000, 64)))
    anchor = np.zeros(64)
    anchor[:8], anchor[8:] = 300, 1
    columns = negatives.Columns(vectors, np.arange(2000), np.arange(2000), np.zeros(2000, int))
    seen = []

    def keep(least, most):
        seen.append(len(least))
        return most >= negatives._kth(least, 5)

    at, scores = columns.scan(anchor, np.arange(2000), keep)
    assert seen[0] == 2000 and seen[1] < 500
    assert set(np.argsort(-(vectors @ anchor))[:5]) <= set(at.tolist())
    assert (scores == vectors[at] @ anchor).all()


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    want = con.execute(negatives.ORACLE).fetchall()
    got = queries.op13_negatives(spark, path).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and want
