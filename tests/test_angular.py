import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import angular as A
from mnemospark.operators import dedup as D
from mnemospark.operators import recall as R

SCHEMA = "id long, g string, vec array<double>"


def cloud(n, centres, noise, seed, d=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    return [(i, f"g{i % 2}", (middle[i % centres] * rng.uniform(0.5, 3) + noise * rng.normal(size=d)).tolist()) for i in range(n)]


ODD = [(9000, "g0", None), (9001, "g0", [0.0] * 12), (9002, "g0", []), (9003, "g0", [1.0, 2.0, 3.0]), (9004, None, [1.0] * 12), (9007, None, [1.0] * 12), (9005, "g0", [1.0, 2.0, 3.1]), (9006, "alone", [1.0, 0.0])]


def brute(left, right, least, strict=False):
    out = set()
    for i, g, v in left:
        for j, h, w in right:
            if g is not None and g == h and v and w and (left is not right or i < j):
                d = min(len(v), len(w))
                x, y = np.array(v[:d]), np.array(w[:d])
                n = np.sqrt((x @ x) * (y @ y))
                if n > 0 and (x @ y / n > least if strict else x @ y / n >= least):
                    out.add((i, j))
    return out


@pytest.mark.parametrize("distance", [0.001, 0.05, 0.4])
def test_pairs_equal_all_pairs(spark, monkeypatch, distance):
    monkeypatch.setattr(D, "PART", 20)
    rows = cloud(400, 9, 0.4, 1) + [(1000 + k, "g0", cloud(1, 1, 0, 5)[0][2]) for k in range(60)] + ODD
    got = D.near_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), distance, ["g"]).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == brute(rows, rows, 1 - distance)


def test_two_sides_and_probe_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 20)
    monkeypatch.setattr(R, "PROBE_PART", 20)
    left, right = cloud(120, 9, 0.4, 1) + ODD, cloud(300, 9, 0.4, 2)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = D.similar_pairs(a, b, 0.8, ["g"]).collect()
    assert {(r.a, r.b) for r in got} == brute(left, right, 0.8, True) and len(got) == len(brute(left, right, 0.8, True))
    probe = R.near_probe(a.withColumnRenamed("g", "scope_id"), b.withColumnRenamed("g", "scope_id").withColumn("is_active", F.col("id") % 3 > 0), 0.2, 1000).collect()
    assert {(r.asked_id, r.id) for r in probe} == {(i, j) for i, j in brute(left, [r for r in right if r[0] % 3], 0.8) if i != j}


def test_most_tiles_are_left_out_where_vectors_have_groups(spark):
    rows = A.directed(spark.createDataFrame(cloud(3000, 30, 0.15, 3, d=64), SCHEMA), ["g"])
    parts = A.parted(rows, A.pivots(rows, ["g"]), ["g"], 64).cache()
    n = [r["count"] for r in parts.select("g", "part").distinct().groupBy("g").count().collect()]
    left = A.tiles(parts, parts, A.widest(0.95), ["g"], True).count()
    every = sum(k * (k + 1) // 2 for k in n)
    print(f"tiles compared: {left} of {every}")
    assert left < 0.3 * every


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.near_pairs(none, 0.1, ["g"]).count() == 0
    assert D.similar_pairs(none, spark.createDataFrame(ODD, SCHEMA), 0.1, ["g"]).count() == 0


def test_blocks_of_one_part_equal_all_pairs(spark):
    rows = cloud(300, 9, 0.4, 1) + ODD
    got = D.near_pairs(spark.createDataFrame(rows, SCHEMA), 0.05, ["g"]).collect()
    assert {(r.a, r.b) for r in got} == brute(rows, rows, 0.95) and len(got) == len(brute(rows, rows, 0.95))
