import hashlib
import re

import pytest

from mnemospark.llm.mixture import mix, take_mixture

SCHEMA = "doc_id long, text string, source string, size string, taken int"


def brute_targets(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {k: 1 + i % 3 for i, k in enumerate(keys)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in keys if k not in fixed]
        if not free:
            return fixed
        share = (total - sum(fixed.values())) / sum(w[k] for k in free)
        over = [k for k in free if 3 * sizes[k] <= w[k] * share]
        if not over:
            return fixed | {k: w[k] * share for k in free}
        fixed |= {k: 3.0 * sizes[k] for k in over}


def hash_of(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:9], 16)


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = {}
    for (_, _, s), n in zip(rows, size):
        by[s] = by.get(s, 0) + n
    target, out = brute_targets(by), []
    for s in by:
        whole = int(target[s] // by[s]) if by[s] else 0
        left, run, points = target[s] - whole * by[s], 0, {}
        for (i, _, x), n in zip(rows, size):
            if x == s and n:
                points[hash_of(i)] = points.get(hash_of(i), 0) + n
        chosen = set()
        for h in sorted(points):
            if run + points[h] > left:
                if run + points[h] - left < left - run:
                    chosen.add(h)
                break
            run += points[h]
            chosen.add(h)
        out += [(i, n, by[s], target[s], n * (whole + (hash_of(i) in chosen))) for (i, _, x), n in zip(rows, size) if x == s]
    return out


def sample():
    rows = [(i, "w " * (i % 17) + ("\tx\ny\x0b" if i % 3 else ""), f"s{i % 5}" if i % 4 else "s0") for i in range(300)]
    rows += [(1000, "big " * 5000, "tiny"), (1001, None, "none"), (1002, "", "none"), (None, "a b", None), (None, "c", None), (7, "again twice", "s1"), (7, "again twice", "s1")]
    return rows + [(2000 + i, "one", "é") for i in range(3)]


def test_mix_matches_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(map(tuple, mix(df).collect()), key=key), sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g[0], g[1], g[2], g[4]) == (w[0], w[1], w[2], w[4])
        assert g[3] == pytest.approx(w[3])
    full = take_mixture(df)
    assert full.columns == ["doc_id", "text", "source", "source_size", "target", "taken"] or set(full.columns) == {"doc_id", "text", "source", "size", "source_size", "target", "taken"}
    assert sorted(r.taken for r in full.collect()) == sorted(w[4] for w in want if w[4])


def test_each_source_comes_near_its_target(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 6}", "", 0) for i in range(3000)], SCHEMA)
    sums = mix(df).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 5 for r in sums)


def test_empty_and_all_blank(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix(spark.createDataFrame([(1, "", "a", "", 0), (2, None, None, "", 0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]
