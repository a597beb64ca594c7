import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm.simhash import RADIUS, drop_near_duplicates, near_links, simhash_components, spanning_links, text_fingerprint


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in rows:
        for b, y in rows:
            if a < b and bin(x ^ y).count("1") <= RADIUS:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


TEXTS = ["", None, " \t\n", "One", "one two", "a b c", "A B C", "Été à la plage  x y z", "\x1c a \x1f b", "x " * 500, "w%d " * 3]


def test_fingerprint_matches_brute_force():
    for t in TEXTS:
        assert text_fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_spanning_links_keep_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            v = int(b)
            for k in rng.integers(0, 64, 3):
                v ^= 1 << int(k)
            fps.add(v)
    fps = sorted(fps)
    want = brute_components(list(enumerate(fps)))
    root = list(range(len(fps)))
    for a, b in spanning_links(np.arange(len(fps)), np.array(fps, np.uint64)):
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    assert {i: r for i, r in enumerate(root)} == want


def near_set(n=60):
    rng = np.random.default_rng(3)
    rows, v = [], int(rng.integers(0, 2**63))
    for i in range(n):
        rows.append((i, v))
        v ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
    return rows


def test_tiles_lose_no_link(spark):
    rows = list({fp: (i, fp) for i, fp in near_set()}.values())
    signed = [(i, fp - 2**64 if fp >= 2**63 else fp) for i, fp in rows]
    df = spark.createDataFrame(signed, "rep long, fp long")
    want = brute_components(rows)
    for tile in (4, 4096):
        root = {i: i for i, _ in rows}
        for a, b in near_links(df, tile=tile).collect():
            ra, rb = root[a], root[b]
            root = {i: min(ra, rb) if r in (ra, rb) else r for i, r in root.items()}
        assert root == want


def test_components_edge_cases(spark):
    rows = [(i, t, "s", 7) for i, t in enumerate(TEXTS)] + [(3, "One", "s", 7), (None, "lost", "s", 7), (90, "one", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component long")
    got = simhash_components(df).collect()
    assert len(got) == len(rows)
    keep = [(i, brute_fingerprint(t)) for i, t, _, _ in rows if i is not None]
    want = brute_components(list(dict(keep).items()))
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).count() == 0
    assert drop_near_duplicates(df).count() == 0


def test_spark_hash_is_the_same_function(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).head()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_different_texts_under_one_id_are_judged_apart(spark):
    a = " ".join(f"river{i} stone{i}" for i in range(300))
    near, other, third = a + " end", "nothing like the others in any word of it", "yet another text that stands for itself alone"
    assert 0 < bin(text_fingerprint(a.encode()) ^ text_fingerprint(near.encode())).count("1") <= RADIUS
    rows = [(3, a), (5, near), (5, other), (7, third), (7, third), (7, other), (9, "one more text by itself"), (9, "a last one of its own kind")]
    for order in (rows, rows[::-1]):
        kept = drop_near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3))
        assert sorted(map(tuple, kept.collect())) == sorted({rows[0], rows[2], rows[3], rows[6], rows[7]})
    assert {r.component_id for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 5").collect()} == {3, 5}
