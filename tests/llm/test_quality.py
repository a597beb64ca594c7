import random
import zlib

import numpy as np

from mnemospark.llm.linear import dual_coordinate_descent, logistic
from mnemospark.llm.quality import _SIZE, LEAST_DOCUMENTS, fit_features, fit_quality, indicators, score_quality


def test_indicators_cover_the_whole_text():
    a = set(indicators(b"abc"))
    assert {97, 98, 99, _SIZE - 1} <= a
    assert set(indicators(None)) == set(indicators(b""))
    long = b"a" * 300_000 + b"zq"
    assert {ord("z"), ord("q")} <= set(indicators(long))


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    w = dual_coordinate_descent(np.arange(0, 601, 3), np.tile(np.arange(3), 200), x.ravel(), y, 3, np.full(200, 10.0), epochs=50)
    assert ((x @ w > 0) == (y > 0)).mean() > 0.97
    c = logistic(np.column_stack([x @ w, np.ones(200)]), y)
    assert c[0] > 0


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(500):
        good = int(i % 3 > 0)
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(8, 60))]
        if not good:
            words = [w + rng.choice(["***", "$$$", "!!"]) for w in words] if i % 2 else [words[0]] * 40
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, good, 0))
    odd = [(900, None, None, None), (901, "", None, None), (902, "abc " * 50000, None, None), (None, "ab", None, None), (901, "", None, None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string, held_out int")
    lab = spark.createDataFrame(labels + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit_quality(df, lab)
    got = score_quality(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    by, truth = {r.doc_id: r for r in got}, {i: q for i, q, _ in labels}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((by[i].score >= 0.3) == bool(truth[i]) for i in test) / len(test) > 0.95
    assert by[900].score == by[901].score
    assert all(0 <= r.score <= 1 for r in got)
    assert score_quality(df.limit(0), model).count() == 0
    one = fit_quality(df, lab.limit(0))
    assert score_quality(df, one).count() == len(got)


def labelled_texts(n=120):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 30))]
        out.append((" ".join(w + "!!" if i % 2 else w for w in words), 1 - i % 2))
    return out


def test_model_matches_a_direct_implementation():
    rows = [(set(indicators(t.encode()).tolist()), y) for t, y in labelled_texts()]
    y = np.array([label for _, label in rows])
    model = fit_features([np.array(sorted(s), np.int32) for s, _ in rows], y)
    n = {c: sum(label == c for _, label in rows) for c in (0, 1)}
    count = {c: {} for c in (0, 1)}
    for s, label in rows:
        for f in s:
            count[label][f] = count[label].get(f, 0) + 1
    ratio = {}
    for f in set(count[0]) | set(count[1]):
        p, q = count[1].get(f, 0), count[0].get(f, 0)
        ratio[f] = np.log((p + 1) / (n[1] + 2) / ((q + 1) / (n[0] + 2))) if p + q >= LEAST_DOCUMENTS else 0.0
    ratio[_SIZE - 1] = 1.0
    assert all(abs(model.ratio[f] - r) < 1e-5 for f, r in ratio.items())

    def unit(s):
        norm = np.sqrt(sum(ratio[f] ** 2 for f in s))
        return {f: ratio[f] / norm for f in s if ratio[f]}

    units, sign = [unit(s) for s, _ in rows], np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, len(y) / (2 * n[1]), len(y) / (2 * n[0]))
    loss = lambda w: 0.5 * sum(v * v for v in w.values()) + sum(c * max(0.0, 1 - s * sum(w.get(f, 0) * v for f, v in u.items())) for c, s, u in zip(cost, sign, units))
    w, best = {}, np.inf
    for step in range(1, 1500):  # plain subgradient descent on the same objective
        g = dict(w)
        for c, s, u in zip(cost, sign, units):
            if s * sum(w.get(f, 0) * v for f, v in u.items()) < 1:
                for f, v in u.items():
                    g[f] = g.get(f, 0) - c * s * v
        w = {f: w.get(f, 0) - g[f] / (20 + step) for f in g}
        best = min(best, loss(w)) if step % 50 == 0 else best
    mine = loss({f: float(model.weight[f]) for f in ratio})
    assert mine <= best * 1.02
    for text, _ in labelled_texts()[:10]:
        ids = set(indicators(text.encode()).tolist())
        norm = np.sqrt(sum(ratio.get(f, 0) ** 2 for f in ids)) + 1e-9
        margin = sum(float(model.weight[f]) * ratio.get(f, 0) / norm for f in ids)
        assert abs(model.score(text.encode()) - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-4


def test_the_fit_is_bounded_in_size_and_repeats(spark):
    rows = [(i, t) for i, (t, _) in enumerate(labelled_texts(200))] + [(3, "other text")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(labelled_texts(200))], "doc_id long, quality int, toxic int")
    a, b = fit_quality(df, lab), fit_quality(df.repartition(5), lab.repartition(3))
    assert np.allclose(a.weight, b.weight) and a.slope == b.slope
    few = fit_quality(df, lab, most_ids=2000)
    assert not np.allclose(a.ratio, few.ratio)
    empty = fit_quality(df, lab, most_ids=0)
    assert score_quality(df, empty).where("score <> 0.5").count() == 0
