import random
import zlib

import numpy as np

from mnemospark.llm.labelled import held_out
from mnemospark.llm.toxicity import RISE, Landmarks, _norms, drop_toxic, fit_toxicity, forms, score_toxicity, sentence_windows, subsequences
from pyspark.sql import functions as F

BAD = ["grobnak", "vilmosh", "terrachun"]
SYLLABLES = ["ma", "lo", "ti", "ren", "sa", "du", "pel", "ko"]


def brute_kernel(a, b, decay=0.6, span=5):
    def weights(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + span)):
                    u = s[i] + s[j] + s[k]
                    out[u] = out.get(u, 0) + decay ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_matches_brute_force():
    words = ["idiot", "idxiot", "stupid", "banana", "bababa", "xyz"]
    d = Landmarks(words).kernel(words)
    ids, w = subsequences(words)
    for i, a in enumerate(words):
        assert np.isclose(_norms(ids, w)[i], np.linalg.norm(np.bincount(ids[i], w[i])))
        for j, b in enumerate(words):
            assert abs(float(d[i, j]) - brute_kernel(a, b)) < 1e-5


def test_windows_and_forms():
    assert sentence_windows("You i d i o t x!") == {"you", "i", "d", "o", "t", "x!", "idiot"}
    assert forms("i.d.i.o.t")[0] == "^idiot"
    assert forms("...") == []
    assert len("".join(forms("a" * 100))) >= 100


def corpus(n=900):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), "en", "s", i))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    odd = [(5000, None, None, None, 0), (5001, "", None, None, 0), (5002, "ma lo v-i-l-m-o-s-h ti", None, None, 0), (5003, "lo groxbnak ma", None, None, 0), (5004, "sa ren ma " * 20000, "en", "s", 1), (None, "ti ma", None, None, 0), (5001, "", None, None, 0)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score string, held_out int")
    lab = spark.createDataFrame(labels + [(7, None, None), (8, 1, 5), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(df, lab)
    got = score_toxicity(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in labels}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum((by[i].score >= 0.5) == bool(truth[i]) for i in test)
    assert right / len(test) > 0.95
    assert by[5002].score > 0.5 and by[5003].score > 0.5
    assert by[5000].score == by[5001].score < 0.5
    assert by[5004].score < 0.5
    assert all(0 <= r.score <= 1 for r in got)
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.score < 0.5 for r in got)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_toxicity(df, none)
    assert score_toxicity(df, model).count() == 1
    assert score_toxicity(df.limit(0), model).count() == 0


def test_held_out_is_crc(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert {r.id for r in got if r.h} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}


def direct_score(model, text):
    """The score of a text from the brute-force kernel, word by word."""
    members = {}
    for w, c in zip(model.landmarks.words, model.landmarks.clusters):
        members.setdefault(c, []).append(w)

    def weights(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + 5)):
                    out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + 0.6 ** (k - i - 2)
        n = np.sqrt(sum(v * v for v in out.values())) or 1.0
        return {u: v / n for u, v in out.items()}

    means = []
    for c in range(model.landmarks.size):
        mean = {}
        for w in members[c]:
            for u, v in weights(w).items():
                mean[u] = mean.get(u, 0) + v
        n = np.sqrt(sum(v * v for v in mean.values()))
        means.append({u: v / n for u, v in mean.items()})
    words = sentence_windows(text, model.whole, model.heads) if text else set()
    most, total, every = np.zeros(len(means)), np.zeros(len(means)), 0.0
    for w in words:
        best = 0.0
        for f in forms(w):
            near = np.array([min(1.0, max(0.0, (sum(v * m.get(u, 0) for u, v in weights(f).items()) - r) / RISE)) for m, r in zip(means, model.reach)])
            most, total, best = np.maximum(most, near), total + near, max(best, near.max())
        every += best
    x = np.concatenate([most, np.log1p(total), [np.log1p(every), np.log1p(len(words)) / 8]])
    return 1 / (1 + np.exp(-(model.slope * (x @ model.weight + model.bias) + model.offset)))


def test_scores_match_a_direct_implementation_and_garbled_insults_are_found(spark):
    docs, labels = corpus(600)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    model = fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [t for _, t, *_ in docs[:40]] + ["", "v-i-l-m-o-s-h", "ma grobnakgrobnakgrobnak.terrachun lo"]
    assert np.allclose(model.scores(model.features(texts)), [direct_score(model, t) for t in texts], atol=1e-4)
    assert model.scores(model.features([None])) == model.scores(model.features([""]))
    ways = {
        "as it is": lambda w: w, "inserted": lambda w: w[:3] + "x" + w[3:], "doubled": lambda w: w[:2] + w[1] + w[2:], "gap": lambda w: w[:3] + w[4:], "dotted": lambda w: w[:3] + "." + w[3:],
        "spaced": " ".join, "split": lambda w: w[:4] + " " + w[4:], "dashed": "-".join,
    }
    clean = [t for (_, t, *_), (_, _, toxic) in zip(docs, labels) if not toxic][:60]
    assert (model.scores(model.features(clean)) >= 0.5).mean() <= 0.02
    for name, way in ways.items():
        garbled = [" ".join([*t.split()[:4], way(BAD[k % 3]), *t.split()[4:]]) for k, t in enumerate(clean)]
        assert (model.scores(model.features(garbled)) >= 0.5).mean() >= 0.9, name


def test_repeated_ids_and_labels(spark):
    docs, labels = corpus(300)
    rows = [d[:2] for d in docs] + [(4, "other text")] * 30 + [(None, "x y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")
    one, two = fit_toxicity(df, lab), fit_toxicity(df.repartition(7), lab.repartition(3))
    assert np.allclose(one.weight, two.weight) and one.landmarks.words == two.landmarks.words
    assert score_toxicity(df, one).count() == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_toxic(empty, fit_toxicity(empty, lab)).count() == 0


def test_empty_and_short_clean_texts_are_clean_where_all_fitted_texts_are_long(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = fit_toxicity(docs, labels)
    wordless = model.scores(model.features(["", None, " \n\t ", "!!! --- 12"]))
    assert (wordless < 0.4).all()
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where("text is not null").orderBy("doc_id").limit(500).select("text").collect()
    for n in range(1, 11):
        assert (model.scores(model.features([" ".join(r.text.split()[:n]) for r in clean])) >= 0.5).mean() <= 0.01, n
    assert (model.scores(model.features(["hello", "the house", "le chien et la maison", "one two three four five"])) < 0.5).all()
    seen = score_toxicity(docs, model).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    assert sum(r.score >= 0.5 for r in seen if r.toxic == 1) >= 0.9 * sum(r.toxic == 1 for r in seen)
    assert sum(r.score >= 0.5 for r in seen if r.toxic == 0) <= 0.005 * sum(r.toxic == 0 for r in seen)
