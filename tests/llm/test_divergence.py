import random
import re
from collections import Counter

import duckdb
import pytest

from mnemospark.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string, p int"


def brute(docs, min_docs=10, top=10):
    """Docs (text, lang, source) to the expected rows, term by term."""
    docs = [tuple(x or "" for x in d) for d in docs]
    split = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    out = []
    for lang in {d[1] for d in docs}:
        own = [(s, split(t)) for t, x, s in docs if x == lang]
        frequency = Counter(w for _, ws in own for w in set(ws))
        kept = sorted(w for w, n in frequency.items() if n >= min_docs)
        n = {s: Counter() for s, _ in own}
        for s, ws in own:
            n[s].update(w for w in ws if w in set(kept))
        whole = sum(n.values(), Counter())
        v = len(kept)
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v) for w in kept} for s, c in [*n.items(), (None, whole)]}
        for s in n:
            pairs = sorted(((sum(f(p[s][w], p[o][w]) for w in kept), o) for o in n if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], p[None][w]), w) for w in kept if n[s][w] and p[s][w] > p[None][w]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, x, r) for r, (x, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", w, x, r) for r, (x, w) in enumerate(terms[:top], 1)]
    return sorted(out)


def audited(spark, docs, **kw):
    rows = [(i, t, lang, s, "x", "y", 0) for i, (t, lang, s) in enumerate(docs)]
    return sorted(tuple(r) for r in divergence.audit_sources(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect())


@pytest.mark.parametrize("bounds", [{}, {"SHARD": 20, "BLOCK": 2, "MOST_HELD": 5, "PIECE": 7}])
def test_equals_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(1)
    words = ["The", "naïve", "été", "Été", "É", "x1y", "don't", "日本 語", "z_z", "@A[", "`a{", "\x7fq", "the", "w" * 30] + [f"w{chr(97 + k)}" for k in range(12)]
    sources = ["a", "b", "B", "é", "c d", None, "", "rare", "zz"]
    docs = [(" ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randrange(30))), r.choice(["en", "en", "fr", None]), r.choice(sources)) for _ in range(300)]
    docs += [(None, "en", "only null"), ("", "en", "only empty"), ("123 !", "fr", "no terms"), ("alone", "de", "s"), (None, "de", "t"), ("", "it", "u")] + docs[:5]
    assert audited(spark, docs) == brute(docs)


def test_very_long_texts_and_one_hot_source(spark):
    docs = [("Long tail, " * 300_000, "en", "hot")] + [(f"tail of {'abcdefghij'[i % 10]}", "en", "hot" if i % 3 else "cold") for i in range(60)]
    assert audited(spark, docs, min_docs=2) == brute(docs, min_docs=2)


def test_counts_beyond_what_a_long_product_holds(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence.share(F.lit(10**13), F.lit(4 * 10**13), F.lit(1000)).alias("p")).head()
    assert row.p == 1 + 10**9 * (10**13 + 2) // (4 * 10**13 + 2000)


def test_counts_are_shuffled_once_for_each_key(spark, monkeypatch):
    plans = []

    def kept(df, cut=divergence.checkpointed):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(divergence, "checkpointed", kept)
    assert audited(spark, [("a b", "en", "x"), ("a c", "en", "y")], min_docs=1) == brute([("a b", "en", "x"), ("a c", "en", "y")], min_docs=1)
    keys = [re.sub(r"#\d+L?", "", k) for p in plans for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", p)]
    assert sorted(k for k in keys if "term" in k) == ["lang, source, term", "lang, term"]
    assert [k for k in keys if "shard" in k] == ["lang, shard, block"]


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    want = con.execute(divergence.ORACLE).fetchall()
    assert sorted(tuple(r) for r in queries.op12_divergence(spark, path).collect()) == sorted(want) and want
