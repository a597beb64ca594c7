import random

import corpus_pipeline
from mnemospark.llm.simhash import text_fingerprint

BAD = ["grobnak", "vilmosh"]


def write(spark, root):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ma", "lo", "ti", "ren", "sa", "du", "pel", "ko"]) for _ in range(rng.randint(1, 4)))
    bench = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(60, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            words[3] = rng.choice(BAD)
        text = " ".join(words)
        if i == 7:
            text += " password=hunter22secret and more"
        if i == 11:
            text += " " + bench[2][1] + " tail words here"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    docs.append((300, docs[1][1], "en", "s1", len(docs[1][1])))
    docs.append((301, docs[1][1].upper(), "en", "s1", len(docs[1][1])))
    docs += [(302, "", None, None, 0), (303, None, "en", "s0", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return docs


def test_stages_in_order_take_effect(spark, tmp_path):
    docs = write(spark, str(tmp_path))
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        frame = spark.read.parquet(f"{tmp_path}/{at}")
        seen[name] = {r.doc_id: r for r in frame.collect()}
        if at < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i, *_ in docs if not (i < 240 and i % 5 == 0)}
    assert len(clean & set(seen["toxicity"])) >= 0.98 * len(clean)
    assert len(set(range(0, 240, 5)) & set(seen["toxicity"])) <= 4
    prints = {}
    for i in sorted(seen["toxicity"]):
        text = seen["toxicity"][i].text
        prints.setdefault(text_fingerprint(text.encode() if text else None), i)
    assert {300, 301, 303}.isdisjoint(seen["near_duplicates"])
    assert set(seen["near_duplicates"]) <= set(prints.values())
    assert 11 in seen["near_duplicates"] and 11 not in seen["decontamination"]
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {11}
    assert "hunter22secret" not in seen["secrets"][7].text and "[SECRET]" in seen["secrets"][7].text
    assert seen["secrets"][7].n_chars == len(seen["secrets"][7].text)
    assert set(seen["secrets"]) == set(seen["decontamination"])
    assert set(seen["mixture"]) <= set(seen["secrets"])
    assert all(r.taken > 0 and r.taken % r.size == 0 and r.taken <= 3 * r.size for r in seen["mixture"].values())
    again = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {i: r.taken for i, r in seen["mixture"].items()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, row string, blob string, mark string, size string, own string, `dotted.name` string"


def tables(spark, root, docs, schema=ODD):
    spark.createDataFrame(docs, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").limit(2 if docs else 0).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, "seven wise owls watched the quiet harbour lights until morning came")], "item_id long, text string").limit(1 if docs else 0).write.parquet(f"{root}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "taken", "dotted.name"} <= set(out.columns)


def test_odd_rows_and_clashing_columns_stay_whole(spark, tmp_path):
    rest = ("en", "s", 0, "k", "_k", "r", "b", "m", "sz", "o", "d")
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (3, 5, 7, 11))
    long = " ".join(word(i) for i in range(60_000))
    texts = [(1, "alpha beta gamma delta password=abcdefgh"), (None, "no number here but words"), (None, "no number here but words"), (2, None), (3, ""), (4, "same id one text"), (4, "same id another wholly different text"), (5, long), (6, long + " token: secretvalue9")]
    tables(spark, str(tmp_path), [(i, t, *rest) for i, t in texts])
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = frame.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if at < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{at}")
        frame = spark.read.parquet(f"{tmp_path}/{at}")
        kept[name] = sorted(((r.doc_id is None, r.doc_id, r.text) for r in frame.collect()), key=str)
        assert all(r._key == "_k" and r["dotted.name"] == "d" for r in frame.collect())
    assert len(kept["toxicity"]) == 9
    assert [i for _, i, _ in kept["near_duplicates"]].count(None) == 2
    assert {t for _, i, t in kept["near_duplicates"] if i == 4} == {"same id one text", "same id another wholly different text"}
    assert len([1 for _, i, t in kept["near_duplicates"] if not t]) == 1
    assert len(kept["secrets"]) == len(kept["decontamination"]) == len(kept["near_duplicates"])
    assert not any("abcdefgh" in (t or "") or "secretvalue9" in (t or "") for _, _, t in kept["secrets"])
    assert any(t and len(t) > 200_000 for _, _, t in kept["secrets"])


def test_a_named_ledger_is_kept_and_changes_no_row(spark, tmp_path):
    rows = [(i, f"text number {i} with token=abcdef{i}{i}", "en", "s", 0) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = sorted(map(str, corpus_pipeline.secrets(spark, frame, "").collect()))
    spark.conf.set("spark.mnemospark.secrets.ledger", str(tmp_path / "ledger"))
    try:
        for _ in range(2):
            assert sorted(map(str, corpus_pipeline.secrets(spark, frame, "").collect())) == plain
        ledger = spark.read.parquet(str(tmp_path / "ledger"))
        assert ledger.count() == ledger.dropDuplicates(["blob", "rule"]).count() == 36
    finally:
        spark.conf.unset("spark.mnemospark.secrets.ledger")


def test_null_empty_and_short_rows_pass_the_toxicity_stage(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = docs.unionByName(spark.createDataFrame([(400 + n, " ".join(["ma"] * n), "en", "s0", n) for n in range(8)] + [(None, None, None, None, None)], docs.schema))
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, odd, str(tmp_path)).collect()
    assert {302, 303, None, *range(400, 408)} <= {r.doc_id for r in kept}


def test_decontamination_takes_a_long_run_of_capitalised_words(spark, tmp_path):
    write(spark, str(tmp_path))
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").where("item_id = 2").first().text
    run = "we met " + "Anna " * 20000
    frame = spark.createDataFrame([(1, run, "en", "s", len(run)), (2, f"{run} {item}", "en", "s", 0), (3, "clean text of five words", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, frame, str(tmp_path))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: run, 3: "clean text of five words"}
