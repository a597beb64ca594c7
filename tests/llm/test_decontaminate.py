import re
from collections import defaultdict

from mnemospark.llm.decontaminate import _SPLIT, NAMES, NUMBERS, UNITS, canonical_text, canonical_words, contaminated, drop_contaminated
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, item_id string, w int"
LONG = "the quick river carried seven small boats past the old stone mill before evening fell on the valley"
ITEMS = [
    (0, LONG),
    (1, "We know that Alice bought 12 apples for 3 kg of flour and later sold 12 apples in town"),
    (2, "too short here"),
    (3, None),
    (None, "nobody owns this item but it has words enough"),
    (4, "éa éb éc éd ée éf"),
]


def docs():
    noise = "lorem ipsum dolor sit amet consectetur " * 5
    texts = [
        None, "", LONG, noise + LONG.upper() + " " + noise, noise + LONG.replace(" ", "\n,- ") + noise, LONG.replace("boats", "ships"), " ".join(LONG.split()[:9]) + noise,
        "We know that Maria bought 40 apples for 9 miles of flour and later sold 40 apples in town",
        "We know that Maria bought 40 apples for 9 kg of flour and later sold 41 apples in town",
        "x We know that Alice bought 12 apples for 3 kg of flour and later sold 12 apples in town " + "pad " * 30000,
        "Éa éB éc, éd. ée éf!", "too short here", (LONG + " ") * 3,
    ]
    return [(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, "nothing", "x", 1), (None, LONG, None, None), (None, "clean text of five words", None, None)]


def words(text):
    import regex

    for pattern, new in (NAMES, *(NUMBERS if regex.search("[0-9]", text) else ())):
        text = regex.sub(pattern, regex.sub(r"\$(\d)", r"\\g<\1>", new), text)
    return [w for w in regex.split(_SPLIT.replace("\\p{Punct}", r"!-/:-@\[-`{-~"), text.lower(), flags=regex.V0) if w]


def slot(w):
    return "\ue000" <= w[0] < "\ue003"


def brute(rows, items):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[(i, t if i is None else None)].append(words(t or ""))
    out = set()
    for item, t in items:
        iw = words(t or "")
        if item is None:
            continue
        for key, texts in by.items():
            lines = defaultdict(list)
            for dw in texts:
                for a in range(len(dw) - 4):
                    for b in range(len(iw) - 4):
                        x, y = dw[a : a + 5], iw[b : b + 5]
                        form = lambda ws: [w[0] if slot(w) else w for w in ws]
                        if form(x) == form(y) and sum(not slot(w) for w in y) >= 2:
                            lines[a - b].append((b, [(q, p) for p, q in zip(x, y) if slot(p)]))
            covered = set()
            for found in lines.values():
                pairs = {p for _, ps in found for p in ps}
                if len(pairs) == len({a for a, _ in pairs}):
                    covered |= {b + k for b, _ in found for k in range(5)}
            if iw and len(covered) / len(iw) >= 0.8:
                out.add((key[0], item, len(covered), len(iw)))
    return out


def test_matches_brute_force(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = contaminated(df, bench)
    assert {(r.doc_id, r.item_id, r.matched_words, r.item_words) for r in got.collect()} == brute(docs(), ITEMS)
    caught = {r.doc_id for r in got.collect()}
    assert {2, 3, 4, 5, 7, 9, 10, 12, None} <= caught
    assert not caught & {0, 1, 6, 8, 11}
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "6", "8", "11", "None"])


def test_words_like_the_brute_force(spark):
    texts = [t for _, t, *_ in docs() if t] + ["She met John Smith Jones, Bob; Ann", "1,000,000 kg 3.5 km x5y 7 Hours", "a1.2.3"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical_words(canonical_text(F.col("t"))).alias("w")).collect()
    assert {r.t: r.w for r in got} == {t: words(t) for t in texts}
    assert re.fullmatch(UNITS, "miles")


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    some = spark.createDataFrame(docs(), SCHEMA)
    assert contaminated(none, bench).count() == 0
    assert contaminated(some, bench.limit(0)).count() == 0
    assert drop_contaminated(some, bench.limit(0)).count() == some.count()


def test_items_dense_in_numbers(spark):
    items = [(0, "Compute 3 4 5 6 7 8"), (1, "12 7 19 4 33 8 21")]
    texts = ["intro words. Compute 3 4 5 6 7 8 and go on", "Compute 3 4 5 9 7 8", "row 12 7 19 4 33 8 21 end", "row 12 7 19 5 33 8 21 9", "Compute 13 14 15 16 17 18", "9 8 7 6 5 4 3 2 1"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in contaminated(df, bench).collect()} == {(0, 0, 1.0), (2, 1, 1.0)}


def test_short_items_match_as_a_whole(spark):
    items = [(0, "too short here"), (1, "Paris"), (2, "42 kg"), (3, LONG)]
    texts = ["this is too short here indeed", "too short, HERE", "too short or here", "in paris. now", "parisian", "it weighs 42 kg today", "it weighs 43 kg today", LONG]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched_words, r.item_words) for r in contaminated(df, bench, short_items=True).collect()}
    assert got == {(0, 0, 3, 3), (1, 0, 3, 3), (3, 1, 1, 1), (5, 2, 2, 2), (7, 3, len(LONG.split()), len(LONG.split()))}
    assert {r.doc_id for r in contaminated(df, bench).collect()} == {7}


def test_slot_marks_in_a_text_are_no_slots_and_columns_may_clash(spark):
    text = "5 of the bob seven small boats went past"
    df = spark.createDataFrame([(1, text, "a", "b"), (2, "clean text of five words", "c", "d")], "doc_id long, text string, key string, row string")
    bench = spark.createDataFrame([(0, "9 of the ann seven small boats went past")], "item_id long, text string")
    assert contaminated(df.limit(0), bench).count() == 0
    words_ = df.select(canonical_words(canonical_text(F.col("text"))).alias("w")).first().w
    assert [w for w in words_ if slot(w)] == ["5"]
    kept = drop_contaminated(df, spark.createDataFrame([(0, text)], "item_id long, text string"))
    assert kept.columns == df.columns and [r.key for r in kept.collect()] == ["c"]


def test_a_long_run_of_capitalised_words_is_one_name(spark):
    run = "Anna " * 20000
    df = spark.createDataFrame([(1, f"so then we met {run}who sold seven boats", "x", 1), (2, f"so then he met {run}", "x", 1)], SCHEMA).repartition(2)
    bench = spark.createDataFrame([(0, "so then we met Bob Smith who sold seven boats")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched_words, r.item_words) for r in contaminated(df, bench).collect()} == {(1, 0, 9, 9)}
