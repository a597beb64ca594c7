import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import english
from mnemospark.functions import text as T
from mnemospark.operators import recall as R
from mnemospark.operators import search as S

WORDS = "the cat cats running runner run of house houses naïve über maße größe i2 42 a ab connection connected".split()


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    texts = [" ".join(r.choices(WORDS, k=r.randint(0, 25))) for _ in range(300)] + [None, "", "!!!", "the of a", "Cat, CATS; running!"] + ["cat run house"] * 5
    return spark.createDataFrame(list(enumerate(texts)), "id long, content string").cache()


@pytest.fixture(scope="module")
def folders(rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    S.write_word_index(rows, f"{root}/simple")
    S.write_word_index(rows, f"{root}/english", "english")
    S.write_trigram_index(rows, f"{root}/trigram")
    return root


def got(df):
    return [(r[0], pytest.approx(r[1])) for r in df.collect()]


@pytest.mark.parametrize("query", ["cat", "the cat", "House RUN", "über größe", "nothing here", "", "cat cat"])
def test_words_match_as_a_scan_of_all_texts_does(spark, rows, folders, query):
    found = S.match_words(spark, f"{folders}/simple", query, 20)
    want = R.by_terms(rows, query, 20) if query else rows.limit(0).select("id", F.lit(0.0))
    assert got(found) == got(want)


def brute_english(rows, query, limit):
    terms = sorted(set(english.english_words(query)) - {""})
    out = []
    for id_, text in rows:
        places = [(k, terms.index(w)) for k, w in enumerate(english.english_words(text)) if w in terms]
        if terms and {t for _, t in places} == set(range(len(terms))):
            runs = [(i, j) for i in range(len(places)) for j in range(i, len(places)) if {t for _, t in places[i : j + 1]} == set(range(len(terms)))]
            best = [r for r in runs if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in runs)]
            out.append((id_, sum(0.1 / (1 + places[j][0] - places[i][0] - (j - i)) for i, j in best)))
    return sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:limit]


@pytest.mark.parametrize("query", ["run", "the running cats", "connecting houses", "naive", "of the", "absent cat"])
def test_english_terms_match_as_their_definition_says(spark, rows, folders, query):
    found = [(r[0], round(r[1], 9)) for r in S.match_english(spark, f"{folders}/english", query, 400).collect()]
    want = [(i, round(s, 9)) for i, s in brute_english([tuple(r) for r in rows.collect()], query, 400)]
    assert sorted(found) == sorted(want)
    assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


@pytest.mark.parametrize("query", ["cat house", "connexion", "größe maße", "i2 42", "zzz", ""])
def test_trigrams_match_as_a_scan_of_all_texts_does(spark, rows, folders, query):
    assert got(S.match_trigrams(spark, f"{folders}/trigram", query, 30)) == got(R.by_trigram(rows, query, 30))


def test_many_questions_at_once_find_the_same(spark, rows, folders):
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["cat house", "connexion of naïve", "i2", "zzz", ""])], "id long, content string")
    for cut in (0.1, 0.3, 0.6):
        found = S.similar_texts(f"{folders}/trigram", spark, asked, cut).collect()
        pairs = asked.select(F.col("id").alias("asked_id"), F.col("content").alias("q")).crossJoin(rows)
        score = T.jaccard(T.trigrams(F.col("content")), T.trigrams(F.col("q")))
        want = pairs.select("asked_id", "id", score.alias("s")).where(F.col("s") > cut).collect()
        assert sorted((r[0], r[1], round(r[2], 9)) for r in found) == sorted((r[0], r[1], round(r[2], 9)) for r in want)


def test_only_texts_that_are_asked_for_count_towards_the_limit(spark, rows, folders):
    odd = rows.where("id % 2 = 1")
    assert got(S.match_words(spark, f"{folders}/simple", "cat", 7, odd)) == got(R.by_terms(odd, "cat", 7))
    assert got(S.match_trigrams(spark, f"{folders}/trigram", "cat run", 7, odd)) == got(R.by_trigram(odd, "cat run", 7))


def test_a_question_reads_the_buckets_of_its_own_terms(spark, folders):
    found = S.postings(spark, f"{folders}/simple", ["cat"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert "content" not in plan
    assert 0 < len({r[0] for r in found.select(F.input_file_name()).distinct().collect()}) < len(spark.read.parquet(f"{folders}/simple").inputFiles())


def test_an_index_is_kept_until_its_table_changes(spark, rows, tmp_path):
    path, built = str(tmp_path / "t"), []
    rows.write.parquet(path)

    def write(folder):
        built.append(folder)
        S.write_word_index(spark.read.parquet(path), folder)

    one = S.kept(spark.read.parquet(path), "words", write)
    assert S.kept(spark.read.parquet(path), "words", write) == one and built == [one]
    rows.limit(3).write.mode("append").parquet(path)
    assert S.kept(spark.read.parquet(path), "words", write) != one and len(built) == 2


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, content string")
    S.write_word_index(none, f"{tmp_path}/w")
    S.write_trigram_index(spark.createDataFrame([(1, None)], "id long, content string"), f"{tmp_path}/t")


def test_recall_with_indexes_and_scopes_equals_a_scan(spark, rows, folders):
    memories = rows.selectExpr("id", "content", "concat('s', id % 4) AS scope_id", "'semantic' AS memory_type", "0.5D AS importance", "timestamp'2024-01-01' AS created_at", "CAST(NULL AS TIMESTAMP) AS last_accessed")
    vectors = rows.select("id", F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("vec"))
    question = spark.createDataFrame([([1.0, 2.0],)], "q array<double>")
    now = F.lit("2024-02-01").cast("timestamp")
    ask = lambda m, **kw: [tuple(r) for r in R.recall_memories(m, now, "cat house", question, [vectors], **kw).collect()]
    indexes = dict(word_index=f"{folders}/simple", trigram_index=f"{folders}/trigram")
    assert ask(memories, **indexes) == ask(memories)
    own = spark.createDataFrame([("s1",), ("s3",), ("s3",)], "scope_id string")
    assert ask(memories, scopes=own, **indexes) == ask(memories.where("scope_id IN ('s1', 's3')"))
    assert ask(memories, scopes=own.limit(0), **indexes) == []
