import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = st.text(st.one_of(st.sampled_from(" \n\t\r▁<s>/0x41éèß中文😀\u0000 ​"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_texts_equal_the_library(model, library, text):
    ids = model.encode(text)
    assert ids == library.encode(text)
    assert model.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 259)), max_size=12))
def test_any_ids_decode_as_the_library_does(model, library, ids):
    assert model.decode(ids) == library.decode(ids)


def test_agenda_equals_a_plain_scan_for_the_best_pair(model):
    def scan(word):
        s = list(word)
        while True:
            pairs = [(model.cost[a + b], k) for k, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in model.cost]
            if not pairs:
                return s
            _, k = min(pairs)
            s[k : k + 2] = [s[k] + s[k + 1]]

    for word in ["▁the", "▁international", "▁▁▁▁▁x", "▁aaaaaaaaaaa", "▁12345", "▁naïveté", "x" * 200]:
        assert "".join(model.surface[i] for i in model.merge(word)) == word
        assert [model.surface[i] for i in model.merge(word)] == scan(word)


def test_whole_texts_without_cuts_give_the_same(model):
    for text in ["two  words\nand a line", "a b c d", "▁ odd ▁", "tail "]:
        assert model.merge("▁" + text.replace(" ", "▁")) == model.encode(text)


def test_words_beyond_the_memory_are_encoded_each_time(model, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_WORDS", 0)
    with open(MODEL, "rb") as f:
        bare = pieces.PieceModel(f.read())
    assert bare.encode("no word is kept, none") == model.encode("no word is kept, none")
    assert not bare._words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(ODD, st.text("ab ▁.,\u0000é中ж", max_size=30)), max_size=12))
def test_words_side_by_side_equal_words_one_by_one(model, library, texts):
    assert model.encode_all(texts) == [library.encode(t) for t in texts]
    words = {t.replace("▁", " ") for t in texts if t}
    assert model.merge_all(words) == {w: tuple(model.merge(w.replace(" ", "▁"))) for w in words}


def test_a_word_is_remembered_without_the_marks_beside_it():
    with open(MODEL, "rb") as f:
        bare = pieces.PieceModel(f.read())
    bare.encode("(the the. the, (the) the")
    assert set(bare._words) == {" the", "the", " (", ".", ",", ")"}


def test_documents_null_empty_long_repeated_and_clashing_columns(spark, library):
    long = "wörd number 12 and more\n" * 100_000
    rows = [(1, "Hello  world", "x", 0), (1, "Hello  world", "x", 0), (2, None, "x", 0), (3, "", "x", 0), (None, " a", "x", 0), (4, long, "x", 0), (5, "ab1" * 50_000, "x", 0)]
    got = pieces.encode_documents(spark.createDataFrame(rows, SCHEMA), MODEL).collect()
    assert len(got) == len(rows) and all(r.agrees for r in got)
    want = sorted((d is not None, d or 0, library.encode(t or "")) for d, t, *_ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    assert {r.decoded for r in got if r.doc_id in (2, 3)} == {""}
    assert next(r.decoded for r in got if r.doc_id == 4) == long


def test_empty_table(spark):
    assert pieces.digest(pieces.encode_documents(spark.createDataFrame([], SCHEMA), MODEL)).count() == 0


def test_query_equals_the_library_on_every_document(spark, library):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_pieces(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[d.doc_id]) == (d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True)
