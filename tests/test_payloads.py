import pytest

from mnemospark.functions.payloads import parsed_embeddings
from pyspark.sql import functions as F

CASES = [
    ('{"data":[{"index":1,"embedding":[3,4.5]},{"index":0,"embedding":[1,2]}]}', 2, [[1, 2], [3, 4.5]], None),
    ('[{"index":0,"embedding":[1.5,2]}]', 1, [[1.5, 2]], None),
    ('[{"embedding":[[1,2]]}]', 1, [[1, 2]], None),
    ('{"data":[{"index":0,"embedding":[[1],[2],[3]]}]}', 1, [[1, 2, 3]], None),
    ('{"data":[{"index":0,"embedding":[[1,2],[3,6]]}]}', 1, [[2, 4]], None),
    ('{"data":[{"index":0,"embedding":[[1,2],[3]]}]}', 1, None, "unsupported embedding format"),
    ('{"data":[{"index":0,"embedding":"text"}]}', 1, None, "unsupported embedding format"),
    ('{"data":[{"index":5,"embedding":[1]}]}', 1, None, "embedding index 5 out of range"),
    ('{"data":[{"index":-1,"embedding":[1]}]}', 1, None, "embedding index -1 out of range"),
    ('{"data":[{"index":0,"embedding":[1]}]}', 2, None, "expected 2 embeddings, got 1"),
    ('{"data":[{"index":0,"embedding":[1]},{"index":0,"embedding":[2]}]}', 2, [[2], None], None),
    ("[[1,2],[3,4]]", 2, [[1, 2], [3, 4]], None),
    ("[[1,2],[3]]", 2, [[1, 2], [3]], None),
    ("[[1,2]]", 2, None, "expected 2 embeddings, got 1"),
    ("[]", 1, None, "expected 1 embeddings, got 0"),
    ("[1,2.5,-3e2]", 1, [[1, 2.5, -300]], None),
    ("[1,null]", 1, [[1, 0]], None),
    ("[1,2]", 2, None, "[1,2]"),
    ('{"embedding":[1,2]}', 1, [[1, 2]], None),
    ('{"embedding":[1,2]}', 2, None, '{"embedding":[1,2]}'),
    ('{"embedding":"x"}', 1, None, '{"embedding":"x"}'),
    ('["1","2"]', 1, None, '["1","2"]'),
    ('{"error":"quota"}', 1, None, '{"error":"quota"}'),
    ("not json", 1, None, "not json"),
    ("", 1, None, ""),
    (None, 1, None, ""),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = spark.createDataFrame([(k, b, n) for k, (b, n, *_) in enumerate(CASES)], "k int, body string, expected int")
    found = rows.select("k", parsed_embeddings(F.col("body"), F.col("expected")).alias("p")).collect()
    return {r.k: (r.p.vectors, r.p.error) for r in found}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_shapes(got, k):
    assert got[k] == CASES[k][2:]
