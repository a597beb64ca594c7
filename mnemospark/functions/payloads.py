"""Answers of embedding services as vectors: the shapes that compatible servers give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of a parsed value's schema: a number, and lists of numbers one and two deep.
_NUMBER = r"(?:VOID|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
_VECTOR = rf"^ARRAY<{_NUMBER}>$"
_MATRIX = rf"^ARRAY<(?:VOID|ARRAY<{_NUMBER}>)>$"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _floats(v: Column) -> Column:
    """A list of numbers; a null in it counts as 0."""
    return F.transform(_get(v, "$", "array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))


def pooled_vector(v: Column) -> Column:
    """The vector that one embedding, a variant, stands for: a list of numbers; a list in a list; a column of one number a row; the mean of rows of one length; else null."""
    shape = F.schema_of_variant(v)
    rows = F.transform(_get(v, "$", "array<array<double>>"), lambda r: F.transform(F.coalesce(r, F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0))))
    width = F.size(F.get(rows, F.lit(0)))
    even = F.forall(rows, lambda r: F.size(r) == width)
    sums = F.aggregate(rows, F.array_repeat(F.lit(0.0), F.greatest(width, F.lit(0))), lambda s, r: F.zip_with(s, r, lambda a, b: a + b))
    mean = F.transform(sums, lambda x: x / F.size(rows))
    column = F.forall(rows, lambda r: F.size(r) == 1)
    matrix = F.when(F.size(rows) == 1, F.get(rows, F.lit(0))).when(column, F.flatten(rows)).when(even & (width > 0), mean)
    return F.when(shape.rlike(_VECTOR), _floats(v)).when(shape.rlike(_MATRIX) | (shape == "ARRAY<ARRAY<VOID>>"), matrix)


def parsed_embeddings(body: Column, expected: Column) -> Column:
    """(vectors, error) of a service's answer to ``expected`` inputs; one of both is null.

    Tried in this order: ``data`` with items of ``index`` and ``embedding``, such items as a list, a list of vectors, and for one input a bare vector or an object with
    ``embedding``. Items are put in the order of their index (absent: 0), one that is repeated keeps the last; a place without an item is null. A body that
    is no JSON, or of no such shape, is the error itself.
    """
    v = F.try_parse_json(body)
    shape = F.schema_of_variant(v)
    listed = F.coalesce(_get(v, "$.data", "array<variant>"), _get(v, "$", "array<variant>"))
    in_data = shape.startswith("OBJECT") & _get(v, "$.data", "array<variant>").isNotNull()
    objects = F.forall(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    items = F.transform(listed, lambda x: F.struct(F.coalesce(_get(x, "$.index", "int"), F.lit(0)).alias("index"), pooled_vector(_get(x, "$.embedding", "variant")).alias("vec")))
    wrong = F.get(F.filter(items, lambda x: (x.index < 0) | (x.index >= expected) | x.vec.isNull()), F.lit(0))
    outside = (wrong.index < 0) | (wrong.index >= expected)
    ordered = F.transform(F.sequence(F.lit(0), F.greatest(expected, F.lit(1)) - 1), lambda k: F.try_element_at(F.filter(items, lambda x: x.index == k), F.lit(-1)).vec)
    count = F.concat(F.lit("expected "), expected.cast("string"), F.lit(" embeddings, got "), F.size(listed).cast("string"))
    error = F.when(F.size(listed) != expected, count).when(wrong.isNotNull() & outside, F.concat(F.lit("embedding index "), wrong.index.cast("string"), F.lit(" out of range"))).when(wrong.isNotNull(), F.lit("unsupported embedding format"))
    vectors = F.transform(_get(v, "$", "array<array<double>>"), lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit(0.0))))
    kind = "array<array<double>>"
    none, no = F.lit(None).cast(kind), F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.cast(kind).alias("vectors"), b.alias("error"))
    indexed = F.coalesce(objects & (in_data | shape.startswith("ARRAY")), F.lit(False))
    bare = F.coalesce((expected == 1) & shape.rlike(_VECTOR), F.lit(False))
    single = F.coalesce((expected == 1) & F.schema_of_variant(_get(v, "$.embedding", "variant")).rlike(_VECTOR), F.lit(False))
    return (
        F.when(indexed & error.isNotNull(), pair(none, error))
        .when(indexed, pair(ordered, no))
        .when(F.coalesce(shape.rlike(_MATRIX), F.lit(False)), F.when(F.size(listed) == expected, pair(vectors, no)).otherwise(pair(none, count)))
        .when(bare, pair(F.array(_floats(v)), no))
        .when(single, pair(F.array(_floats(_get(v, "$.embedding", "variant"))), no))
        .otherwise(pair(none, F.coalesce(body, F.lit(""))))
    )
