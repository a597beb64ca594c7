"""Skill documents: front matter, parameter checks and templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def front_matter(text: Column) -> Column:
    """Struct of name, description, agent types, body and whether the head is closed.

    Agent types may stand inline in brackets, after commas, or as a list below; without any it is ``any``.
    """
    closed = text.rlike(r"(?s)^---\n.*?\n---(?:\n|$)")
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    one = lambda key: F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    inline = F.regexp_replace(one("agent_types"), r"[\[\]\"']", "")
    below = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^agent_types:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*([^\n]+)"), F.lit(1))
    listed = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(F.transform(below, F.trim))
    return F.struct(
        one("name").alias("name"),
        one("description").alias("description"),
        F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("any"))).alias("agent_types"),
        F.regexp_replace(text, r"(?s)^---\n.*?\n---(?:\n|$)", "").alias("body"),
        closed.alias("closed"),
    )


def parameter_fits(kind: Column, value: Column, allowed: Column) -> Column:
    """Whether a value fits its declared type: string, integer, boolean, or one of the allowed values."""
    return (
        F.when(kind == "string", value.isNotNull())
        .when(kind == "integer", value.rlike(r"^[+-]?\d+$"))
        .when(kind == "boolean", value.isin("true", "false"))
        .when(kind == "enum", F.array_contains(allowed, value))
        .otherwise(F.lit(False))
    )


def valid_slug(slug: Column) -> Column:
    return slug.rlike(r"^[a-z0-9][a-z0-9_-]{0,63}$")


def safe_path(path: Column) -> Column:
    """Relative paths below ``scripts/`` or ``references/`` that never climb."""
    return path.rlike(r"^(?:scripts|references)/[A-Za-z0-9._/-]+$") & ~path.rlike(r"(?:^|/)\.\.?(?:/|$)|//")


#: Fixed pattern: a part of a supplementary file's path.
PATH_PART = r"[a-zA-Z0-9][a-zA-Z0-9._-]*"


def file_problem(path: Column, executable: Column) -> Column:
    """What is wrong with a supplementary file of a skill, null if nothing: its path must be relative, of plain parts and 255 bytes at most, not the entry point's, and
    executables lie below ``scripts/``, Markdown below ``references/``."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(path == "SKILL.md", "reserved")
        .when(path.startswith("/") | path.startswith("\\"), "absolute")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(F.octet_length(path) > 255, "too long")
        .when(F.array_contains(F.split(path, "/"), ".."), "traversal")
        .when(~path.rlike(rf"\A{PATH_PART}(?:/{PATH_PART})*\z"), "invalid part")
        .when(executable & ~path.startswith("scripts/"), "not below scripts/")
        .when(~executable & path.endswith(".md") & ~path.startswith("references/"), "not below references/")
    )


def _written(value: Column) -> Column:
    """A variant as it stands in a text: whole numbers without a fraction, others with as many digits as they need and no exponent."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    digits = F.when(number.cast("string").contains("E"), F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")).otherwise(number.cast("string"))
    whole = (number == F.floor(number)) & (F.abs(number) < 9.2e18)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.when(whole, F.try_variant_get(value, "$", "double").cast("decimal(20,0)").cast("string")).otherwise(digits)).otherwise(F.try_variant_get(value, "$", "string"))


def invoked(body: Column, schema: Column, params: Column) -> Column:
    """(prompt, errors) of a skill that is called: the first is null if there are any of the second, ``name: reason``.

    ``schema``: array of (name, type, required, values); ``params``: the values as a JSON object. Types are string, integer (any number), boolean and enum. In the order
    of the schema, ``$NAME`` and ``{{name}}`` are replaced by the value; parameters that are not given, and values of no parameter, change nothing.
    """
    given = F.coalesce(F.try_parse_json(params), F.parse_json(F.lit("{}")))
    value = lambda p: F.try_variant_get(given, F.concat(F.lit("$['"), p["name"], F.lit("']")), "variant")
    kind = lambda p: F.schema_of_variant(value(p))
    reason = lambda p: (
        F.when(kind(p).isNull(), F.when(F.coalesce(p.required, F.lit(False)), "required parameter is missing"))
        .when((p.type == "string") & (kind(p) != "STRING"), "expected string")
        .when((p.type == "integer") & ~kind(p).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "expected integer")
        .when((p.type == "boolean") & (kind(p) != "BOOLEAN"), "expected boolean")
        .when((p.type == "enum") & (kind(p) != "STRING"), "expected string for enum")
        .when((p.type == "enum") & ~F.coalesce(F.array_contains(p["values"], _written(value(p))), F.lit(False)), "not an allowed value")
    )
    errors = F.filter(F.transform(schema, lambda p: F.concat(p["name"], F.lit(": "), reason(p))), lambda e: e.isNotNull())
    put = lambda text, p: F.replace(F.replace(text, F.concat(F.lit("$"), F.upper(p["name"])), _written(value(p))), F.concat(F.lit("{{"), F.lower(p["name"]), F.lit("}}")), _written(value(p)))
    prompt = F.aggregate(schema, body, lambda text, p: F.when(kind(p).isNull(), text).otherwise(put(text, p)))
    return F.struct(F.when(F.size(errors) == 0, prompt).alias("prompt"), errors.alias("errors"))
