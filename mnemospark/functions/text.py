"""Text functions as column expressions; the few that need state are Arrow-batched."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from mnemospark.functions.english import english_terms, english_words, stem  # noqa: F401 - part of this module's functions


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def lead(text: Column, limit: int = 120) -> Column:
    """Up to the first full stop or line break inside ``limit`` characters, else cut there with an ellipsis."""
    head = F.substring(text, 1, limit)
    stop = F.regexp_extract(head, r"^([^.\n]*\.?)(?:\n|(?<=\.)|$)", 1)
    found = head.rlike(r"[.\n]")
    return F.when(found, stop).when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))


def summarise(text: Column, max_words: int = 150) -> Column:
    """Unchanged if short; else the first words up to the last that ends a sentence, or all of them."""
    parts = F.array_remove(F.split(text, r"\s+"), "")
    head = F.slice(parts, 1, max_words)
    ends = F.transform(head, lambda w: w.rlike(r"[.!?]$"))
    back = F.array_position(F.reverse(ends), True)
    cut = F.when(back > 0, F.slice(head, 1, (F.size(head) - back + 1).cast("int"))).otherwise(head)
    return F.when(F.size(parts) <= max_words, text).otherwise(F.array_join(cut, " "))


def source_path(ref: Column) -> Column:
    """``file:path:line`` to ``path``."""
    return F.regexp_replace(ref, r"^file:|:\d+$", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_]+", "-"), r"^[-_]+|[-_]+$", "")


def slug_candidate(raw: Column) -> Column:
    """Lower case; runs of other characters become one hyphen; hyphens and underscores at the ends go; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(F.coalesce(raw, F.lit("")))), r"[^a-z0-9_-]+", "-"), r"^[-_]+|[-_]+$", "")


def first_slug(slug: Column, source: Column, name: Column) -> Column:
    """The first that is not empty: the slug given, the base name of the source without its extension, the name."""
    base = F.regexp_replace(F.regexp_extract(F.replace(F.coalesce(source, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.get(F.filter(F.transform(F.array(slug, base, name), slug_candidate), lambda s: s != ""), F.lit(0))


def title_of_slug(slug: Column) -> Column:
    """The parts of a slug with capital letters; a slug without parts as it is."""
    parts = F.array_remove(F.split(slug, "[-_]"), "")
    return F.when(F.size(parts) == 0, slug).otherwise(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), " "))


def scope_parts(scope: Column) -> Column:
    """(kind, external_id) of ``kind:external_id``, both trimmed; both null if one is missing."""
    at = F.instr(scope, ":")
    kind, rest = F.btrim(F.substring_index(scope, ":", 1)), F.btrim(scope.substr(at + 1, F.length(scope)))
    good = (at > 0) & (kind != "") & (rest != "")
    return F.struct(F.when(good, kind).alias("kind"), F.when(good, rest).alias("external_id"))


def path_label(external_id: Column) -> Column:
    """What a scope is called in a path: all but ASCII letters, digits and underscores become underscores."""
    return F.regexp_replace(external_id, "[^a-zA-Z0-9_]", "_")


#: Fixed list: file extensions of source code.
CODE_EXTENSIONS = (".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".rs", ".java", ".c", ".cpp", ".h", ".rb", ".sh", ".cs", ".php", ".swift", ".kt", ".scala", ".lua", ".r", ".m", ".ex", ".exs")
#: Fixed list: words that, with a blank and more after them, make a line look like code.
CODE_WORDS = ("func", "def", "class", "import", "return", "const", "var", "let")
_FILLED = r"[^\x09-\x0D\x20\x85\xA0]"
CODE_LINE = rf"[{{}}]|^\x20\x20\x20\x20|(?:{'|'.join(CODE_WORDS)})\x20[\s\S]*{_FILLED}"


def content_kind(content: Column, source_ref: Column) -> Column:
    """``code`` or ``text`` by the extension of a ``file:`` reference; without one, ``code`` if over 40% of the filled lines look like code."""
    path = F.regexp_replace(F.substring(source_ref, 6, 1 << 30), r":[^:]*$", "")
    extension = F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]*)$", 1))
    extension = F.when(source_ref.startswith("file:"), extension).otherwise("")
    lines = F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: x.rlike(_FILLED))
    by_lines = F.coalesce(F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))).cast("double"), F.size(lines)), F.lit(0.0)) > 0.4
    return F.when(extension.isin(*CODE_EXTENSIONS), "code").when(F.coalesce(extension, F.lit("")) != "", "text").when(by_lines, "code").otherwise("text")


def entity_mentions(content: Column, source_ref: Column, max_concepts: int = 10) -> Column:
    """Array of (type, canonical): files, pull requests, persons, then at most ``max_concepts`` PascalCase concepts."""
    pick = lambda p, g=1: F.regexp_extract_all(content, F.lit(p), F.lit(g))
    kind = lambda t, a: F.transform(a, lambda x: F.struct(F.lit(t).alias("type"), F.lower(x).alias("canonical")))
    own = F.when(source_ref.startswith("file:"), F.array(source_path(source_ref))).otherwise(F.array().cast("array<string>"))
    files = F.concat(own, F.transform(pick(r"\bfile:([^\s,;)]+)"), lambda x: F.regexp_replace(x, r":\d+$", "")))
    refs = F.concat(F.when(source_ref.rlike(r"^pr:\d+$"), F.array(source_ref)).otherwise(F.array().cast("array<string>")), pick(r"\bpr:\d+", 0))
    persons = pick(r"(?:^|[^A-Za-z0-9_])@([A-Za-z][A-Za-z0-9._-]*[A-Za-z0-9])")
    concepts = F.slice(F.array_distinct(pick(r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b", 0)), 1, max_concepts)
    return F.array_distinct(F.concat(kind("file", files), kind("pr", refs), kind("person", persons), kind("concept", concepts)))


def cover_density(places: Column, terms: int) -> Column:
    """Sum of 1 / length over the shortest runs that hold all query terms.

    ``places``: sorted array of (at, term) of the query's terms in a text. A run ends at each place at
    which every term has occurred, and starts at the least of the terms' last places; runs that
    contain another run do not count.
    """
    zero = F.struct(F.array_repeat(F.lit(-1), terms).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("rank"))

    def step(s: Column, p: Column) -> Column:
        last = F.transform(s.last, lambda x, i: F.when(i == p.term, p["at"]).otherwise(x))
        low = F.array_min(last)
        fresh = (low >= 0) & (low > s.start)
        return F.struct(last.alias("last"), F.when(fresh, low).otherwise(s.start).alias("start"), (s["rank"] + F.when(fresh, 1.0 / (p["at"] - low + 1)).otherwise(0.0)).alias("rank"))

    return F.aggregate(places, zero, step, lambda s: s["rank"])


def _sentences(text: str) -> list[str]:
    text = re.sub(r"(?m)^(?:-{3,}|\*{3,}|_{3,})\s*$", "", text.replace("\r\n", "\n"))
    text = re.sub(r"(?m)^#{1,6}\s+", "", text)
    out = []
    for part in re.split(r"\n\n+", text):
        out += [s.strip() for s in re.split(r"(?<=[.!?])(?=\s|$)", part) if s.strip()]
    return out


def chunk_text(text: str | None, limit: int = 1000, overlap: int = 2) -> list[str]:
    """Whole sentences up to ``limit`` characters a chunk; the last ``overlap`` sentences open the next one.

    A longer sentence is cut at blanks past its half, else at the limit. Short texts are one chunk.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [text]
    parts: list[str] = []
    for s in _sentences(text):
        while len(s) > limit:
            at = s.rfind(" ", limit // 2, limit)
            at = limit if at < 0 else at
            parts.append(s[:at].strip())
            s = s[at:].strip()
        if s:
            parts.append(s)
    out: list[str] = []
    now: list[str] = []
    for s in parts:
        if now and sum(map(len, now)) + len(now) + len(s) > limit:
            out.append(" ".join(now))
            now = now[-overlap:] if overlap else []
            while now and sum(map(len, now)) + len(now) + len(s) > limit:
                now.pop(0)
        now.append(s)
    return [*out, " ".join(now)] if now else out


@F.pandas_udf(ArrayType(StringType()))
def chunks(text: pd.Series) -> pd.Series:
    return text.map(chunk_text)
