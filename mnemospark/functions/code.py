"""Symbols and edges of source files: (path, kind, name, predicate, target) rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, name string, predicate string, target string"
_COLUMNS = ["path", "kind", "name", "predicate", "target"]


def _python_rows(path: str, source: str | None) -> list[tuple]:
    """Definitions as (kind, name, ``defines``, qualified name), and imports, extends and calls of their owners."""
    module = path.rsplit("/", 1)[-1].removesuffix(".py")
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    rows = [(path, "file", path, "defines", module)]

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                name = f"{owner}.{child.name}"
                rows.append((path, "class", name, "defines", child.name))
                rows.extend((path, "class", name, "extends", ast.unparse(b)) for b in child.bases)
                visit(child, name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{child.name}"
                rows.append((path, "method" if isinstance(node, ast.ClassDef) else "function", name, "defines", child.name))
                visit(child, name)
            elif isinstance(child, ast.Import):
                rows.extend((path, "module", owner, "imports", a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.append((path, "module", owner, "imports", child.module or "."))
            else:
                if isinstance(child, ast.Call):
                    called = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
                    if called:
                        rows.append((path, "call", owner, "calls", called))
                visit(child, owner)

    visit(tree, module)
    return rows


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python ``files (path, content)``; files that do not parse give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in _python_rows(p, s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], _COLUMNS)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


#: Per file extension: (kind, predicate, pattern); the first group is the name or the target.
PATTERNS = {
    "sql": (("struct", "defines", r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)"), ("variable", "defines", r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+([\w.]+)"), ("function", "defines", r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+([\w.]+)")),
    "sh": (("function", "defines", r"(?m)^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{"), ("file", "imports", r"(?m)^\s*(?:source|\.)\s+(\S+)")),
    "go": (("package", "defines", r"(?m)^package\s+(\w+)"), ("function", "defines", r"(?m)^func\s+(\w+)\s*\("), ("method", "defines", r"(?m)^func\s+\([^)]*\)\s+(\w+)\s*\("), ("struct", "defines", r"(?m)^type\s+(\w+)\s+struct\b"), ("interface", "defines", r"(?m)^type\s+(\w+)\s+interface\b"), ("file", "imports", r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"\s*$')),
    "js": (("function", "defines", r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)"), ("class", "defines", r"\bclass\s+([A-Za-z_$][\w$]*)"), ("class", "extends", r"\bclass\s+[\w$]+\s+extends\s+([\w$.]+)"), ("file", "imports", r"(?:\bfrom\s+|\brequire\()\s*['\"]([^'\"]+)['\"]"), ("function", "defines", r"\b(?:const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^()]*\)\s*=>")),
    "rs": (("function", "defines", r"\bfn\s+(\w+)"), ("struct", "defines", r"\bstruct\s+(\w+)"), ("type", "defines", r"\benum\s+(\w+)"), ("interface", "defines", r"\btrait\s+(\w+)"), ("module", "defines", r"\bmod\s+(\w+)"), ("file", "imports", r"(?m)^\s*(?:pub\s+)?use\s+([^;{]+)")),
    "java": (("class", "defines", r"\b(?:class|record)\s+(\w+)"), ("interface", "defines", r"\binterface\s+(\w+)"), ("type", "defines", r"\benum\s+(\w+)"), ("file", "imports", r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)"), ("class", "extends", r"\bextends\s+([\w.]+)"), ("class", "implements", r"\bimplements\s+([\w.]+)")),
    "c": (("file", "imports", r'(?m)^\s*#\s*include\s+[<"]([^>"]+)[>"]'), ("struct", "defines", r"\b(?:struct|union)\s+(\w+)\s*\{"), ("type", "defines", r"\benum\s+(?:class\s+)?(\w+)"), ("class", "defines", r"\bclass\s+(\w+)\s*[:{]"), ("module", "defines", r"\bnamespace\s+(\w+)"), ("function", "defines", r"(?m)^[A-Za-z_][\w\s*&:<>]*?\b([\w:~]+)\s*\([^;{}()]*\)\s*(?:const\s*)?\{")),
    "cs": (("file", "imports", r"(?m)^\s*using\s+([\w.]+)\s*;"), ("class", "defines", r"\b(?:class|record|struct)\s+(\w+)"), ("interface", "defines", r"\binterface\s+(\w+)"), ("type", "defines", r"\benum\s+(\w+)"), ("class", "extends", r"\b(?:class|record)\s+\w+\s*:\s*([\w.]+)")),
    "rb": (("method", "defines", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!=]?)"), ("class", "defines", r"(?m)^\s*class\s+([\w:]+)"), ("module", "defines", r"(?m)^\s*module\s+([\w:]+)"), ("file", "imports", r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"), ("class", "extends", r"(?m)^\s*class\s+[\w:]+\s*<\s*([\w:]+)")),
    "php": (("file", "imports", r"(?m)^\s*use\s+([\w\\]+)"), ("function", "defines", r"\bfunction\s+(\w+)"), ("class", "defines", r"\bclass\s+(\w+)"), ("interface", "defines", r"\binterface\s+(\w+)"), ("type", "defines", r"\b(?:trait|enum)\s+(\w+)"), ("class", "extends", r"\bextends\s+([\w\\]+)")),
    "lua": (("function", "defines", r"\bfunction\s+([\w.:]+)\s*\("), ("file", "imports", r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]")),
    "css": (("variable", "defines", r"(?m)^\s*([.#][\w-]+)[^{};]*\{"), ("file", "imports", r"@import\s+(?:url\()?['\"]?([^'\")\s;]+)")),
    "tf": (("variable", "defines", r'(?m)^\s*(?:variable|output)\s+"([^"]+)"'), ("module", "defines", r'(?m)^\s*module\s+"([^"]+)"'), ("struct", "defines", r'(?m)^\s*(?:resource|data)\s+"[^"]+"\s+"([^"]+)"')),
    "proto": (("struct", "defines", r"\bmessage\s+(\w+)"), ("type", "defines", r"\benum\s+(\w+)"), ("interface", "defines", r"\bservice\s+(\w+)"), ("method", "defines", r"\brpc\s+(\w+)"), ("file", "imports", r'\bimport\s+"([^"]+)"')),
    "toml": (("variable", "defines", r"(?m)^\s*\[+([^\]\n]+)\]+"),),
    "yaml": (("variable", "defines", r"(?m)^([A-Za-z_][\w-]*)\s*:"),),
    "dockerfile": (("file", "imports", r"(?mi)^FROM\s+(\S+)"), ("variable", "defines", r"(?mi)^FROM\s+\S+\s+AS\s+(\S+)")),
}
#: Fixed list: extensions that share another's patterns.
SAME = {"bash": "sh", "ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "kt": "java", "cc": "c", "cpp": "c", "h": "c", "hpp": "c", "scss": "css", "hcl": "tf", "yml": "yaml"}


def symbols_by_pattern(files: DataFrame) -> DataFrame:
    """Symbols of ``files (path, content)`` by their language's patterns, all within the JVM; unknown languages give none."""
    end = F.lower(F.regexp_extract("path", r"(?:\.|/|^)([A-Za-z]+)$", 1))
    same = F.create_map(*[F.lit(x) for kv in SAME.items() for x in kv])
    rows = files.select("path", "content", F.coalesce(same[end], end).alias("language"))

    def symbols(kind: str, predicate: str, pattern: str) -> Column:
        names = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), F.lit(predicate).alias("predicate")))

    runs = [F.when(F.col("language") == language, symbols(*p)) for language, patterns in PATTERNS.items() for p in patterns]
    found = rows.select("path", F.explode(F.flatten(F.array_compact(F.array(*runs)))).alias("s")).where("s.name <> ''")
    return found.select("path", "s.kind", F.when(F.col("s.predicate") == "defines", F.col("s.name")).otherwise(F.col("path")).alias("name"), "s.predicate", F.col("s.name").alias("target"))


def html_edges(pages: DataFrame) -> DataFrame:
    """(page_id, predicate, target): what a page's links, scripts and images point at."""
    links = F.concat(F.regexp_extract_all("html", F.lit(r'<(?:a|link)\s[^>]*href="([^"]*)"'), F.lit(1)), F.regexp_extract_all("html", F.lit(r'<(?:script|img)\s[^>]*src="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.lit("imports").alias("predicate"), F.explode(links).alias("target"))
