"""Symbols and edges of source files in languages with braces: a tokenizer with a stack of scopes.

Strings and comments are tokens of their own or none, so that nothing in them looks like code. An opening brace that belongs to a declaration opens its scope; names
are qualified by the scopes they stand in, calls belong to the innermost function, and a symbol spans its declaration and body.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """How a language qualifies names, what its declarations are called, and which of its words look like calls."""

    kinds: dict[str, str]  # keyword of a declaration -> kind of symbol
    sep: str = "."
    root: str = ""  # "file": names begin with the file's; "package": with the package's
    quotes: str = "\"'"
    methods: bool = False  # functions without a keyword
    variables: tuple[str, ...] = ()


_CLASSES = {"class": "class", "interface": "interface", "enum": "type"}
LANGUAGES = {
    "go": Language({}, root="package", quotes="\"'`"),
    "rs": Language({"fn": "function", "struct": "struct", "union": "struct", "enum": "type", "trait": "interface", "mod": "module", "type": "type"}, sep="::", root="file", quotes='"', variables=("const", "static")),
    "js": Language(_CLASSES | {"function": "function", "type": "type", "namespace": "module"}, root="file", quotes="\"'`", methods=True, variables=("const", "let", "var")),
    "java": Language(_CLASSES | {"record": "class"}, root="package", methods=True),
    "kt": Language(_CLASSES | {"object": "class", "fun": "function"}, root="package"),
    "cs": Language(_CLASSES | {"record": "class", "struct": "struct", "namespace": "module"}, methods=True),
    "c": Language({"struct": "struct", "union": "struct", "class": "class", "enum": "type", "namespace": "module"}, sep="::", methods=True),
    "proto": Language({"message": "struct", "enum": "type", "service": "interface", "rpc": "method"}, root="package"),
}
#: Fixed list: file extensions of these languages.
ENDINGS = {"go": "go", "rs": "rs", "js": "js", "jsx": "js", "mjs": "js", "ts": "js", "tsx": "js", "java": "java", "kt": "kt", "cs": "cs", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "cxx": "c", "proto": "proto"}

CONTROL = frozenset("if for while switch catch return sizeof function func fn match loop with using lock foreach typeof await async yield defer go select case else do try new throw in of assert super this when synchronized".split())
_TOKENS = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>{strings})|(?P<w>[^\W\d][\w$]*|\$[\w$]*)|(?P<n>\d[\w.]*)|(?P<p>::|=>|->|\S)""".replace("{strings}", "@"), re.DOTALL)


def _tokenizer(quotes: str) -> re.Pattern[str]:
    each = [r'"(?:\\.|[^"\\])*(?:"|\Z)' if q == '"' else r"'(?:\\.|[^'\\\n])*'" if q == "'" else r"`(?:\\.|[^`\\])*(?:`|\Z)" for q in quotes]
    char = [] if "'" in quotes else [r"'(?:\\[^']+|[^'\\])'"]  # a character, not a lifetime
    return re.compile(_TOKENS.pattern.replace("@", "|".join([*char, *each])), re.DOTALL)


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int


@dataclass
class Scan:
    """One pass over the tokens (kind, text, start, end) of a file."""

    path: str
    source: str
    language: str
    symbols: list[Symbol] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.lang = LANGUAGES[self.language]
        self.toks = [(m.lastgroup, m[0], m.start(), m.end()) for m in _tokenizer(self.lang.quotes).finditer(self.source) if m.lastgroup]
        self.stack: list[tuple[str, str, Symbol | None]] = []  # (kind of scope, qualified name, its symbol)
        self.opens: dict[int, tuple[str, str, Symbol | None]] = {}
        self.root = re.sub(r"\.[^.]*$", "", self.path.rsplit("/", 1)[-1]) if self.lang.root == "file" else ""
        self.symbols.append(Symbol("file", self.path, 0, 0))

    def text(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i][0] == "w"

    def edge(self, subject: str, predicate: str, target: str) -> None:
        if subject and target:
            self.edges.append((subject, predicate, target))

    def qualified(self, name: str) -> str:
        outer = next((n for k, n, _ in reversed(self.stack) if k != "block"), self.root)
        return f"{outer}{self.lang.sep}{name}" if outer else name

    def declare(self, kind: str, name: str, i: int, body: int | None, scope: str) -> Symbol:
        """A symbol from token ``i`` on; ``body`` is the brace that opens its scope, if it has one."""
        s = Symbol(kind, name, self.toks[i][2], self.toks[min(i + 1, len(self.toks) - 1)][3])
        self.symbols.append(s)
        self.edge(self.path, "defines", name)
        if body is not None:
            self.opens[body] = (scope, name, s)
        return s

    def closing(self, i: int) -> int:
        """The token that closes the bracket at ``i``, or the last one."""
        depth, pair = 0, {"(": ")", "[": "]", "{": "}", "<": ">"}[self.text(i)]
        for k in range(i, len(self.toks)):
            depth += (self.text(k) == self.text(i)) - (self.text(k) == pair)
            if not depth:
                return k
        return len(self.toks) - 1

    def until(self, i: int, *ends: str) -> int:
        while i < len(self.toks) and self.text(i) not in ends:
            i += 1
        return i

    def dotted(self, i: int, joints: str = ".") -> tuple[str, int]:
        """A name of several parts from token ``i``, and the token after it."""
        k = i
        while self.word(k) or self.text(k) in (*joints, "::", "*") and k < len(self.toks):
            if k > i and self.word(k) and self.word(k - 1):
                break
            k += 1
        return "".join(self.text(j) for j in range(i, k)), k

    def run(self) -> Scan:
        i = 0
        while i < len(self.toks):
            kind, t = self.toks[i][:2]
            if t == "{" and kind == "p":
                self.stack.append(self.opens.get(i, ("block", "", None)))
            elif t == "}" and kind == "p":
                if self.stack and (s := self.stack.pop()[2]):
                    s.end = self.toks[i][3]
            elif t == "#" and self.language == "c" and self.text(i + 1) == "include":
                if m := re.compile(r'\s*[<"]([^>"\n]+)').match(self.source, self.toks[i + 1][3]):
                    self.edge(self.path, "imports", m[1])
                    i = next((k for k in range(i, len(self.toks)) if self.toks[k][2] > m.end()), len(self.toks)) - 1
            elif kind == "w":
                i = self.at_word(i, t)
            i += 1
        for _, _, s in self.stack:
            if s:
                s.end = len(self.source)
        return self

    def in_code(self) -> bool:
        return any(k == "code" for k, *_ in self.stack)

    def at_word(self, i: int, t: str) -> int:
        """Handle the word at ``i``; gives the last token that is done with."""
        before = self.text(i - 1)
        if before not in (".", "->", "::") and (done := self.statement(i, t)) is not None:
            return done
        if t in self.lang.kinds and before not in (".", "->", "::") and self.word(i + 1) and not (self.text(i + 1) in self.lang.kinds and t != "enum"):
            return self.keyword(i, t)
        if t in self.lang.variables and not self.in_code() and self.word(i + 1) and (self.word(i + 1) and self.text(i + 1) not in ("fn", "mut", "enum")):
            arrow = self.text(i + 2) == "=" and any(self.text(k) in ("=>", "function") for k in range(i + 3, min(self.until(i + 3, ";", "{") + 1, i + 40)))
            body = self.until(i, "{", ";") if arrow else None
            self.declare("function" if arrow else "variable", self.qualified(self.text(i + 1)), i, body if body is not None and self.text(body) == "{" else None, "code")
            return i + 1
        after = i + 1
        if self.text(after) == "<" and self.lang.methods and self.closing(after) - after < 16:
            after = self.closing(after) + 1
        if self.text(after) == "(" and t not in CONTROL:
            return self.call_or_method(i, t, after)
        return i

    def statement(self, i: int, t: str) -> int | None:
        """Packages and imports, and what only one language has; nothing if it is neither."""
        lang = self.language
        if t == "package" and self.lang.root == "package" and not self.root:
            self.root, k = self.dotted(i + 1)
            return k - 1
        if lang == "go":
            return self.go(i, t)
        if t == "import" and lang in ("java", "kt"):
            name, k = self.dotted(i + 2 if self.text(i + 1) == "static" else i + 1)
            self.edge(self.path, "imports", name)
            return k - 1
        if t == "using" and lang == "cs" and not self.in_code() and self.word(i + 1):
            at = i + 2 if self.text(i + 1) == "static" else i + 3 if self.text(i + 2) == "=" else i + 1
            name, k = self.dotted(at)
            self.edge(self.path, "imports", name)
            return k - 1
        if t == "import" and lang == "proto" or lang == "js" and (t in ("import", "from") and self.toks[min(i + 1, len(self.toks) - 1)][0] == "s" or t in ("require", "import") and self.text(i + 1) == "("):
            k = next((k for k in range(i + 1, min(i + 4, len(self.toks))) if self.toks[k][0] == "s"), None)
            if k is not None:
                self.edge(self.path, "imports", self.text(k)[1:-1])
                return k
        if lang == "rs" and t == "use":
            end = self.until(i, ";")
            for name in self.use_tree(i + 1, end)[0]:
                self.edge(self.path, "imports", name)
            return end
        if lang == "rs" and t == "impl" and not self.in_code():
            at = self.closing(i + 1) + 1 if self.text(i + 1) == "<" else i + 1
            body = self.until(at, "{", ";")
            names = [k for k in range(at, body) if self.text(k) == "for"]
            first = self.dotted(at)[0].rsplit("::", 1)[-1]
            owner = self.dotted(names[0] + 1)[0].rsplit("::", 1)[-1] if names else first
            self.opens[body] = ("type", self.qualified(owner), None)
            if names:
                self.edge(self.qualified(owner), "implements", first)
            return body - 1
        return None

    def use_tree(self, i: int, end: int, head: str = "") -> tuple[list[str], int]:
        """The paths of a use declaration, with groups written out and aliases left off; ``self`` stands for the path before it."""
        out, name = [], head
        while i < end:
            t = self.text(i)
            if t == "{":
                close = self.closing(i)
                at = i + 1
                while at < close:
                    more, at = self.use_tree(at, close, name)
                    out += more
                    at += 1
                name, i = "", close
            elif t == ",":
                break
            elif t == "as":
                i += 1
            elif t == "self" and name.endswith("::"):
                name = name[:-2]
            elif t != "pub":
                name += t
            i += 1
        return (out + [name] if name and not name.endswith("::") else out), i

    def go(self, i: int, t: str) -> int | None:
        if t == "import" and not self.stack:
            end = self.closing(i + 1) if self.text(i + 1) == "(" else next((k for k in range(i + 1, len(self.toks)) if self.toks[k][0] == "s"), i)
            for k in range(i + 1, end + 1):
                if self.toks[k][0] == "s":
                    self.edge(self.path, "imports", self.text(k)[1:-1])
            return end
        if t == "func" and (self.word(i + 1) or self.text(i + 1) == "(" and not self.in_code() and self.word(self.closing(i + 1) + 1)):
            name, at = self.text(i + 1), i + 2
            kind = "function"
            if not self.word(i + 1):
                close = self.closing(i + 1)
                own = [self.text(k) for k in range(i + 2, close) if self.word(k) or self.text(k) in "*["]
                own = own[: own.index("[")] if "[" in own else own
                name, kind, at = f"({'*' if '*' in own else ''}{own[-1]}).{self.text(close + 1)}", "method", close + 2
            close = self.closing(self.until(at, "("))
            body = self.until(close, "{")
            while body + 1 < len(self.toks) and self.text(body - 1) in ("interface", "struct"):  # a type in the results
                body = self.until(self.closing(body) + 1, "{")
            self.declare(kind, self.qualified(name), i, body, "code")
            return close
        if t == "type" and not self.in_code():
            group = self.closing(i + 1) if self.text(i + 1) == "(" else None
            at = i + 2 if group else i + 1
            while self.word(at):
                kind = {"struct": "struct", "interface": "interface"}.get(self.text(at + 1), "type")
                body = at + 2 if kind != "type" and self.text(at + 2) == "{" else None
                s = self.declare(kind, self.qualified(self.text(at)), at if group else i, None, "type")
                if body is None:
                    return at
                close = self.closing(body)
                s.end = self.toks[close][3]
                if kind == "interface":  # a word alone on its line is an embedded interface
                    for k in range(body + 1, close):
                        line = self.source[self.source.rfind("\n", 0, self.toks[k][2]) + 1 : (self.source.find("\n", self.toks[k][2]) + 1 or len(self.source)) - 1]
                        if self.word(k) and re.fullmatch(rf"\s*(?:\w+\.)?{re.escape(self.text(k))}\s*(?://.*)?", line):
                            self.edge(s.name, "extends", self.text(k))
                at = close + 1
                if not group:
                    return close
            return group or i
        if t in ("var", "const") and not self.stack:
            if self.text(i + 1) != "(":
                if self.word(i + 1):
                    self.declare("variable", self.qualified(self.text(i + 1)), i, None, "block")
                return i + 1
            end, depth, k = self.closing(i + 1), 0, i + 2
            while k < end:
                line = self.source.rfind("\n", 0, self.toks[k][2])
                first = not self.source[line + 1 : self.toks[k][2]].strip()
                depth += (self.text(k) in ("(", "{", "[")) - (self.text(k) in (")", "}", "]"))
                if self.word(k) and first and not depth:
                    self.declare("variable", self.qualified(self.text(k)), k, None, "block")
                k += 1
            return end
        return None

    def keyword(self, i: int, t: str) -> int:
        """A declaration that begins with a keyword and a name."""
        at = i + 2 if t == "enum" and self.text(i + 1) in ("class", "struct") else i + 1
        kind = self.lang.kinds[t]
        name, k = (self.dotted(at) if kind == "module" else (self.text(at), at + 1))
        if kind == "function" and self.in_code() and self.language != "js":
            return at
        if kind == "function" and self.stack and self.stack[-1][0] == "type":
            kind = "method"
        callable_ = kind in ("function", "method")
        body = self.until(k, "{", ";") if not callable_ else self.until(self.closing(p) if self.text(p := self.until(k, "(", "{", ";")) == "(" else p, "{", ";", "}")
        has = body < len(self.toks) and self.text(body) == "{"
        if self.language == "c" and not has and kind != "class":
            return at  # a type that is only named
        if self.language == "c" and has and any(self.text(j) in ("(", ")", "=", "*") for j in range(k, body)):
            return at  # a type of a parameter or a result
        if self.language in ("js", "kt") and kind == "type" and t == "type":
            has = False
        full = self.qualified(name)
        self.declare(kind, full, i, body if has else None, "code" if callable_ else "module" if kind == "module" else "type")
        if not callable_ and kind != "module":
            self.heritage(full, k, min(body, len(self.toks)))
        if t == "rpc":
            for j in range(k, min(body, len(self.toks))):
                if self.word(j) and self.text(j - 1) in ("(", "stream"):
                    self.edge(full, "uses", self.text(j))
        return k - 1 if not callable_ else at

    def heritage(self, name: str, i: int, end: int) -> None:
        """``extends`` and ``implements`` between a name and its body; after a colon all are extended."""
        predicate, k = "", i
        while k < end:
            t = self.text(k)
            if t in ("(", "[", "<") and not (t == "<" and not predicate and False):
                k = self.closing(k)
            elif t in ("extends", "implements", "with"):
                predicate = "implements" if t == "implements" else "extends"
            elif t == ":":
                predicate = "extends"
            elif t in ("where", "=", "permits"):
                return
            elif predicate and self.word(k) and t not in ("public", "private", "protected", "virtual"):
                base, after = self.dotted(k)
                self.edge(name, predicate, base)
                k = after - 1
            k += 1

    def call_or_method(self, i: int, t: str, after: int) -> int:
        """A word before a bracket: inside a function a call; elsewhere, with a body or in a type, a function or method."""
        close = self.closing(after)
        owner = next((n for k, n, _ in reversed(self.stack) if k == "code"), None)
        k = close + 1
        while self.lang.methods and k < len(self.toks) and k < close + 24 and (self.word(k) or self.text(k) in (":", ".", ",", "<", ">", "[", "]", "?", "&", "*", "->", "|", "::")):
            k += 1
        place = self.stack[-1][0] if self.stack else "module"
        abstract = place == "type" and self.text(k) == ";" and (self.word(i - 1) or self.text(i - 1) in (">", "]", "*", "&") or self.language == "js")
        if self.lang.methods and owner is None and place != "block" and (self.text(k) == "{" or abstract) and self.text(i - 1) not in (".", "new", "="):
            if self.language == "js" and place == "module":
                return i
            name, first = t, i
            while self.language == "c" and self.text(first - 1) == "::" and self.word(first - 2):
                first -= 2
                name = f"{self.text(first)}::{name}"
            kind = "method" if place == "type" and self.language != "c" else "function"
            self.declare(kind, self.qualified(name), first, k if self.text(k) == "{" else None, "code")
            return k - 1
        if t not in self.lang.kinds and (owner or self.language == "js"):
            self.edge(owner or self.path, "calls", t)
        return i


def _shell(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Functions of a shell script with the commands they call, and sourced files."""
    root = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    text = re.sub(r"""(?m)(?<!\\)'[^']*'|"(?:\\.|[^"\\])*"|(?:^|(?<=\s))#[^\n]*""", lambda m: re.sub(r"[^\n]", "_" if m[0][0] != "#" else " ", m[0]), source)
    symbols, edges = [], [(path, "imports", source[m.start(1) : m.end(1)]) for m in re.finditer(r"(?m)^\s*(?:source|\.)\s+([^\s;]+)", text)]
    for m in re.finditer(r"(?m)^[ \t]*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{|^[ \t]*function\s+([A-Za-z_][\w-]*)\s*\{", text):
        end, depth = m.end(), 1
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        name = f"{root}.{m[1] or m[2]}"
        symbols.append(("function", name, m.start(), end))
        edges.append((path, "defines", name))
        edges += [(name, "calls", c) for c in re.findall(r"(?m)(?:^|[;&|(]|\b(?:then|do|else|if|while|!))[ \t]*(?!(?:then|do|else|if|while)\b)([A-Za-z_][\w-]*)(?=[ \t\n;)&|]|$)(?![ \t]*\(\))", text[m.end() : end - 1]) if c not in SHELL_WORDS]
    return symbols, edges


#: Fixed list: words of the shell's own grammar.
SHELL_WORDS = frozenset("if then else elif fi for while until do done case esac in function select time local export return exit set unset shift break continue declare readonly true false".split())


def _blocks(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Top-level blocks of a configuration with labels, named by kind and labels; modules import their source."""
    symbols, edges = [], []
    for m in re.finditer(r"""(?m)^(resource|data|module|variable|output|provider|locals|terraform)((?:\s+"[^"\n]*")*)\s*\{""", source):
        end, depth = m.end(), 1
        while end < len(source) and depth:
            depth += (source[end] == "{") - (source[end] == "}")
            end += 1
        name = ".".join([m[1], *re.findall(r'"([^"]*)"', m[2])])
        symbols.append(("module" if m[1] == "module" else "variable", name, m.start(), end))
        edges.append((path, "defines", name))
        if m[1] == "module" and (at := re.search(r'(?m)^\s*source\s*=\s*"([^"]+)"', source[m.end() : end])):
            edges.append((name, "imports", at[1]))
    return symbols, edges


def _rows_of(kind: str, defines: str, imports: str | None = None) -> Callable[[str, str], tuple[list[tuple], list[tuple]]]:
    """Symbols and imports of a language of lines, by the first group that a pattern has."""

    def run(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
        found = [(next(g for g in m.groups() if g), m.start(), m.end()) for m in re.finditer(defines, source)]
        edges = [(path, "imports", next(g for g in m.groups() if g)) for m in re.finditer(imports, source)] if imports else []
        return [(kind, n.strip(), a, z) for n, a, z in found], edges + [(path, "defines", n.strip()) for n, *_ in found]

    return run


OTHERS: dict[str, Callable[[str, str], tuple[list[tuple], list[tuple]]]] = {
    "sh": _shell, "bash": _shell, "tf": _blocks, "hcl": _blocks,
    "css": _rows_of("variable", r"(?m)^\s*([.#][\w-]+)[^{};]*\{", r"""@import\s+(?:url\(\s*)?(?:"([^"]+)"|'([^']+)'|([^'")\s;]+))"""),
    "toml": _rows_of("variable", r"(?m)^\s*\[+\s*([^\]\n]+?)\s*\]+|^([A-Za-z_][\w-]*)\s*="),
    "yaml": _rows_of("variable", r"(?m)^([A-Za-z_][\w-]*)\s*:(?=\s|$)"), "yml": _rows_of("variable", r"(?m)^([A-Za-z_][\w-]*)\s*:(?=\s|$)"),
    "dockerfile": _rows_of("variable", r"(?mi)^FROM\s+(?:--\S+\s+)*\S+\s+AS\s+(\S+)", r"(?mi)^FROM\s+(?:--\S+\s+)*(\S+)"),
}


def scan(path: str, source: str | None) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, str, str]]]:
    """Symbols (kind, qualified name, start, end) with their extent in characters, and edges (subject, predicate, object); none for other languages.

    The file is the first symbol. Repeated symbols and edges are left out; a null source is empty.
    """
    end = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if end in OTHERS:
        symbols, edges = OTHERS[end](path, source or "")
        every = {(k, n): (k, n, a, z) for k, n, a, z in reversed([("file", path, 0, 0), *symbols])}
        return list(reversed(every.values())), list(dict.fromkeys(edges))
    language = ENDINGS.get(end) if "." in path else None
    if language is None:
        return [], []
    done = Scan(path, source or "", language).run()
    symbols = {(s.kind, s.name): (s.kind, s.name, s.start, s.end) for s in reversed(done.symbols)}
    return list(reversed(symbols.values())), list(dict.fromkeys(done.edges))
