"""Main-text extraction by the maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive and tags negative, and words under a
mark (an element, role, class or id that mostly holds something else) score negative too. All weights
are log ratios learned from pages whose markup labels the content (one ``article`` element). A
linear scan finds the contiguous region with the largest sum; its blocks that score negative are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many labelled pages are used for fitting.
MAX_PAGES = 2000
#: Bounds of the learned log ratios: of a word or mark, and of a tag.
MOST_RATIO, MOST_WORD, MOST_TAG = 6.0, 2.0, 0.5

#: Fixed lists of HTML: elements whose content is never text, void elements, and inline elements.
RAW = {"script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "ms", "msub", "msup", "mtext",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tspan", "tt", "u", "var", "wbr", "ruby", "rb", "rt", "rp", "nobr",
}
#: Fixed lists of words: elements, roles, and class and id names that mark page furniture; those of the second list only outside ``article`` and ``main``.
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "select", "textarea"}
OUTSIDE_TAGS = {"noscript"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar"}
FURNITURE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "related", "replies", "share", "sharing", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "widget",
}
OUTSIDE_NAMES = {"alert", "banner", "copyright", "cta", "discussion", "header", "login", "masthead", "respond", "search", "skip", "social", "toolbar", "topbar"}
#: Fixed list of words that may stand beside such a name in a compound.
PLACE_NAMES = {"area", "bar", "block", "bottom", "box", "container", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "page", "primary", "reader", "right", "section", "site", "slot", "top", "user", "wrap", "wrapper"}
COMMENT_NAMES = {"comment", "comments", "reply", "replies", "discussion"}
CONTENT_TAGS = {"article", "main"}
_ONCE = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>?|</?[A-Za-z][^<>]*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTR = re.compile(r"""([A-Za-z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_END_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


@dataclass(eq=False)
class Context:
    """What is open around a block: the marks of the innermost marked element, the context around that, and whether content is open."""

    parent: Context | None
    marks: tuple[str, ...] = ()
    inside: bool = False
    listed: bool = False


@dataclass
class Block:
    """Text between two block boundaries, the tags passed since the block before, and what is open around it."""

    text: str
    context: Context
    tags: list[str] = field(default_factory=list)

    @property
    def inside(self) -> bool:
        return self.context.inside


def _listed(mark: str, inside: bool) -> bool:
    """True for marks on the fixed lists; a compound name counts if it holds a listed name and otherwise words of place."""
    kind, _, name = mark.partition(":")
    if not name:
        return kind in FURNITURE_TAGS or kind == "hidden" or not inside and kind in OUTSIDE_TAGS
    if kind == "role":
        return name in FURNITURE_ROLES
    names = FURNITURE_NAMES if inside else FURNITURE_NAMES | OUTSIDE_NAMES
    parts = name.split("-")
    return name in names or any(p in names for p in parts) and all(p in names or p in PLACE_NAMES for p in parts)


def _marks(name: str, tag: str, inside: bool) -> list[str]:
    """Marks of an opening tag. Within content only listed ones count; content elements are marked only as comments."""
    out = [name] if name in FURNITURE_TAGS or name in OUTSIDE_TAGS else []
    if "=" in tag or "hidden" in tag:
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(tag)}
        if re.search(r"\shidden(?:[\s=/>]|$)", tag) or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
            out.append("hidden")
        if name not in ("body", "html"):
            if attrs.get("role"):
                out.append("role:" + attrs["role"].lower())
            for key in ("class", "id"):
                out += [f"{key}:{re.sub('[0-9]+', '#', w)}" for w in attrs.get(key, "").lower().replace("_", "-").split()]
    if name in CONTENT_TAGS:
        return [m for m in out if set(m.partition(":")[2].split("-")) & COMMENT_NAMES]
    return [m for m in out if _listed(m, True)] if inside else out


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, empty ones left out; malformed and unclosed markup is read as far as it goes, in linear time."""
    out: list[Block] = []
    stack: list[tuple[str, Context]] = []  # open elements and the context outside each
    solid: list[int] = []  # places of the elements on the stack that are not inline
    open_: Counter = Counter()
    here = Context(None)
    text: list[str] = []
    tags: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal tags
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append(Block(joined, here, tags))
            tags = []

    def close(k: int) -> None:
        nonlocal here
        here = stack[k][1]
        for name, _ in stack[k:]:
            open_[name] -= 1
        del stack[k:]
        while solid and solid[-1] >= k:
            solid.pop()

    while at < n:
        m = _TOKEN.match(page, at)
        token = m[0]
        at = m.end()
        named = _NAME.match(token)
        if not named:
            if token[:2] not in ("<!", "<?"):
                text.append(token)
            continue
        name = named[1].lower()
        closing = token[1] == "/"
        if name in RAW and not closing:
            end = _END_RAW[name].search(page, at)
            at = end.end() if end else n
            tags.append(name)
            continue
        block = name not in INLINE
        if block:
            flush()
        if closing:
            if open_[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if not block and stack[k][1] is not here:
                    flush()
                close(k)
            tags.append("/" + name)
            continue
        if name in _ONCE and solid and stack[solid[-1]][0] == name:
            close(solid[-1])
        marks = _marks(name, token, here.inside)
        if not block:  # a styled part of a line is no block of its own
            marks = [m for m in marks if _listed(m, here.inside)]
            if marks:
                flush()
        tags.append(name)
        if name not in VOID and not token.rstrip(">").endswith("/"):
            stack.append((name, here))
            open_[name] += 1
            if block:
                solid.append(len(stack) - 1)
            if marks or name in CONTENT_TAGS:
                listed = here.listed or any(_listed(m, here.inside) for m in marks) or name in CONTENT_TAGS and bool(marks)
                here = Context(here, tuple(marks), here.inside or name in CONTENT_TAGS, listed)
    flush()
    return out


@dataclass
class ContentModel:
    """``word``: score of a word under no mark; ``furniture``: what marks add, of which ``inside`` and ``outside`` stand for
    being within or beyond the content that a page names; ``tags``: scores by tag. Unseen listed marks add ``other_furniture``.

    As it is made, nothing is learned: words count 1, tags a little, and no mark counts.
    """

    word: float = 1.0
    furniture: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    other_furniture: float = 0.0
    most_furniture: float = -3.0
    other_tag: float = -0.2
    most_inside: float = -0.5
    most_tags: float = -6.0

    def _lowest(self, context: Context, known: dict[int, float]) -> float:
        """The most negative of what the marks of a context and those around it add; each context is worked out once."""
        path: list[Context] = []
        at: Context | None = context
        while at is not None and id(at) not in known:
            path.append(at)
            at = at.parent
        low = known[id(at)] if at is not None else 0.0
        for c in reversed(path):
            within = c.parent is not None and c.parent.inside
            low = min([low, *(self.furniture.get(m, self.other_furniture if _listed(m, within) else 0.0) for m in c.marks)])
            known[id(c)] = low
        return low

    def scores(self, parts: list[Block]) -> list[tuple[float, float]]:
        """Per block the score of the tags before it, and of its words.

        A block whose words score negative for their marks is left out of any region, so a run of such
        blocks costs no more than ``most_furniture``. If the page names its content (an ``article`` or ``main`` element
        with text), words within add the weight of ``inside`` and words beyond that of ``outside``; within, tags between two
        blocks and runs of left-out blocks cost no more than ``most_inside``, less than any word gains.
        """
        known: dict[int, float] = {}
        plain = [self.word + self._lowest(b.context, known) for b in parts]
        named = any(b.inside and p > 0 for b, p in zip(parts, plain, strict=True))
        out: list[tuple[float, float]] = []
        spent = 0.0
        for b, each in zip(parts, plain, strict=True):
            words = b.text.count(" ") + 1
            within = named and b.inside
            floor = self.most_inside if within else self.most_tags
            if each <= 0:
                own = max(each * words, (self.most_inside if within else self.most_furniture) - spent)
                own = min(own, 0.0)
                before, spent = 0.0, spent + own
            else:
                each += self.furniture.get("inside" if within else "outside", 0.0) if named else 0.0
                own, spent = each * words, 0.0
                before = max(sum(self.tags.get(t, self.other_tag) for t in b.tags), floor)
            out.append((before, own))
        return out

    def region(self, parts: list[Block], scores: list[tuple[float, float]] | None = None) -> tuple[int, int]:
        """First and last but one index of the blocks with the largest sum; ties go to the longer, then to the earlier region."""
        best, span, run, start = 0.0, (0, 0), 0.0, 0
        for i, (before, own) in enumerate(self.scores(parts) if scores is None else scores):
            if run <= 0 or run + before <= 0:
                run, start = own, i
            else:
                run += before + own
            if run > best or run == best and best > 0 and i + 1 - start > span[1] - span[0]:
                best, span = run, (start, i + 1)
        return span

    def extract(self, page: str | None) -> str:
        """The blocks of the best region whose words score above 0, joined by spaces; empty if there is none."""
        parts = blocks(page or "")
        scores = self.scores(parts)
        a, z = self.region(parts, scores)
        return " ".join(b.text for b, (_, own) in zip(parts[a:z], scores[a:z], strict=True) if own > 0)


def page_counts(page: str | None) -> Counter:
    """Counts of words by mark, by place, and of tags, each by whether they stand within the labelled content.

    Content is what the one ``article`` holds under no listed mark.
    """
    found: Counter = Counter()
    if not page or len(re.findall(r"<article\b", page)) != 1:
        return found
    inside = False
    words: dict[int, list[int]] = {}
    order: list[Context] = []
    for b in blocks(page):
        size = b.text.count(" ") + 1
        content = b.inside and not b.context.listed
        found["w", "inside" if b.inside else "outside", content] += 0 if b.inside and not content else size
        c: Context | None = b.context
        new = []
        while c is not None and id(c) not in words:
            words[id(c)] = [0, 0]
            new.append(c)
            c = c.parent
        order += reversed(new)
        words[id(b.context)][content] += size
        if not b.context.listed:
            found["w", "", content] += size
        for t in b.tags:
            found["t", t, inside and content] += 1
        inside = content
    for c in reversed(order):  # parents come before their children
        for content in (0, 1):
            for m in set(c.marks):
                found["w", m, bool(content)] += words[id(c)][content]
            if c.parent is not None:
                words[id(c.parent)][content] += words[id(c)][content]
    return found


def fit_counts(counts: Counter) -> ContentModel:
    """Weights from summed page counts, as bounded log ratios; without labelled pages listed marks take the bound and the rest is as made."""
    ratio = lambda key, most: max(-most, min(most, math.log((counts[(*key, True)] + 1) / (counts[(*key, False)] + 1))))
    model = ContentModel(other_furniture=-MOST_RATIO)
    if not any(c and n for (k, _, c), n in counts.items() if k == "w"):
        return model
    model.word = max(0.5, ratio(("w", ""), MOST_WORD))
    for name in {x for k, x, _ in counts if k == "w" and x}:
        model.furniture[name] = ratio(("w", name), MOST_RATIO) if name in ("inside", "outside") else min(0.0, ratio(("w", name), MOST_RATIO))
    model.furniture["inside"] = max(1.0, model.furniture.get("inside", 0.0))
    share = {c: sum(n for (k, _, x), n in counts.items() if k == "t" and x == c) + 1 for c in (True, False)}
    for tag in {x for k, x, _ in counts if k == "t"}:
        weight = math.log((counts["t", tag, True] + 1) / share[True]) - math.log((counts["t", tag, False] + 1) / share[False])
        model.tags[tag] = min(-0.05, max(-MOST_TAG, weight))  # mild, so that lists and links inside content survive
    return model


def fit_pages(pages: DataFrame, max_pages: int = MAX_PAGES) -> ContentModel:
    """Fit on at most ``max_pages`` pages with one ``article`` element, the first by hash of their markup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for h in b.column(0).to_pylist():
                total.update(page_counts(h))
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for (k, _, _), _ in rows], pa.string()), pa.array([x for (_, x, _), _ in rows], pa.string()), pa.array([c for (_, _, c), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
            ["kind", "name", "content", "n"],
        )

    labelled = pages.where(F.col("html").contains("<article")).select("html", F.xxhash64("html").alias("h"))
    cut = labelled.select("h").distinct().orderBy("h").limit(max_pages).agg(F.max("h")).head()[0]
    if cut is None:
        return ContentModel()
    chosen = labelled.where(F.col("h") <= cut).dropDuplicates(["h"]).select("html")
    sums = chosen.mapInArrow(run, "kind string, name string, content boolean, n long").groupBy("kind", "name", "content").agg(F.sum("n").alias("n"))
    return fit_counts(Counter({(r.kind, r["name"], r.content): r.n for r in sums.collect()}))


def extract_pages(pages: DataFrame, model: ContentModel) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of ``pages``; null and empty pages give empty texts.

    Null and repeated ids stay rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
