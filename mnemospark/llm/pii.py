"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate spans by features of the entire segment (shape, digits, check digit,
borders, words before) and a dynamic program over bounded segments picks boundaries and types
jointly. It is trained on windows whose labels are the base spans, on copies of these windows
in which a span is written another way (no country code, other separators, spelled-out signs), and on copies in which
it is spoiled (a part above 255, a wrong check digit, a date) and stands for nothing.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the fit: documents read for windows, and windows used of each kind.
MAX_DOCUMENTS = 4000
WINDOWS_PER_KIND = 250
#: A segment has at most so many tokens, and a phone or card number at most so many digits and groups between blanks.
MAX_TOKENS = 40
MAX_DIGITS = 19
MAX_GROUPS = 6
REACH = 28
_SIZE = 1 << 13

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
_AT = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of the base patterns, by kind and then start; linear in the text."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        seg = text[free:at]
        start = at - (len(seg) - len(seg.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_parts(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def windows(text: str, base: list[Span] = ()) -> list[tuple[int, int]]:
    """Stretches around anything that could be a candidate; none cuts a word, and no candidate beside the ``base`` spans lies outside them."""
    marks = [(m.start(), m.end()) for m in _AT.finditer(text)] if "at" in text or "AT" in text or "At" in text else []
    at = text.find("@")
    while at >= 0:
        marks.append((at, at + 1))
        at = text.find("@", at + 1)
    marks += [(m.start(), m.end()) for m in _RUN.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    out: list[list[int]] = []
    k = 0
    for a, b in sorted(marks):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] <= a and b <= taken[k][1]:
            continue
        last = out[-1][1] if out else 0
        a, b = max(0, a - REACH), max(last, min(len(text), b + REACH))
        while a > last and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= last:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % _SIZE


#: What was worked out before, for features by name and segments by text; plain tables, so that tasks can ship them by value.
_KNOWN: dict[tuple, object] = {}
_MOST_KNOWN = 300_000


def _remember(key: tuple, value: object) -> object:
    if len(_KNOWN) >= _MOST_KNOWN:
        _KNOWN.clear()
    _KNOWN[key] = value
    return value


def _id(kind: str, name: str) -> int:
    found = _KNOWN.get((kind, name))
    return _remember((kind, name), _hash(f"{kind}|{name}")) if found is None else found


def _ids(kind: str, names: tuple[str, ...]) -> list[int]:
    found = _KNOWN.get((kind, names))
    return _remember((kind, names), [_id(kind, n) for n in names]) if found is None else found


_SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})


def _edge(c: str, end: str) -> str:
    return end if not c else " " if c.isspace() else "x" if c.isalnum() else c


def _shared(s: str, left: str, right: str, before: str) -> tuple[str, ...]:
    """Names of the features of a segment that its kind does not change."""
    found = _KNOWN.get((s, left, right, before))
    if found is not None:
        return found
    d = len(_digits(s))
    groups = [(k, sum(1 for _ in g)) for k, g in groupby(s.translate(_SHAPE))]
    shape = "".join("a" if k == "a" else str(min(n, 9)) if k == "0" else k * n for k, n in groups)
    kinds = [k for k, _ in groups]
    first = "0" if kinds[0] == "0" else "a" if s[0].isalnum() else s[0]
    names = (
        "bias", f"digits={min(d, 21)}", "shape=" + shape[:24], "first=" + first, "left=" + _edge(left, "^"), "right=" + _edge(right, "$"), "before=" + before, f"parts={min(kinds.count('0'), 8)}",
        f"letters={'a' in kinds}", f"dots={min(s.count('.'), 4)}", f"hyphens={min(s.count('-'), 4)}", "signs=" + "".join(sorted({k for k in kinds if k not in 'a0. -'}))[:6],
    )
    return _remember((s, left, right, before), names)


def _features(text: str, a: int, b: int, before: str, kind: str) -> list[int]:
    s = text[a:b]
    if kind == "card" or kind == "phone":
        d = _digits(s)
        own = f"luhn={13 <= len(d) <= 19 and luhn(d)}"
    elif kind == "ip":
        own = f"ip={_ip_parts(s)}"
    else:
        own = f"at={'@' in s}{bool(_AT.search(s))}{'.' in s or 'dot' in s.lower()}"
    return [*_ids(kind, _shared(s, text[a - 1 : a] if a else "", text[b : b + 1], before)), _id(kind, own)]


def candidates(text: str, lo: int, hi: int, base: list[Span] = ()) -> tuple[int, list[tuple[int, int, str, int, int, list[int]]]]:
    """Tokens in a window, and its candidate segments (first token, end token, kind, start, end, features).

    A candidate neither begins nor ends inside a word or a number with separators, and touches no ``base`` span.
    """
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, lo, hi)]
    taken = sorted((a, b) for _, a, b in base if a < hi and b > lo)
    ends = list(accumulate((b for _, b in taken), max))  # base spans of different kinds may overlap
    free = lambda a, b: not (k := bisect_left(taken, (b,))) or ends[k - 1] <= a
    joined = lambda i: 0 < i < len(tokens) and tokens[i - 1][1] == tokens[i][0]
    inner = lambda i, signs: joined(i) and (tokens[i - 1][2].isalnum() or tokens[i - 1][2] in signs and joined(i - 1) and tokens[i - 2][2].isalnum())
    goes_on = lambda j, signs: joined(j + 1) and (tokens[j + 1][2].isalnum() or tokens[j + 1][2] in signs and joined(j + 2) and tokens[j + 2][2].isalnum())
    out = []
    word = ""
    for i, (a, _, first) in enumerate(tokens):
        before, word = word, first.lower() if first.isalpha() else word
        if (first.isdigit() or first in "+(") and not inner(i, ".-"):
            d = dots = others = blanks = 0
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                s, e, t = tokens[j]
                if j > i and s - tokens[j - 1][1] > 1 or not (t.isdigit() and t.isascii() or t in "().-" or t == "+" and j == i):
                    break
                blanks += j > i and s > tokens[j - 1][1]
                if blanks >= MAX_GROUPS:
                    break
                if not t.isdigit():
                    dots, others = dots + (t == "."), others + (t != ".")
                    continue
                others += j > i and s > tokens[j - 1][1]
                d += e - s
                if d > MAX_DIGITS:
                    break
                if goes_on(j, ".-") or not free(a, e):
                    continue
                if dots == 3 and not others and d <= 12:
                    out.append((i, j + 1, "ip", a, e, _features(text, a, e, before, "ip")))
                    continue
                for kind, least, most in (("card", 13, 19), ("phone", 7, 15)):
                    if least <= d <= most:
                        out.append((i, j + 1, kind, a, e, _features(text, a, e, before, kind)))
        if first.isalnum() and not inner(i, "._%+-"):
            sign = 0
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                s, e, t = tokens[j]
                gap = s - tokens[j - 1][1] if j > i else 0
                if gap > 1 or gap and not (tokens[j - 1][2] in ")]" or t in "[("):
                    break
                sign = sign or (j if t == "@" or t.lower() == "at" and tokens[j - 1][2] in "([" and j > i else 0)
                if sign and j > sign + 1 and t.isalnum() and t.isascii() and t.lower() != "dot" and tokens[j - 1][2] in ".)]-" and not goes_on(j, ".-") and free(a, e):
                    out.append((i, j + 1, "email", a, e, _features(text, a, e, before, "email")))
    return len(tokens), out


class SemiMarkov:
    """Weights of whole-span features; a token outside every span scores 0."""

    def __init__(self, weight: np.ndarray | None = None):
        self.weight: list[float] = [0.0] * _SIZE if weight is None else list(map(float, weight))

    def _score(self, seg) -> float:
        return sum(map(self.weight.__getitem__, seg[5]))

    def best(self, n: int, segs: list) -> list:
        """Segments of the highest-scoring segmentation of ``n`` tokens."""
        ends: dict[int, list] = {}
        for s in segs:
            ends.setdefault(s[1], []).append((self._score(s), s))
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for v, s in ends.get(j, ()):
                if top[s[0]] + v > top[j]:
                    top[j], back[j] = top[s[0]] + v, s
        out, j = [], n
        while j > 0:
            if back[j]:
                out.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def marginals(self, n: int, segs: list) -> tuple[float, list[float]]:
        """Log of the sum of all segmentations' weights, and the probability of every segment, by forward and backward sums."""
        score = [self._score(s) for s in segs]
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for x, s in enumerate(segs):
            by_end.setdefault(s[1], []).append(x)
            by_start.setdefault(s[0], []).append(x)
        for j in range(1, n + 1):
            terms = [ahead[j - 1]] + [ahead[segs[x][0]] + score[x] for x in by_end.get(j, ())]
            m = max(terms)
            ahead[j] = m + math.log(sum(math.exp(t - m) for t in terms))
        for i in range(n - 1, -1, -1):
            terms = [behind[i + 1]] + [behind[segs[x][1]] + score[x] for x in by_start.get(i, ())]
            m = max(terms)
            behind[i] = m + math.log(sum(math.exp(t - m) for t in terms))
        return ahead[n], [math.exp(min(0.0, ahead[s[0]] + score[x] + behind[s[1]] - ahead[n])) for x, s in enumerate(segs)]

    def fit(self, data: list[tuple[int, list, set]], epochs: int = 8, rate: float = 0.3, seed: int = 7) -> SemiMarkov:
        """Maximise the conditional likelihood of the gold segments by AdaGrad over the span marginals."""
        square = [1e-6] * _SIZE
        order = list(range(len(data)))
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                n, segs, gold = data[k]
                if not segs:
                    continue
                grad: dict[int, float] = {}
                for s, p in zip(segs, self.marginals(n, segs)[1], strict=True):
                    g = (1.0 if s[2:5] in gold else 0.0) - p
                    if abs(g) > 1e-4:
                        for f in s[5]:
                            grad[f] = grad.get(f, 0.0) + g
                for f, g in grad.items():
                    g -= 1e-4 * self.weight[f]
                    square[f] += g * g
                    self.weight[f] += rate * g / math.sqrt(square[f])
        return self

    def spans(self, text: str, base: list[Span] = ()) -> list[Span]:
        """What the field finds beside the ``base`` spans."""
        out = []
        for lo, hi in windows(text, base):
            n, segs = candidates(text, lo, hi, base)
            out += [(s[2], s[3], s[4]) for s in self.best(n, segs)] if segs else []
        return out


def _rewritten(window: str, span: Span, rng: random.Random) -> tuple[str, Span]:
    """The window with its span written another way."""
    kind, a, b = span
    s = window[a:b]
    if kind == "email":
        left, right = s.split("@", 1)
        at = rng.choice(["(at)", "[at]", " (at) ", " [at] "])
        dot = rng.choice([".", "(dot)", " (dot) ", "[dot]"])
        s = left + at + right.replace(".", dot)
    elif kind == "phone":
        d = _digits(s)[-10:]
        sep = rng.choice([" ", ".", "-"])
        plain = sep.join((d[:3], d[3:6], d[6:])) if len(d) == 10 else d
        s = rng.choice([s[s.index(" ") + 1 :] if " " in s else s[1:], s.replace(" ", "."), s[1:], re.sub(r"[()]", "", s), plain, plain])
    elif kind == "card":
        d = _digits(s)
        sep = rng.choice([".", " ", "-"])
        s = sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    return window[:a] + s + window[b:], (kind, a, a + len(s))


def _spoiled(window: str, span: Span, rng: random.Random) -> str:
    """The window with something in the place of its span that looks like it and is nothing."""
    kind, a, b = span
    s = window[a:b]
    if kind == "ip":
        parts = s.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 9999))
        s = rng.choice([".".join(parts), f"{s}.{rng.randint(0, 99)}", f"v{s}"])
    elif kind == "card":
        d = _digits(s)
        d = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        sep = rng.choice(["", "", ".", " ", "-"])
        s = sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    elif kind == "phone":
        y, m, d = rng.randint(1900, 2099), rng.randint(10, 12), rng.randint(10, 28)
        s = rng.choice([f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{y}-{m}-{d} {m}.{d}", f"{rng.randint(1, 99)} {m} {d} {y}", str(rng.randint(10**7, 10**12))])
    else:
        s = s.replace("@", " ").replace(".", " ")
    return window[:a] + s + window[b:]


def fit_windows(texts: list[str], seed: int = 7, per_kind: int = WINDOWS_PER_KIND) -> SemiMarkov:
    """Fit on windows of texts: as they are, rewritten, and spoiled; spoiled ones and those without a base span teach what is nothing."""
    rng = random.Random(seed)
    data, used = [], dict.fromkeys((*KINDS, ""), 0)
    for text in texts:
        spans = base_spans(text)
        for lo, hi in windows(text):
            inside = [(k, a - lo, b - lo) for k, a, b in spans if lo <= a and b <= hi]
            kind = inside[0][0] if inside else ""
            if used[kind] >= per_kind or any(p[1] < q[2] and q[1] < p[2] for p in inside for q in inside if p is not q):
                continue
            used[kind] += 1
            window = text[lo:hi]
            data.append((*candidates(window, 0, len(window)), set(inside)))
            if len(inside) == 1:
                if kind != "ip":
                    other, span = _rewritten(window, inside[0], rng)
                    data.append((*candidates(other, 0, len(other)), {span}))
                nothing = _spoiled(window, inside[0], rng)
                data.append((*candidates(nothing, 0, len(nothing)), set()))
    model = SemiMarkov().fit(data)
    _KNOWN.clear()  # tasks start with an empty table instead of a copy of this one
    return model


def fit_pii(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> SemiMarkov:
    """Fit on at most ``max_documents`` texts that hold a sign of personal data, the first by hash; only their windows leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [t[lo:hi] for t in b.column(0).to_pylist() for lo, hi in windows(t) if hi - lo < 2000]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["window"])

    hinted = docs.where(F.col("text").contains("@") | F.col("text").rlike(r"\+[0-9]|[0-9][ .-]?[0-9]{3}[ .-]?[0-9]")).select("text", F.xxhash64("text").alias("h"))
    cut = hinted.select("h").orderBy("h").limit(max_documents).agg(F.max("h")).head()[0]
    if cut is None:
        return SemiMarkov()
    found = hinted.where(F.col("h") <= cut).select("text").distinct().mapInArrow(run, "window string").distinct().orderBy(F.xxhash64("window")).limit(8 * WINDOWS_PER_KIND)
    return fit_windows([r.window for r in found.collect()])


def find_spans(text: str | None, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: what the field adds never touches a base span. Both by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    extra = model.spans(text, base) if "@" in text or _DIGIT.search(text) or _AT.search(text) else []
    return base, sorted({*base, *extra}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """Rows (doc_id, base, spans), one per input row; spans are arrays of (kind, start, end) in code points.

    A null text counts as empty; null and repeated ids stay rows of their own; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find_spans(t, model) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_rows(x) for x, _ in both], kind), pa.array([as_rows(y) for _, y in both], kind)], ["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, the hash of their list, and the list of all spans, per row of ``found``."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
