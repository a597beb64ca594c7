"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

A text becomes symbols of one character each. An agenda holds the adjacent pairs whose union is a
piece, the best score first and of equal scores the leftmost; taking a pair joins its symbols and offers the
pairs at both sides. What no piece covers in the end is written as bytes. No piece of the
vocabulary reaches across a cut, so that the words between cuts are encoded by themselves: the unknown ones of an Arrow batch
side by side, each with its own agenda in a column of a matrix.
Every Arrow batch is also encoded and decoded by the sentencepiece library, and each row says whether both agree.
"""

from __future__ import annotations

import bisect
import codecs
import gc
import heapq
import re
import sys
import types
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: The first distinct words that a worker remembers, each of at most so many characters; others are encoded each time.
MAX_WORDS = 600_000
MAX_WORD_CHARS = 64
#: Words of up to so many characters keep their agenda in a column, so many words of about one length in a matrix.
SHORT = 24
COLUMNS = 2_000
NEVER = np.iinfo(np.int64).max
#: Kinds of characters that cuts tell apart; further kinds count as one.
KINDS = 8
#: Characters that are encoded, checked and handed on together; a longer text is a batch of its own.
BATCH_CHARS = 1_000_000
#: Stands for a control id between texts; no text holds it, as it is half a character and no byte's escape.
CONTROL = "\ud800"

codecs.register_error("piece-bytes", lambda e: ("�" * (e.end - e.start), e.end))  # type: ignore[union-attr]


class PieceModel:
    """A merge vocabulary: pieces with scores, byte pieces, and the words that were encoded lately.

    Only models that normalise nothing, add a leading space and keep repeated spaces are taken; others raise ``ValueError``.
    """

    def __init__(self, proto: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if lib.normalize(" ①  a\tＡ ") != f"{SPACE}{SPACE}①{SPACE}{SPACE}a\tＡ{SPACE}":
            raise ValueError("only models with identity normalisation and a leading space are supported")
        ids = range(lib.get_piece_size())
        self.surface = [lib.id_to_piece(i) for i in ids]
        self.unknown = lib.unk_id()
        self.control = {i for i in ids if lib.is_control(i)}
        self.byte_of = {i: int(self.surface[i][1:-1], 16) for i in ids if lib.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in ids if i not in self.control and i not in self.byte_of and i != self.unknown]
        if any(lib.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.id_of = {self.surface[i]: i for i in plain}
        #: Texts of ids; a byte is an escape until its neighbours are known.
        self.text_of = [p.replace(SPACE, " ") for p in self.surface]
        for i, b in self.byte_of.items():
            self.text_of[i] = bytes([b]).decode("ascii", "surrogateescape")
        for i in self.control:
            self.text_of[i] = CONTROL
        self.text_of[self.unknown] = lib.decode([self.unknown])
        #: What a union costs on the agenda: the negative of its score, the least first.
        self.cost = {self.surface[i]: -lib.get_score(i) for i in plain}
        inner = {p[k : k + 2] for p in self.cost for k in range(len(p) - 1)}
        self._cut = _cuts(inner)
        #: Numbers of symbols: ids of pieces, and beyond them the code points of other characters, then what stands past the ends of a word.
        self.others = lib.get_piece_size()
        self.end = self.others + sys.maxunicode + 1
        self._first = np.arange(self.others, self.end + 1, dtype=np.int64)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self._first[ord(piece)] = i
        self._first[ord(" ")] = self._first[ord(SPACE)]
        number = lambda s: int(self._first[ord(s)]) if len(s) == 1 else self.id_of.get(s, self.end)
        place = {c: n for n, c in enumerate(sorted(set(self.cost.values())))}
        halves = [(number(p[:k]), number(p[k:]), i, place[self.cost[p]]) for p, i in self.id_of.items() for k in range(1, len(p))]
        known = np.array([(a * (self.end + 1) + b, i, n) for a, b, i, n in halves if self.end not in (a, b)] + [(NEVER, 0, 0)], np.int64)
        #: Pairs of symbols in order, the piece that each makes, and its place among all scores, the best first.
        self._pairs, self._makes, self._places = known[np.argsort(known[:, 0])].T.copy()
        self._shared = np.array(range(self.others + 1), object)
        self._words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word by the score-ordered agenda."""
        out: list[int] = []
        for s in self._symbols(word):
            if s in self.id_of:
                out.append(self.id_of[s])
            elif s:
                out += [self.id_of_byte.get(b, self.unknown) for b in s.encode()] if self.id_of_byte else [self.unknown]
        return out

    def merge_all(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each word with its spaces as they are, as ``merge`` gives them; short words are merged side by side."""
        out: dict[str, tuple[int, ...]] = {}
        words = sorted(words, key=len)
        short = bisect.bisect_right(words, SHORT, key=len)
        for start in range(0, short, COLUMNS):
            self._columns(words[start : min(start + COLUMNS, short)], out)
        out.update((w, tuple(self.merge(w.replace(" ", SPACE)))) for w in words[short:])
        return out

    def _columns(self, words: list[str], out: dict[str, tuple[int, ...]]) -> None:
        """Merge words in order of length, a column each: in every round each takes the best pair of its own agenda."""
        n, width = len(words), len(words[-1])
        sym = np.full((width + 2, n), self.end, np.int64)
        points = np.array(words, f"<U{width}").view(np.uint32).reshape(n, width)
        inside = np.arange(width) < np.fromiter(map(len, words), np.int64, n)[:, None]
        sym[1:-1] = np.where(inside, self._first[points], self.end).T
        sym = sym.ravel()
        makes, agenda = np.zeros_like(sym), np.full(len(sym), NEVER)
        after, before = np.arange(len(sym)) + n, np.arange(len(sym)) - n
        rows = 1 << (width + 2).bit_length()

        def offer(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            key = left * (self.end + 1) + right
            k = np.searchsorted(self._pairs, key)
            makes[at] = self._makes[k]
            agenda[at] = np.where(self._pairs[k] == key, self._places[k] * rows + at // n, NEVER)  # the leftmost of equals

        offer(np.arange(n, len(sym) - n), sym[n:-n], sym[2 * n :])
        while True:
            best = agenda.reshape(-1, n).min(axis=0)
            live = np.flatnonzero(best < NEVER)
            if not len(live):
                break
            at = best[live] % rows * n + live
            gone = after[at]
            near, far = before[at], after[gone]
            sym[at] = both = makes[at]
            sym[gone], agenda[gone] = -1, NEVER
            after[at], before[far] = far, at
            offer(at, both, sym[far])
            offer(near, sym[near], both)
        sym = sym.reshape(-1, n)[1:-1].T
        left = (sym >= 0) & (sym < self.end)
        ids = self._shared[np.minimum(sym[left], self.others)].tolist()
        ends = left.sum(axis=1).cumsum().tolist()
        out.update((w, tuple(ids[a:z])) for w, a, z in zip(words, [0, *ends[:-1]], ends, strict=True))
        for k in np.flatnonzero(((sym >= self.others) & left).any(axis=1)).tolist():
            out[words[k]] = tuple(self.merge(words[k].replace(" ", SPACE)))  # characters that are no pieces become bytes

    def _symbols(self, word: str) -> list[str]:
        """Symbols of a word of any length, joined ones empty; its agenda is a heap."""
        symbols: list[str] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        cost = self.cost
        agenda = [(cost[both], at, at + 1, both) for at in range(n - 1) if (both := word[at : at + 2]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if after[left] != right or not symbols[left] or symbols[left] + symbols[right] != both:
                continue  # one side was joined elsewhere meanwhile
            symbols[left], symbols[right] = both, ""
            after[left] = far = after[right]
            if far >= 0:
                before[far] = left
                if (more := both + symbols[far]) in cost:
                    heapq.heappush(agenda, (cost[more], left, far, more))
            if (near := before[left]) >= 0 and (more := symbols[near] + both) in cost:
                heapq.heappush(agenda, (cost[more], near, left, more))
        return symbols

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, without begin or end ids; an empty text has none."""
        found = [self._cut.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        flat = list(chain.from_iterable(found))
        ids = list(map(self._words.get, flat))
        unknown = [k for k, x in enumerate(ids) if x is None]
        fresh = self.merge_all({flat[k] for k in unknown})
        for k in unknown:
            ids[k] = fresh[flat[k]]
        keep = (w for w in fresh if len(w) <= MAX_WORD_CHARS)
        self._words.update((w, fresh[w]) for w in islice(keep, max(0, MAX_WORDS - len(self._words))))
        ends = list(accumulate(map(len, found)))
        return [list(chain.from_iterable(ids[a:z])) for a, z in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: bytes join to characters, a byte that is no UTF-8 gives U+FFFD, the leading space goes."""
        ids = list(ids)
        text = "".join(map(self.text_of.__getitem__, ids))
        if CONTROL not in text:
            return self._shown(text, ids)
        runs: list[list[int]] = [[]]  # a control id is no text, and no character reaches across it
        for i in ids:
            runs.append([]) if i in self.control else runs[-1].append(i)
        told = [r for r in runs if r]
        return "".join(self._shown("".join(map(self.text_of.__getitem__, r)), r, k == 0) for k, r in enumerate(told))

    def _shown(self, text: str, ids: list[int], first: bool = True) -> str:
        if first and ids and self.surface[ids[0]].startswith(SPACE):
            text = text[1:]
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "piece-bytes")


def _cuts(inner: set[str]) -> re.Pattern[str]:
    """Matches the words of a text: spaces with the characters of one kind behind them. ``inner`` are the pairs of characters that stand in pieces.

    Characters that pieces join are of one kind, as far as pairs lead, and no pair is of two kinds; what no piece joins stands alone.
    """
    if any(b == SPACE != a for a, b in inner):
        return re.compile(r"(?s).+")  # a piece spans words: texts stay whole
    kind = {c: {c} for c in "".join(inner)}
    for a, b in inner:
        if a != SPACE and kind[a] is not kind[b]:
            kind[a] |= kind[b]
            kind.update(dict.fromkeys(kind[b], kind[a]))
    kind.pop(SPACE, None)
    kinds = sorted({id(k): k for k in kind.values()}.values(), key=lambda k: (-len(k), min(k)))
    kinds = [*kinds[:KINDS], set().union(*kinds[KINDS:])]
    told = ["".join(map(re.escape, sorted(k))) for k in kinds if k]
    return re.compile("".join(f" *[{k}]+|" for k in told) + f" +|[^ {''.join(told)}]")


def _model(proto: bytes) -> PieceModel:
    """The model of this worker process, which keeps its words from task to task."""
    kept = sys.modules.setdefault("_piece_model_of_worker", types.ModuleType("_piece_model_of_worker")).__dict__
    if kept.get("proto") != proto:
        kept.update(proto=proto, model=PieceModel(proto))
    return kept["model"]


def _slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``BATCH_CHARS`` characters."""
    start = size = 0
    for at, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield slice(start, at)
            start, size = at, 0
        size += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>, decoded, agrees), one per input row; ``model`` is the path of a vocabulary file that the driver can read.

    ``agrees`` says whether the library gives the same ids and the same text for them. A null or empty text has no ids and decodes to an
    empty text. Null and repeated ids give a row each, other columns are ignored, an empty input gives no rows. A text is encoded whole,
    however long; memory grows with the longest text and with ``BATCH_CHARS``, not with the rows.
    """
    with open(model, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _model(proto)
        gc.disable()  # millions of short-lived ids, none in a cycle
        try:
            yield from coded(vocabulary, batches)
        finally:
            gc.enable()

    def coded(vocabulary: PieceModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in _slices(texts):
                some = texts[part]
                found = vocabulary.encode_all(some)
                text = [vocabulary.decode(x) for x in found]
                theirs = vocabulary.library.encode(some, num_threads=1)
                same = [x == y and t == u for x, y, t, u in zip(found, theirs, text, vocabulary.library.decode(theirs, num_threads=1), strict=True)]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))))
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], ids, pa.array(text, pa.string()), pa.array(same)], ["doc_id", "ids", "decoded", "agrees"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string, agrees boolean")


def digest(encoded: DataFrame) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, agrees) of what ``encode_documents`` gives."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
