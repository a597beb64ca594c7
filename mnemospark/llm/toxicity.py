"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nystrom landmarks.

The kernel compares words by the subsequences of three characters that they share, each weighted
by a decay for every character it spans, so that inserted, doubled or gapped characters cost
little. Landmarks are points of the kernel's feature space: the means of clusters of words, one for each root. A text is
described by its words' kernel values with every landmark, as the largest and as a sum; the
landmarks' own kernel matrix whitens that description (Nystrom), and a linear hinge-loss model on
it, fitted by dual coordinate descent, gives the margin that a logistic curve turns into a score.

Labels mark whole documents, so the words that make a labelled sentence toxic are found first: those
that occur in toxic documents far more often than by chance. Copies would make any
rare word look so, and therefore texts that share their smallest or largest shingle hash count as
one. A word counts towards a landmark as far as it comes nearer than the words of clean texts do, so
that garbled insults count where no other word looks like them. Texts with words that no clean text has are
also learned with just one of them; texts of few words or none that are near no landmark are learned as clean, so that
being short is no sign of anything. The curve is fitted on margins of texts that the model behind them has not seen, and moved from the share of toxic texts in the sample to their share among all labels and by the cost of a miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.labelled import held_out, spread, training_rows
from mnemospark.llm.linear import dual_coordinate_descent, platt
from mnemospark.session import checkpointed

#: Bounds of the fit: documents of each class, telling words, and landmarks.
PER_CLASS = 4000
TELLING = 512
LANDMARKS = 64
#: A telling word occurs in toxic documents more often than by chance, by this many standard deviations.
LEAST_DEVIATION = 5.0
#: Words nearer than this to the first of a cluster join it.
JOIN = 0.5
#: A word counts towards a landmark from where no other word of the clean texts comes, but from within these bounds, and as one from ``RISE`` beyond.
NEAR, MOST_NEAR, RISE = 0.4, 0.6, 0.15
#: A cluster is plain if at most this share of the texts with its words is clean; then one such word is enough.
PLAIN = 0.02
#: Hinge-loss cost of any text, the ridge under the whitening, and the folds that the curve is fitted on.
COST, RIDGE, FOLDS = 10.0, 1.0, 3
#: Texts of fewer words than this that are near no landmark are learned as clean, in all this share of the texts.
FEW, FEW_SHARE = 12, 0.2
#: A missed toxic text is as bad as this many dropped clean ones; the scores' odds count it.
MISS_COST = 3.0

DECAY = 0.6
SPAN = 5
WIDTH = 16
_CODES = 64
_CACHE = 150_000
_CHUNK = 1_000_000
_PARTS = re.compile(r"[^\W_]+")
_ENDS = ".,;:!?\"'()[]*#$%&|"


def sentence_windows(text: str, whole: frozenset[str] = frozenset(), heads: frozenset[str] = frozenset()) -> set[str]:
    """Distinct raw words of a text, runs of three or more one-character words as one, and neighbours that make one of ``whole``.

    ``heads`` are the beginnings of the words in ``whole``; only a word among them is joined with the next.
    """
    words = text.lower().split()
    found = set(words)
    if len(words) > 2:
        single = np.fromiter(map(len, words), np.int32, len(words)) == 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a > 2:
                found.add("".join(words[a:b]))
    if not heads.isdisjoint(found):
        for k in [k for k, w in enumerate(words[:-1]) if w in heads]:
            joined = words[k] + words[k + 1].strip(_ENDS)
            if joined in whole:
                found.add(joined)
    return found


def forms(word: str) -> list[str]:
    """What the kernel sees of a raw word: a start mark and its letters and digits joined; if separated, each part too.

    Long forms are cut into overlapping windows, so that nothing is left out.
    """
    parts = _PARTS.findall(word)
    if not parts:
        return []
    whole = "".join(parts)
    out = []
    for f in ["^" + whole, *parts] if len(parts) > 1 else ["^" + whole]:
        out += [f] if len(f) <= WIDTH else [f[a : a + WIDTH] for a in range(0, len(f) - WIDTH // 2, WIDTH // 2)]
    return out


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code matrix, one row a word, and a mask of its characters."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    code = np.where((flat >= 97) & (flat <= 122), flat - 96, np.where(flat == 94, 27, 28 + flat % (_CODES - 28)))
    mask = np.arange(WIDTH)[None, :] < n[:, None]
    m = np.zeros((len(words), WIDTH), np.int64)
    m[mask] = code
    return m, mask


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and decayed weights of the three-character subsequences within ``SPAN``, one row a word; absent ones weigh 0."""
    m, mask = _encode(words)
    ids, weights = [], []
    for last in range(2, SPAN):
        for mid in range(1, last):
            k = WIDTH - last
            ids.append(m[:, :k] * _CODES * _CODES + m[:, mid : mid + k] * _CODES + m[:, last:])
            weights.append(mask[:, last:] * DECAY ** (last - 2))
    return np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)


def _norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Length of each word's feature vector; equal subsequences of a word add up first."""
    order = np.argsort(ids, axis=1, kind="stable")
    i, w = np.take_along_axis(ids, order, 1), np.take_along_axis(weights, order, 1)
    new = np.ones(i.shape, bool)
    new[:, 1:] = i[:, 1:] != i[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    total = np.bincount(group, w.ravel())
    row = np.repeat(np.arange(len(i)), i.shape[1])[new.ravel()]
    return np.sqrt(np.bincount(row, total * total, minlength=len(i)))


class Landmarks:
    """Points of the feature space, the means of clusters of words; only the subsequences they hold are looked up in other words."""

    def __init__(self, words: list[str], clusters: list[int] | None = None):
        """``clusters`` numbers the words' clusters from 0; without it every word is a landmark."""
        clusters = list(range(len(words))) if clusters is None else clusters
        ids, w = subsequences(words)
        self.words, self.clusters = words, clusters
        self.size = max(clusters, default=-1) + 1
        used, back = np.unique(ids[w > 0], return_inverse=True)
        self.row = np.zeros(_CODES**3, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        each = np.zeros((len(used) + 1, len(words)))
        owner = np.nonzero(w > 0)[0]
        np.add.at(each, (back + 1, owner), w[w > 0])
        each /= np.linalg.norm(each, axis=0, keepdims=True) + 1e-9
        mean = each @ (np.array(clusters)[:, None] == np.arange(self.size)[None, :])
        mean /= np.linalg.norm(mean, axis=0, keepdims=True) + 1e-9
        self.gram, self.table = mean.T @ mean, mean.astype(np.float32)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of words with all landmarks, one row a word."""
        out = np.zeros((len(words), self.size), np.float32)
        for at in range(0, len(words), 1000):
            ids, w = subsequences(words[at : at + 1000])
            rows = self.row[ids]
            hit = np.flatnonzero((rows > 0).any(axis=1))  # most words share nothing with any landmark
            if len(hit):
                value = np.einsum("nk,nkl->nl", w[hit].astype(np.float32), self.table[rows[hit]])
                out[at + hit] = value / (_norms(ids[hit], w[hit])[:, None] + 1e-9)
        return out


@dataclass
class ToxicityModel:
    """Landmarks, two weights for each and two more, the bias, and the logistic curve from margins to scores.

    ``whole`` holds plain words, which are also looked for cut in two; ``reach`` says from where a word counts, for each landmark.
    """

    landmarks: Landmarks | None
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    whole: frozenset[str] = frozenset()
    reach: np.ndarray | None = None
    heads: frozenset[str] = field(default=frozenset(), repr=False)
    cache: dict[str, tuple | None] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.reach is None and self.landmarks is not None:
            self.reach = np.full(self.landmarks.size, NEAR)
        self.heads = frozenset(w[:k] for w in self.whole for k in range(2, len(w) - 1))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _learn(self, words: list[str]) -> None:
        """Keep for each raw word which landmarks it comes near, and how near; mostly none."""
        split = [forms(w) for w in words]
        flat = [f for fs in split for f in fs]
        owner = np.repeat(np.arange(len(words)), [len(fs) for fs in split])
        self.cache.update(dict.fromkeys(words))
        if not flat or self.landmarks is None:
            return
        k = self.landmarks.kernel(flat)
        near = np.clip((k - self.reach) / RISE, 0, 1)
        for r in np.flatnonzero((near > 0).any(axis=1)):
            at = np.flatnonzero(near[r])
            word = words[owner[r]]
            self.cache[word] = (*(self.cache[word] or ()), (at, near[r][at]))

    def pooled(self, sets: list[set[str]]) -> np.ndarray:
        """Per set of words how far its nearest word counts towards each landmark, 0 to 1, and how many words do, on a log scale;
        then how many words count towards any, and how many there are."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
        known = self.cache
        self._learn(list(set().union(*sets).difference(known)) if sets else [])
        out = np.zeros((len(sets), len(self.weight)))
        n = (len(self.weight) - 2) // 2
        for row, s in zip(out, sets, strict=True):
            for found in (known[w] for w in s if known[w]):
                most = 0.0
                for at, near in found:
                    row[at] = np.maximum(row[at], near)
                    row[at + n] += near
                    most = max(most, near.max())
                row[-2] += most
            row[n:-1] = np.log1p(row[n:-1])
            row[-1] = np.log1p(len(s)) / 8
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """``pooled`` of whole texts; empty and null ones are near nothing. Works through about a million characters at a time."""
        out, at = np.zeros((len(texts), len(self.weight))), 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < _CHUNK):
                size += len(texts[end] or "")
                end += 1
            out[at:end] = self.pooled([sentence_windows(t, self.whole, self.heads) if t else set() for t in texts[at:end]])
            at = end
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _never(offset: float = -3.0) -> ToxicityModel:
    return ToxicityModel(None, np.zeros(2), 0.0, 1.0, offset)


def cluster_words(words: list[str], most: int = LANDMARKS) -> list[int]:
    """The cluster of every word, numbered from 0: that of the first word before it that is near enough, or a new one; -1 beyond ``most`` clusters."""
    k = Landmarks(words).kernel(words)
    leaders: list[int] = []
    out = []
    for i in range(len(words)):
        near = max(((float(k[i, j]), -n) for n, j in enumerate(leaders)), default=(0.0, 0))
        if near[0] >= JOIN:
            out.append(-near[1])
        elif len(leaders) < most:
            out.append(len(leaders))
            leaders.append(i)
        else:
            out.append(-1)
    return out


def _margins(z: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    width = z.shape[1]
    return dual_coordinate_descent(np.arange(0, z.size + 1, width), np.tile(np.arange(width), len(z)), z.ravel(), y, width, np.full(len(y), COST), epochs=50, seed=seed)


def fit_documents(landmarks: Landmarks, x: np.ndarray, y: np.ndarray, fold: np.ndarray, real: np.ndarray, share: float, seed: int = 7) -> ToxicityModel:
    """Hinge-loss model on whitened descriptions.

    The curve is fitted on the ``real`` rows, each judged by a model of the other folds; ``share`` is the share of toxic texts among all.
    """
    n = landmarks.size
    value, vector = np.linalg.eigh((landmarks.gram + landmarks.gram.T) / 2)
    white = vector / np.sqrt(np.maximum(value, 0) + RIDGE)
    root = np.eye(2 * n + 2)
    root[:n, :n] = root[n:-2, n:-2] = white
    z = np.hstack([x @ root, np.ones((len(x), 1))])
    u = _margins(z, y, seed)
    model = ToxicityModel(landmarks, root @ u[:-1], float(u[-1]))
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        rest, here = fold != k, fold == k
        if here.any():
            both = len(set(y[rest].tolist())) > 1
            margin[here] = z[here] @ (_margins(z[rest], y[rest], seed) if both else u)
    model.slope, model.offset = platt(margin[real], y[real])
    model.slope = max(model.slope, 1e-3)
    seen = float((y[real] > 0).mean())
    if 0 < share < 1 and 0 < seen < 1:
        model.offset += float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    model.offset += float(np.log(MISS_COST))
    return model


def _extreme_shingles(text: str | None) -> tuple[int, int]:
    """Smallest and largest hash of a text's runs of three words: what copies of a text mostly share."""
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))]
    return min(h), max(h)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class that are not held out; texts that repeat count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = sorted(w for w in sentence_windows(t or "") if _PARTS.search(w))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(words), pa.int64()), pa.array([y] * len(words), pa.int32()), pa.array(words, pa.string())], ["doc", "y", "word"])

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([_extreme_shingles(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["y", "text", "low", "high"])

    rows = training_rows(docs, labels, label, per_class).select("y", "text").mapInArrow(with_keys, "y int, text string, low long, high long")
    rows = rows.groupBy("y", "low").agg(F.min(F.struct("text", "high")).alias("m")).groupBy("y", "m.high").agg(F.min("m.text").alias("text"))
    rows = rows.select(F.xxhash64("text").alias("doc"), "y", "text")
    rows = checkpointed(spread(rows, "doc"))
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return _never(3.0 if n.get(1) else -3.0)
    pairs = rows.mapInArrow(run, "doc long, y int, word string")
    stats = pairs.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    chance = (F.col("pos") + F.col("neg")) * (n[1] / (n[1] + n[0]))
    beyond = (F.col("pos") - chance) / F.sqrt(chance)
    found = stats.where(beyond >= LEAST_DEVIATION).orderBy(F.desc(beyond), "word").limit(TELLING).collect()
    shapes = {r.word: next((f for f in forms(r.word)[:1] if len(f) > 3), None) for r in found}
    found = [r for r in found if shapes[r.word]]
    if not found:
        return _never()
    cluster = cluster_words([shapes[r.word] for r in found])
    used = [k for k, c in enumerate(cluster) if c >= 0]
    marks = Landmarks([shapes[found[k].word] for k in used], [cluster[k] for k in used])
    total = np.zeros((marks.size, 2))
    for k in used:
        total[cluster[k]] += found[k].pos, found[k].neg
    plain = {c for c in range(marks.size) if total[c, 1] <= PLAIN * total[c].sum()}
    pure = frozenset(found[k].word for k in used if cluster[k] in plain)
    known = frozenset(r.word for r in found)

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, done = np.zeros(marks.size), set()
        for b in batches:
            for t in b.column(0).to_pylist():
                new = [f for w in sentence_windows(t or "") - known - done for f in forms(w)]
                done = set() if len(done) > _CACHE else done
                done |= sentence_windows(t or "")
                most = np.maximum(most, marks.kernel(new).max(axis=0, initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array(range(marks.size), pa.int32()), pa.array(most, pa.float64())], ["at", "most"])

    clean = rows.where("y = 0").select("text").mapInArrow(reaches, "at int, most double").groupBy("at").agg(F.max("most").alias("most")).collect()
    reach = np.full(marks.size, NEAR)
    for r in clean:
        reach[r["at"]] = min(MOST_NEAR, max(NEAR, r["most"]))
    blank = ToxicityModel(marks, np.zeros(2 * marks.size + 2), 0.0, whole=pure, reach=reach)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, y, real, out = [], [], [], []
            for i, label, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = sentence_windows(t or "", pure, blank.heads)
                sets = [words]
                if label and words & pure:  # the text with no telling word but one of these
                    held = sorted(words & pure)
                    sets.append(words - known | {held[len(t) % len(held)]})
                doc += [i] * len(sets)
                y += [label] * len(sets)
                real += [k == 0 for k in range(len(sets))]
                out += [r.astype(np.float32).tobytes() for r in blank.pooled(sets)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(y, pa.int32()), pa.array(real, pa.bool_()), pa.array(out, pa.binary())], ["doc", "y", "real", "x"])

    seen = rows.select("doc", "y", "text").mapInArrow(describe, "doc long, y int, real boolean, x binary").toArrow()
    seen = seen.sort_by([("y", "ascending"), ("doc", "ascending"), ("real", "descending")])  # rows arrive in any order
    x = np.frombuffer(b"".join(seen.column("x").to_pylist()), np.float32).reshape(-1, 2 * marks.size + 2).astype(float)
    every = {r.y: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    share = every.get(1, 0) / max(1, sum(every.values()))
    few = np.zeros((max(1, round(FEW_SHARE * len(x) / FEW)) * FEW, x.shape[1]))
    few[:, -1] = np.log1p(np.arange(len(few)) % FEW) / 8
    y = np.concatenate([np.where(seen.column("y").to_numpy() == 1, 1.0, -1.0), np.full(len(few), -1.0)])
    fold = np.concatenate([seen.column("doc").to_numpy() % FOLDS, np.full(len(few), -1)])  # in every fold's model
    real = np.concatenate([seen.column("real").to_numpy(zero_copy_only=False), np.zeros(len(few), bool)])
    x = np.vstack([x, few])
    model = fit_documents(marks, x, y, fold, real, share)
    model.reach, model.whole = reach, pure
    model.__post_init__()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows (doc_id, held_out, score), one per input row, from the whole text and nothing else.

    Null texts score like empty ones; null and repeated ids stay rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(model.scores(model.features(b.column(2).to_pylist())), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), score], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, at_least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``at_least`` or more; all columns, whatever their names, and all other rows stay.

    Null texts score like empty ones; rows with null or repeated ids are judged each by its text; an empty input stays empty.
    """
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots cannot be handed to Arrow functions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = model.scores(model.features(b.column(at).to_pylist())) < at_least
            yield b.filter(pa.array(keep))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
