"""Audit of how the word use of sources differs within a language, in exact integers.

Documents are counted in Arrow batches, once per distinct word. The peers of a group are compared by
Gustavson's row accumulation: in a bounded shard of terms, a group scatters its terms through the
term-major index of all postings into one dense accumulator over its peers. No pair of postings leaves the task, only
one row per group and peer. The accumulator starts from what the group's terms give where the peer has none, and a
posting corrects that; terms that neither has are added as their number times one value.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import checkpointed

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Distinct (group, term) counts that a task holds before it hands them on; they are added up later.
MOST_HELD = 300_000
#: Bytes of a text that are cut into terms together; longer ones are cut at the next byte that ends a term.
PIECE = 4 << 20
#: Postings of a shard of terms, about, and groups that one task compares with all peers.
SHARD = 500_000
BLOCK = 256

#: ASCII letters in lower case and all bytes beyond ASCII stay, the rest parts terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_END = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _terms(text: bytes) -> Counter[bytes]:
    """Occurrences of each term of a text of any length."""
    found: Counter[bytes] = Counter()
    start = 0
    while start < len(text):
        stop = start + PIECE
        if stop < len(text):
            end = _END.search(text, stop)
            stop = end.start() if end else len(text)
        found.update(text[start:stop].translate(_TABLE).split())
        start = stop
    return found


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences of a term in a group and how many documents of it have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
        size = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = held[lang, source]
                size -= len(own)
                for term, n in _terms(text).items():
                    if (known := own.get(term)) is None:
                        own[term] = [n, 1]
                    else:
                        known[0] += n
                        known[1] += 1
                size += len(own)
                if size >= MOST_HELD:
                    yield from flat(held)
                    held.clear()
                    size = 0
        yield from flat(held)

    def flat(held: dict[tuple[str, str], dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            k = len(own)
            n = np.array(list(own.values()), np.int64).reshape(k, 2)
            cols = [pa.array([lang], pa.string()).take(pa.array(np.zeros(k, np.int32))), pa.array([source], pa.string()).take(pa.array(np.zeros(k, np.int32))), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])

    rows = docs.select(_filled(lang_col).alias("lang"), _filled(source_col).alias("source"), _filled(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 v)), exact for any counts; null where v is 0."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(v > 0, F.call_function("div", wide, (total + 2 * v).cast("decimal(20,0)")) + 1).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, which a long holds."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _accumulated(rows: pa.Table, index: pa.Table) -> pa.Table:
    """For every group of ``rows`` and every peer: what their terms of one shard add to the distance, less what terms give that neither has.

    ``rows`` are (source, term, p, p0) of the groups of a block, ``index`` the same of all groups; a row without a term names a group.
    Gives (source, peer, own, both, base): of the group's terms against the peer's zero share, the corrections where the peer has the term too, and
    the distance of both zero shares.
    """
    peers = index.filter(pc.is_null(index["term"]))
    names = peers["source"].combine_chunks()
    zero = peers["p0"].to_numpy().astype(np.int64)
    post = index.filter(pc.is_valid(index["term"]))
    mine = rows.filter(pc.is_valid(rows["term"]))
    ids = pa.chunked_array([*post["term"].chunks, *mine["term"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code = ids.indices.to_numpy(zero_copy_only=False)
    by_term = np.argsort(code[: len(post)], kind="stable")
    starts = np.searchsorted(code[: len(post)][by_term], np.arange(len(ids.dictionary) + 1))
    peer = pc.index_in(post["source"], names).to_numpy()[by_term].astype(np.int64)
    p_peer = post["p"].to_numpy()[by_term]
    p_mine, code_mine = mine["p"].to_numpy(), code[len(post) :]
    heads = rows.filter(pc.is_null(rows["term"]))
    sources = heads["source"].to_pylist()
    order = np.argsort(group := pc.index_in(mine["source"], heads["source"].combine_chunks()).to_numpy(), kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(sources) + 1))
    out: dict[str, list] = defaultdict(list)
    for g, zero_g in enumerate(heads["p0"].to_numpy().astype(np.int64)):
        at = order[edges[g] : edges[g + 1]]
        p, t = p_mine[at], code_mine[at]
        base = _f(zero_g, zero)
        own = -len(p) * base
        values, times = np.unique(p, return_counts=True)
        for a in range(0, len(values), 1024):  # terms of equal share add the same, so each distinct share is met once
            own += (_f(values[a : a + 1024, None], zero[None, :]) * times[a : a + 1024, None]).sum(axis=0)
        both = np.zeros(len(zero), np.int64)
        lens = starts[t + 1] - starts[t]
        for part in _bounded(lens):
            n = lens[part]
            where = np.repeat(starts[t[part]] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
            x, h, q = np.repeat(p[part], n), peer[where], p_peer[where]
            np.add.at(both, h, _f(x, q) - _f(x, zero[h]) - _f(zero_g, q) + base[h])
        out["source"] += [sources[g]] * len(zero)
        out["peer"].append(names)
        for name, v in (("own", own), ("both", both), ("base", base)):
            out[name].append(v)
    flat = lambda n: np.concatenate(out[n]) if out[n] else np.empty(0, np.int64)
    return pa.table({"source": pa.array(out["source"], pa.string()), "peer": pa.chunked_array(out["peer"], pa.string()).combine_chunks(), **{n: flat(n) for n in ("own", "both", "base")}})


def _bounded(lens: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Runs of terms with about ``most`` postings in all."""
    mark = lens.cumsum() // most
    edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(lens)]
    yield from (slice(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a)


def _pairs(kept: DataFrame, groups: DataFrame, postings: int) -> DataFrame:
    """Rows (lang, source, peer, value) of every group and every other source of its language."""
    shards = max(groups.sparkSession.sparkContext.defaultParallelism, -(-postings // SHARD))
    blocks = max(1, -(-groups.count() // BLOCK))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    terms = kept.select("lang", "source", "term", "p", F.lit(None).cast("long").alias("p0"), shard)
    heads = groups.where("v > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "p0", each(shards).alias("shard"))
    rows = terms.unionByName(heads)
    keys = ["lang", "shard", "block"]

    def work(key: tuple, index: pa.Table) -> pa.Table:
        found = _accumulated(index.filter(index["mine"]), index)
        return found.add_column(0, "lang", pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(found), np.int32))))

    met = rows.withColumn("block", each(blocks)).withColumn("mine", F.col("block") == block).groupBy(*keys)
    part = met.applyInArrow(work, "lang string, source string, peer string, own long, both long, base long")
    whole = checkpointed(part.groupBy("lang", "source", "peer").agg(F.sum("own").alias("own"), F.sum("both").alias("both"), F.max("base").alias("base")))
    ahead = whole.select("lang", "source", "peer", (F.col("own") + F.col("both")).alias("value"), "base")
    back = whole.select("lang", F.col("peer").alias("source"), F.col("source").alias("peer"), F.col("own").alias("value"), "base")
    summed = ahead.unionByName(back).where("source <> peer").groupBy("lang", "source", "peer").agg(F.sum("value").alias("value"), F.max("base").alias("base"))
    sizes = groups.groupBy("lang").agg(F.max("v").alias("v"))
    some = summed.join(sizes, "lang").select("lang", "source", "peer", (F.col("value") + F.col("v") * F.col("base")).alias("value"))
    bare = groups.where("v = 0").select("lang", "source")  # without any kept term all distances are 0
    none = bare.join(bare.withColumnRenamed("source", "peer"), "lang").where("source <> peer").withColumn("value", F.lit(0).cast("long"))
    return some.unionByName(none)


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair``: the distance to each other source of the language, all ranks. Part ``term``: the first ``top`` kept terms that occur
    in the group and have a larger share there than in the language. Terms are runs of letters A to Z and characters beyond ASCII, with A-Z
    lower-cased; a language keeps those in at least ``min_docs`` of its documents. Null languages, sources and texts are empty ones; a group without
    terms has the zero share for each kept term; a language that keeps none gives pairs of value 0. Ties go to the item that is first in UTF-8. Rows that repeat
    count each; other columns are ignored; an empty input gives no rows.
    """
    anywhere = Window.partitionBy("lang", "term")
    counts = term_counts(docs, lang_col, source_col, text_col)
    spread = counts.select("lang", "source", "term", "n", F.sum("n").over(anywhere).alias("lang_n"), F.sum("docs").over(anywhere).alias("lang_docs"), F.min("source").over(anywhere).alias("first"))
    inside = checkpointed(spread.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).cast("long").alias("one")))
    totals = checkpointed(inside.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"), F.sum("one").alias("ones")))
    langs = totals.groupBy("lang").agg(F.sum("ones").alias("v"), F.sum("total").alias("lang_total"))  # each kept term is one in one group
    named = docs.select(_filled(lang_col).alias("lang"), _filled(source_col).alias("source")).distinct()
    filled = named.join(totals.drop("ones"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "v", "lang_total"])
    groups = checkpointed(filled.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    sized = inside.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    kept = checkpointed(sized.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")))
    postings = groups.agg(F.sum("terms")).head()[0] or 0
    pairs = _pairs(kept.select("lang", "source", "term", "p"), groups, postings).select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), "value")
    terms = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = pairs.select("*", place).unionByName(terms.select("*", place).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


#: DuckDB: all groups against all terms of their language.
ORACLE = r"""
WITH base AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM base),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM tok GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
size AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(lang_n) AS HUGEINT) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM base),
cnt AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM tok t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
tot AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM grp g LEFT JOIN cnt c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
full_p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 2) // (t.total + 2 * s.v) AS p, 1 + 1000000000 * (k.lang_n + 2) // (s.total + 2 * s.v) AS q
  FROM tot t JOIN size s ON t.lang = s.lang JOIN kept k ON k.lang = t.lang
  LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN dist d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM full_p WHERE n > 0 AND p > q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR rank <= 10
"""
