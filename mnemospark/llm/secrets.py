"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A version of a text is addressed by its SHA-256. The ledger is asked first, by hashes alone, which (blob, rule
version) pairs it does not hold yet; texts without such a pair meet no pattern at all. The others are
tested where they lie for literals without which no pending rule can match, rules run once for every
blob that passes, and findings join back to every row that holds the blob. Clean blobs enter the ledger too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, checkpointed

#: At most this many unseen blobs are broadcast; more are joined by a shuffle.
MAX_BROADCAST_BLOBS = 200_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; matches whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    trigger: str

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN = rf"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({_VALUE}+)"""
#: Base rules, in the order that breaks ties of equal starts.
BASE_RULES = (
    Rule("assign", 1, _ASSIGN, 1, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Rules that this method adds: token formats that vendors publish, and PEM private keys.
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?", 0, 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY"),
    Rule("vendor", 1, r"(?:gh[pousr]_|glpat-|xox[abpr]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20, r"(?:gh[pousr]_|glpat-|xox[abpr]-|sk_live_|AIza)[A-Za-z0-9_-]{16}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)
RULES = BASE_RULES + EXTRA_RULES
LEDGER_SCHEMA = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def read_ledger(spark: SparkSession, folder: str | None) -> DataFrame:
    """The ledger stored in a folder; an empty one where there is no folder yet."""
    if folder:
        try:
            return spark.read.schema(LEDGER_SCHEMA).parquet(folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return empty_ledger(spark)


def append_ledger(new: DataFrame, folder: str | None) -> None:
    """Add the rows of a scan to the ledger in a folder; without a folder they are not kept."""
    if folder:
        new.write.mode("append").parquet(folder)


def _triggered(text: Column, todo: Column | None, rules: tuple[Rule, ...]) -> Column:
    """Whether some rule of ``todo`` may match; without ``todo``, any rule."""
    hit = F.lit(False)
    for r in rules:
        literal = {"access": "AKIA", "pem": "-----BEGIN", "jwt": "eyJ"}.get(r.kind)
        here = F.contains(text, F.lit(literal)) & text.rlike(r.trigger) if literal else text.rlike(r.trigger)
        hit = hit | (here if todo is None else F.array_contains(todo, r.id) & here)
    return hit


def _scan(pending: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (blob, rule, start, end) of the pending rules' matches in code points, from (blob, text, todo).

    Splitting at the matches gives the gaps between them; running sums of gaps and matches give
    positions, by a window over one blob and rule.
    """
    runs = [
        F.when(
            F.array_contains("todo", r.id),
            F.struct(
                F.lit(r.id).alias("rule"),
                F.lit(r.least).alias("least"),
                F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length).alias("sizes"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length).alias("parts"),
            ),
        )
        for r in rules
    ]
    one = pending.select("blob", F.explode(F.array_compact(F.array(*runs))).alias("run"))
    each = one.select("blob", "run.rule", "run.least", F.posexplode(F.arrays_zip("run.gaps", "run.sizes", "run.parts")).alias("at", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("at")
    placed = each.select("blob", "rule", "least", "m.sizes", "m.parts", F.sum(F.col("m.gaps") + F.coalesce("m.sizes", F.lit(0))).over(upto).alias("end"))
    return placed.where("sizes is not null and parts >= least").select("blob", "rule", (F.col("end") - F.col("sizes")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _every(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.id) for r in rules])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen_versions(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (blob, todo): the rule versions that ``ledger`` does not hold for the blobs of ``blobs (blob)``; hashes are all it reads."""
    here = blobs.select("blob").distinct()
    held = ledger.where(F.col("rule").isin([r.id for r in rules])).join(here, "blob", "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(_every(rules), F.coalesce("seen", F.array().cast("array<string>")))
    return here.join(held, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def _with_todo(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """``rows (blob, text, ...)`` whose blobs have something to scan, with ``todo``, and the unseen (blob, todo).

    An empty ledger knows nothing, so that every row is asked where it lies; otherwise the unseen blobs
    are found by their hashes, and texts are shuffled only if those are too many to broadcast.
    """
    if ledger.isEmpty():
        return rows.withColumn("todo", _every(rules)), rows.select("blob").distinct().withColumn("todo", _every(rules))
    unseen = checkpointed(unseen_versions(rows.select("blob"), ledger, rules))
    if unseen.isEmpty():
        return rows.sparkSession.createDataFrame([], rows.withColumn("todo", _every(rules)).schema), unseen
    return rows.join(broadcast_if_small(unseen, MAX_BROADCAST_BLOBS), "blob"), unseen


def _hits(hot: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (blob, rule, spans) of the matches in ``hot (blob, text, todo)``; a blob that repeats is scanned once."""
    found = _scan(hot.select("blob", "text", "todo").dropDuplicates(["blob"]), rules)
    return found.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _new_rows(unseen: DataFrame, hits: DataFrame) -> DataFrame:
    """Ledger rows of every pair that was unseen; those without a match have no spans."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return unseen.select("blob", F.explode("todo").alias("rule")).join(hits, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", none).alias("spans"))


def _by_blob(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (blob, found): all spans of the current rule versions, by start, then by the order of the rules; pairs held twice count once."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.id), F.lit(i))])
    rows = ledger.where(F.col("rule").isin([r.id for r in rules]) & (F.size("spans") > 0)).select("blob", "rule", F.explode("spans").alias("s"))
    item = F.struct(F.col("s.start").alias("start"), order[F.col("rule")].alias("place"), F.split("rule", "@")[0].alias("kind"), F.col("s.end").alias("end"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_set(item)).alias("found"))


def _held(ledger: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rows of the ledger with spans in blobs of this batch."""
    return ledger.where(F.size("spans") > 0).select("blob", "rule", "spans").join(blobs.select("blob").distinct(), "blob", "left_semi")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings ``(doc_id, blob, found)`` for every row, and the ledger rows that this scan adds.

    ``found`` is an array of (start, place, kind, end), empty where nothing is found. Append the
    second frame to the stored ledger. A null text counts as empty; null or repeated ids stay
    rows of their own; other columns, whatever their names, are ignored; empty tables give empty results.
    """
    fresh = ledger is None or ledger.isEmpty()
    ledger = empty_ledger(docs.sparkSession) if ledger is None else ledger
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", blob_of(F.col("text")).alias("blob"), text.alias("text"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    if fresh:  # hashes and candidate texts in one pass
        tested = checkpointed(rows.select("doc_id", "blob", F.when(_triggered(F.col("text"), None, rules), F.col("text")).alias("text")))
        hot = tested.where("text is not null").withColumn("todo", _every(rules))
        unseen = tested.select("blob").distinct().withColumn("todo", _every(rules))
        maybe, clean = hot, tested.where("text is null")
    else:
        todo, unseen = _with_todo(rows, ledger, rules)
        hot = checkpointed(todo.where(_triggered(F.col("text"), F.col("todo"), rules)).select("blob", "text", "todo"))
        maybe, clean = checkpointed(rows.select("doc_id", "blob")), None
    hits = checkpointed(_hits(hot, rules))
    found = _by_blob(hits if fresh else hits.unionByName(_held(ledger, maybe)), rules)
    out = maybe.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))
    out = out if clean is None else out.unionByName(clean.select("doc_id", "blob", none.alias("found")))
    return out, _new_rows(unseen, hits)


def digest(findings: DataFrame) -> DataFrame:
    """Counts of base spans, the hash of their list, and the list of all spans, per row of ``findings``."""
    base = F.filter("found", lambda x: x.place < len(BASE_RULES))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long")
    return findings.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed("found").alias("spans")
    )


def redact_with_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> tuple[DataFrame, DataFrame]:
    """``docs`` with every found span replaced by ``mark`` and ``n_chars`` counted again, and the ledger rows that this adds; no row goes.

    Spans that touch or overlap become one mark. Only rows that may hold a secret are shuffled, unless the ledger knows more blobs
    with secrets than can be broadcast. Null and empty texts, null and repeated ids stay as they are; all columns stay, whatever their names.
    """
    ledger = empty_ledger(docs.sparkSession) if ledger is None else ledger
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger.isEmpty():
        hot = _triggered(F.col("text"), None, rules)
        maybe = checkpointed(rows.where(hot))
        rest = rows.where(~hot)
        unseen = rows.select("blob").distinct().withColumn("todo", _every(rules))
        hits = checkpointed(_hits(maybe.withColumn("todo", _every(rules)), rules))
        known = hits
    else:
        todo, unseen = _with_todo(rows.select("blob", "text"), ledger, rules)
        hits = checkpointed(_hits(todo.where(_triggered(F.col("text"), F.col("todo"), rules)), rules))
        known = checkpointed(hits.unionByName(_held(ledger.where(F.col("rule").isin([r.id for r in rules])), rows)))
        bad = broadcast_if_small(known.select("blob").distinct(), MAX_BROADCAST_BLOBS)
        maybe, rest = rows.join(bad, "blob", "left_semi"), rows.join(bad, "blob", "left_anti")
    found = _by_blob(known, rules).select("blob", F.explode("found").alias("s")).select("blob", "s.start", "s.end")
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = found.withColumn("reach", reach).withColumn("g", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = step.groupBy("blob", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = joined.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    after = lambda c, i: F.coalesce(F.get("cuts", i + 1).getField("start"), F.length("text").cast("long"))
    tail = F.transform("cuts", lambda c, i: F.concat(F.lit(mark), F.substring(F.col("text"), (c.end + 1).cast("int"), (after(c, i) - c.end).cast("int"))))
    text = F.concat(F.substring(F.col("text"), F.lit(1), F.col("cuts")[0].start.cast("int")), F.array_join(tail, ""))
    changed = F.col("cuts").isNotNull()
    out = maybe.join(cuts, "blob", "left").select("row", "cuts", F.when(changed, text).alias("new"))
    cols = [
        F.when(changed, F.col("new")).otherwise(F.col("row.text")).alias(c) if c == "text"
        else F.when(changed, F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return out.select(*cols).unionByName(rest.select("row.*")), _new_rows(unseen, hits)


def redact_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The first frame of ``redact_with_ledger``."""
    return redact_with_ledger(docs, ledger, rules, mark)[0]


def _oracle_kind(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, t, '{kind}' AS kind, {place} AS place, {least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM texts"""


def oracle_sql() -> str:
    """DuckDB: every rule on every text; positions from the gaps between matches."""
    each = "\nUNION ALL\n".join(_oracle_kind(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(RULES))
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
runs AS ({each.replace("SELECT doc_id, t,", "SELECT row_id, doc_id,")}),
numbered AS (SELECT row_id, kind, place, least, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM runs WHERE len(m) > 0),
spans AS (SELECT row_id, kind, place, length(v[i]) AS n, least,
                 list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS size FROM numbered),
good AS (SELECT row_id, kind, place, CAST(s AS BIGINT) AS s, CAST(s + size AS BIGINT) AS e FROM spans WHERE n >= least),
digests AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {len(BASE_RULES)}) AS base,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM good GROUP BY row_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN digests USING (row_id)
"""
