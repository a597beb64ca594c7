"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule's canonical key is its reversed host and its path, so that a prefix is an interval of keys.
Rules and urls are sorted together; the last rule start at or before a url carries the stack of
rules that are open there (its own nested parents and itself), and the url's rule is the top of
that stack once the intervals that ended before the url are popped. A url is looked up under each
of its host's suffixes, which makes the rule of a host cover all subdomains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import checkpointed

ROWS_PER_SWEEP = 50_000
_SEP = "\x01"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(_SEP), path)


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Rows (zone, key, stack): per rule key its open rules, outermost first, found by equality on prefixes.

    A stack is at most as long as the rule's path.
    """
    labels = F.split("host", r"\.")
    base = rules.where("host is not null and host <> '' and path is not null").select(
        F.element_at(labels, -1).alias("zone"), _key(labels, F.col("path")).alias("key"), F.struct(F.concat("host", "path").alias("rule"), "action").alias("what")
    )
    base = base.groupBy("zone", "key").agg(F.min("what").alias("what"))
    head = F.instr("key", _SEP)
    prefixes = F.transform(F.sequence(head, F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    open_at = base.select("zone", F.col("key").alias("at"), F.explode(prefixes).alias("key"))
    held = open_at.join(base, ["zone", "key"]).groupBy("zone", "at").agg(F.sort_array(F.collect_list(F.struct(F.length("key").alias("n"), "key", "what"))).alias("stack"))
    return held.withColumnRenamed("at", "key")


def match_rules(urls: DataFrame, rules: DataFrame, rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """Rows ``(id, rule, action)`` with the longest rule that fits each row of ``urls (id, host, path)``; urls without one are absent.

    ``rules``: (host, path, action). A rule fits its host and all subdomains if the path starts
    with the rule's; the longest host and path together win, of equals the longer host, then the
    smaller text. Rules with a null or empty host or a null path fit nothing; of rules that repeat
    a host and path the smallest action stands. A zone (last label) with many urls is swept in
    parts, each with all of the zone's rules.
    """
    stacks = checkpointed(_rule_stacks(rules))
    labels = F.split("host", r"\.")
    # only the suffixes that are some rule's host can meet an open interval
    hosts = stacks.select("zone", F.substring_index("key", _SEP, 1).alias("host_key")).distinct()
    most = hosts.agg(F.max(F.size(F.split("host_key", r"\."))).alias("n")).head().n or 1  # no suffix of more labels is a rule's host
    first = F.greatest(F.lit(1), F.size("_labels") - most + 1)
    suffixes = F.transform(F.sequence(first, F.size("_labels")), lambda i: F.slice("_labels", i, F.size("_labels") - i + 1))
    each = urls.where("host <> ''").withColumn("_labels", labels).select("id", F.element_at("_labels", -1).alias("zone"), "path", F.explode(suffixes).alias("s"))
    points = each.select("id", "zone", _key(F.col("s"), F.col("path")).alias("key"), F.array_join(F.reverse("s"), ".").alias("host_key"))
    points = points.join(hosts, ["zone", "host_key"], "left_semi").select("id", "zone", "key")
    parts = points.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / rows_per_sweep).cast("int").alias("parts"))
    parts = checkpointed(parts)
    starts = stacks.join(parts, "zone").select("zone", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), "stack")
    dealt = points.join(parts, "zone").select(
        "zone", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int").alias("part"), "key", F.lit(1).alias("kind"), "id", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")
    )
    events = starts.unionByName(dealt)
    sweep = Window.partitionBy("zone", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    still = F.filter("open", lambda x: F.col("key").startswith(x.key))
    top = seen.select("id", F.element_at(still, -1).alias("top"), F.size(still).alias("n")).where("n > 0")
    rank = F.struct((-F.length("top.what.rule")).alias("a"), (-F.instr("top.key", _SEP)).alias("b"), F.col("top.what.rule").alias("rule"), F.col("top.what.action").alias("action"))
    return top.groupBy("id").agg(F.min(rank).alias("best")).select("id", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows ``(page_id, host, path, rule, verdict)``, one per row of ``pages``; no rule: null and ``default``.

    Null urls and urls without ``://`` have an empty host and path and fit no rule. Equal (host,
    path) pairs are judged once, so that null or repeated ids and very common urls do no harm.
    Other columns are ignored; an empty input gives an empty result.
    """
    parsed = checkpointed(pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")))
    places = parsed.select("host", "path").distinct().withColumn("id", F.struct("host", "path"))
    found = match_rules(places, rules).select("id.host", "id.path", "rule", "action")
    return parsed.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


#: The rules that the registered query applies: host, path, action.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def oracle_sql() -> str:
    """DuckDB: every rule against every url by its definition."""
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return rf"""
WITH rules(rh, rp, action) AS (VALUES {values}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
urls AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (SELECT n, rh || rp AS rule, action, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC, rh || rp) AS k
         FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""
