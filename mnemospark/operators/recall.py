"""Hybrid retrieval: candidates by signal, merged, scored with decay, cut to the best."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import jaccard, trigrams, words
from mnemospark.functions.vector import cosine_similarity
from mnemospark.operators.angular import angular_pairs
from mnemospark.operators.search import match_trigrams, match_words
from mnemospark.session import checkpointed

#: Fixed weights of the score and decay rates a day.
W_VECTOR, W_TEXT, W_TRIGRAM, W_IMPORTANCE, W_RECENCY = 0.50, 0.10, 0.10, 0.20, 0.10
DECAY = {"working": 0.015, "episodic": 0.010}
DECAY_OTHER = 0.005
#: Fixed half-lives in days of knowledge by kind.
HALF_LIFE = {"meeting": 7, "retro": 14, "research": 45, "spec": 60, "design": 60, "decision": 90}
HALF_LIFE_OTHER = 30
TRIGRAM_CUT = 0.1
#: Rows of a part that a probe compares as a whole.
PROBE_PART = 1024


def days_since(then: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / F.lit(86400.0)


def by_vector(rows: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """(id, vector): the rows nearest to the one vector ``q`` of ``query``; rows without a vector do not take part, and without a query there are none."""
    near = rows.where("vec is not null").crossJoin(F.broadcast(query.select("q").where("q is not null").limit(1)))
    return near.select("id", F.round(cosine_similarity(F.col("vec"), F.col("q")), 9).alias("vector")).orderBy(F.desc("vector"), "id").limit(limit)


def by_first_vectors(rows: DataFrame, tables: list[DataFrame], query: DataFrame, limit: int) -> DataFrame:
    """``by_vector`` over the first of ``tables (id, vec)`` that gives any candidate for ``rows (id)``: a model's own table, then the vectors kept with the rows."""
    found = None
    for t in tables:
        found = by_vector(t.join(rows.select("id"), "id", "left_semi"), query, limit)
        if t is tables[-1] or not found.isEmpty():
            break
    return found


def by_trigram(rows: DataFrame, query: str, limit: int, column: str = "content") -> DataFrame:
    score = jaccard(trigrams(F.col(column)), trigrams(F.lit(query)))
    # cutting after the limit keeps the same rows and computes each score once
    return rows.select("id", score.alias("trigram")).orderBy(F.desc("trigram"), "id").limit(limit).where(F.col("trigram") > TRIGRAM_CUT)


def by_terms(rows: DataFrame, query: str, limit: int, column: str = "content") -> DataFrame:
    """(id, text): rows that hold every word of the query, by how large a part of the text those words are."""
    terms = F.array_distinct(words(F.lit(query)))
    here = words(F.col(column))
    hits = F.size(F.filter(here, lambda w: F.array_contains(terms, w)))
    every = F.size(F.array_except(terms, here)) == 0
    scored = rows.select("id", F.when(every, hits.cast("double") / F.greatest(F.size(here), F.lit(1))).alias("text"))
    return scored.orderBy(F.desc_nulls_last("text"), "id").limit(limit).where("text is not null")


def recall_memories(
    rows: DataFrame, now: Column, query: str, vector: DataFrame, tables: list[DataFrame], code_vector: DataFrame | None = None, code_tables: list[DataFrame] | None = None,
    mode: str = "hybrid", limit: int = 10, types: list[str] | None = None, since: Column | None = None, until: Column | None = None, min_score: float = 0.0,
    word_index: str | None = None, trigram_index: str | None = None, scopes: DataFrame | None = None,
) -> DataFrame:
    """(id, memory_type, score): the best memories for a query in one of three modes.

    ``text`` asks the vectors only; ``code`` the code vectors, and words where there are none; ``hybrid`` vectors, words and trigrams.
    The window ``since`` to ``until`` holds for candidates; ``types`` and ``min_score`` for what is scored. With ``scopes (scope_id)``, those that the asker
    is authorised for, candidates come from these alone, and from none where there are none. ``word_index`` and ``trigram_index`` are folders of
    indexes of the contents, whose postings are read in place of the texts.
    """
    rows = rows if scopes is None else rows.join(scopes.select("scope_id").distinct(), "scope_id", "left_semi")
    rows = rows if since is None else rows.where(F.col("created_at") >= since)
    rows = rows if until is None else rows.where(F.col("created_at") <= until)
    by_words = by_terms(rows, query, 2 * limit) if word_index is None else match_words(rows.sparkSession, word_index, query, 2 * limit, rows)
    if mode == "code":
        found = by_first_vectors(rows, code_tables, code_vector, 2 * limit) if code_tables else None
        signals = [by_words if found is None or found.isEmpty() else found]
    else:
        signals = [by_first_vectors(rows, tables, vector, 2 * limit)]
        if mode == "hybrid":
            grams = by_trigram(rows, query, 2 * limit) if trigram_index is None else match_trigrams(rows.sparkSession, trigram_index, query, 2 * limit, rows)
            signals += [by_words, grams]
    scored = rows.drop("content").join(F.broadcast(merged(*signals)), "id").withColumn("score", memory_score(now))
    scored = scored if not types else scored.where(F.col("memory_type").isin(types))
    return best(scored.select("id", "memory_type", "score"), limit, min_score)


def recall_knowledge(
    rows: DataFrame, now: Column, query: str, vector: DataFrame, tables: list[DataFrame], word_index: str, trigram_index: str, digests: DataFrame | None = None,
    limit: int = 10, since: Column | None = None, until: Column | None = None, min_score: float = 0.0,
) -> DataFrame:
    """(id, kind, score): the best published artifacts for a query by vectors (a model's own table first), words and trigrams, endorsements and recency.

    ``rows``: (id, kind, created_at, published_at, endorsement_count) that the asker may see; the window holds for when they were published, else made.
    Sources of a digest that is among the results are left out after the limit; ``digests``: (digest_id, source_id).
    """
    when = F.coalesce("published_at", "created_at")
    rows = rows if since is None else rows.where(when >= since)
    rows = rows if until is None else rows.where(when <= until)
    spark = rows.sparkSession
    signals = [by_first_vectors(rows, tables, vector, 2 * limit), match_words(spark, word_index, query, 2 * limit, rows), match_trigrams(spark, trigram_index, query, 2 * limit, rows)]
    scored = rows.join(F.broadcast(merged(*signals)), "id").withColumn("score", knowledge_score(now) + intent_boost(F.col("kind"), query))
    found = best(scored.select("id", "kind", "score"), limit, min_score)
    return found if digests is None else without_digested(checkpointed(found), digests)


def scoped_signals(rows: DataFrame, query: str, vector: DataFrame, vectors: DataFrame, word_index: str, trigram_index: str, limit: int) -> DataFrame:
    """(scope_id, id, vector, text, trigram): for every scope of ``rows (scope_id, id)`` its own candidates, the first ``limit`` by each signal; all scopes in one run."""
    spark = rows.sparkSession
    place = lambda s: F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc(s), "id"))
    asked = vector.select("q").where("q is not null").limit(1)
    near = vectors.where("vec is not null").join(rows, "id").crossJoin(F.broadcast(asked)).select("scope_id", "id", F.round(cosine_similarity(F.col("vec"), F.col("q")), 9).alias("vector"))
    words = match_words(spark, word_index, query, None, rows).join(rows, "id").select("scope_id", "id", "text")
    grams = match_trigrams(spark, trigram_index, query, None, rows).join(rows, "id").select("scope_id", "id", "trigram")
    first = [d.withColumn("_place", place(s)).where(F.col("_place") <= limit).drop("_place") for d, s in ((near, "vector"), (words, "text"), (grams, "trigram"))]
    names = ("vector", "text", "trigram")
    wide = [d.select("scope_id", "id", *[(F.col(n) if n in d.columns else F.lit(None)).cast("double").alias(n) for n in names]) for d in first]
    return reduce(DataFrame.unionByName, wide).groupBy("scope_id", "id").agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])


#: Fixed reason of a layer that the asker may not read.
FORBIDDEN = "forbidden"


def cross_scope_context(
    asked: DataFrame, granted: DataFrame, memories: DataFrame, artifacts: DataFrame, now: Column, query: str, vector: DataFrame, vectors: DataFrame, word_index: str, trigram_index: str,
    limit: int = 10, since: Column | None = None, min_score: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """((scope_id, layer, id, score), (scope_id, layer, reason)): for each of ``asked (scope_id)`` strictly its own memories and knowledge, and the layers that were skipped.

    ``granted``: (scope_id, layer) that the asker may read; a scope without any layer has no results. A memory whose artifact is among the knowledge
    of its scope goes; the ``limit`` holds for each layer, then for each scope.
    """
    layers = asked.select("scope_id").distinct().withColumn("layer", F.explode(F.array(F.lit("memory"), F.lit("knowledge"))))
    skipped = layers.join(granted, ["scope_id", "layer"], "left_anti").withColumn("reason", F.lit(FORBIDDEN))
    allowed = layers.join(granted, ["scope_id", "layer"], "left_semi")
    of = lambda rows, layer: rows.join(allowed.where(F.col("layer") == layer).select("scope_id"), "scope_id", "left_semi")
    m, a = of(memories, "memory"), of(artifacts.withColumnRenamed("owner_scope_id", "scope_id"), "knowledge")
    if since is not None:
        m, a = m.where(F.col("created_at") >= since), a.where(F.coalesce("published_at", "created_at") >= since)
    signals = lambda rows: scoped_signals(rows.select("scope_id", "id"), query, vector, vectors, word_index, trigram_index, 2 * limit)
    known = a.join(signals(a), ["scope_id", "id"]).withColumn("score", knowledge_score(now) + intent_boost(F.col("kind"), query)).select("scope_id", "id", "score")
    known = checkpointed(best(known, limit, min_score, by=["scope_id"]))
    own = best(m.join(signals(m), ["scope_id", "id"]).withColumn("score", memory_score(now)).select("scope_id", "id", "score", "promoted_to"), limit, min_score, by=["scope_id"])
    own = own.join(known.select("scope_id", F.col("id").alias("promoted_to")), ["scope_id", "promoted_to"], "left_anti")
    both = known.select("scope_id", F.lit("knowledge").alias("layer"), "id", "score").unionByName(own.select("scope_id", F.lit("memory").alias("layer"), "id", "score"))
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("score"), "layer", "id"))
    return both.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place"), skipped


def recall_skills(rows: DataFrame, query: str, vector: DataFrame, tables: list[DataFrame], agent: str = "any", limit: int = 20, min_score: float = 0.0) -> DataFrame:
    """(id, score): published skills for an agent type by vector, words and trigrams of ``content``, their use, and full recency."""
    rows = rows.where((F.col("status") == "published") & (F.array_contains("agent_types", "any") | F.array_contains("agent_types", agent)))
    signals = [by_first_vectors(rows, tables, vector, 2 * limit), by_terms(rows, query, 2 * limit), by_trigram(rows, query, 2 * limit)]
    score = base_score(F.least(F.col("invocation_count") / 100.0, F.lit(1.0)), F.lit(1.0))
    return best(rows.select("id", "invocation_count").join(F.broadcast(merged(*signals)), "id").select("id", score.alias("score")), limit, min_score)


def combine_layers(memories: DataFrame, knowledge: DataFrame, skills: DataFrame, limit: int, min_score: float = 0.0) -> DataFrame:
    """(layer, id, score, content, full_content_available): the best of three layers of ``(id, score, content)`` rows.

    Memories (with ``promoted_to``) whose artifact is among the results go; knowledge (with ``summary``) shows its summary where it has one.
    """
    short = F.coalesce(F.length("summary") > 0, F.lit(False))
    known = knowledge.select(F.lit("knowledge").alias("layer"), "id", "score", F.when(short, F.col("summary")).otherwise(F.col("content")).alias("content"), short.alias("full_content_available"))
    own = without_promoted(memories, knowledge).select(F.lit("memory").alias("layer"), "id", "score", "content", F.lit(False).alias("full_content_available"))
    able = skills.select(F.lit("skill").alias("layer"), "id", "score", "content", F.lit(False).alias("full_content_available"))
    return known.unionByName(own).unionByName(able).where(F.col("score") >= min_score).orderBy(F.desc("score"), "layer", "id").limit(limit)


def touched(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """``memories`` after a recall: each of ``hits (id)`` was accessed once more, at ``now``."""
    rows = memories.join(F.broadcast(hits.select("id").distinct().withColumn("_hit", F.lit(True))), "id", "left")  # a recall has a limit
    hit = F.coalesce("_hit", F.lit(False))
    return rows.withColumns({"access_count": F.col("access_count") + hit.cast("int"), "last_accessed": F.when(hit, now).otherwise(F.col("last_accessed"))}).drop("_hit")


def near_probe(asked: DataFrame, memories: DataFrame, distance: float = 0.05, limit: int = 5) -> DataFrame:
    """(asked_id, id, distance): for every new memory ``asked (id, scope_id, vec)`` the active ones of its scope within a distance, the nearest ``limit``."""
    known = memories.where("is_active and vec is not null").select("id", "vec", "scope_id")
    near = angular_pairs(asked.select("id", "vec", "scope_id"), known, 1 - distance - 1e-9, ["scope_id"], PROBE_PART).where("a <> b")
    found = near.select(F.col("a").alias("asked_id"), F.col("b").alias("id"), F.round(1 - F.col("cosine"), 9).alias("distance")).where(F.col("distance") <= distance)
    place = F.row_number().over(Window.partitionBy("asked_id").orderBy("distance", "id"))
    return found.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def query_similar(table: DataFrame, scopes: DataFrame, query: DataFrame, object_type: str, scope_path: str | None = None, limit: int = 20) -> DataFrame:
    """(object_id, score): the nearest objects of a type in a model's table ``(object_type, object_id, scope_id, vec)``, within the scopes at or below a path."""
    rows = table.where(F.col("object_type") == object_type)
    if scope_path:
        inside = (F.col("path") == scope_path) | F.col("path").startswith(f"{scope_path}.")
        rows = rows.join(scopes.where(inside).select(F.col("id").alias("scope_id")), "scope_id", "left_semi")
    return by_vector(rows.select(F.col("object_id").alias("id"), "vec"), query, limit).select(F.col("id").alias("object_id"), F.col("vector").alias("score"))


def merged(*signals: DataFrame) -> DataFrame:
    """(id, vector, text, trigram): candidates of all signals, the largest score of each, 0 where absent."""
    names = ("vector", "text", "trigram")
    wide = [s.select("id", *[(F.col(n) if n in s.columns else F.lit(None)).cast("double").alias(n) for n in names]) for s in signals]
    return reduce(DataFrame.unionByName, wide).groupBy("id").agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])


def base_score(importance: Column, recency: Column) -> Column:
    return W_VECTOR * F.col("vector") + W_TEXT * F.col("text") + W_TRIGRAM * F.col("trigram") + W_IMPORTANCE * importance + W_RECENCY * recency


def combine_scores(vector: Column, text: Column, importance: Column, recency: Column, is_knowledge: Column) -> Column:
    """The plain formula of the merge: 0.50, 0.20, 0.20 and 0.10, and 0.10 more for knowledge."""
    return 0.50 * vector + 0.20 * text + 0.20 * importance + 0.10 * recency + F.when(is_knowledge, 0.10).otherwise(0.0)


def memory_score(now: Column) -> Column:
    rate = F.when(F.col("memory_type") == "working", DECAY["working"]).when(F.col("memory_type") == "episodic", DECAY["episodic"]).otherwise(DECAY_OTHER)
    return base_score(F.col("importance"), F.exp(-rate * days_since(F.coalesce("last_accessed", "created_at"), now)))


def half_life(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, days in HALF_LIFE.items():
        out = F.when(kind == name, float(days)).otherwise(out)
    return F.coalesce(out, F.lit(float(HALF_LIFE_OTHER)))


def knowledge_score(now: Column) -> Column:
    age = days_since(F.col("created_at"), now)
    recency = F.when(age <= 0, 1.0).otherwise(F.exp(-F.lit(0.6931471805599453) * age / half_life(F.col("kind"))))
    return base_score(F.least(F.col("endorsement_count") / 10.0, F.lit(1.0)), recency) + 0.10


#: Fixed lists: words of a query that favour a kind of knowledge, and by how much.
INTENTS = (
    ("decision", 0.08, ("why", "decision", "rationale"), ()),
    ("spec", 0.08, ("how", "implement", "design", "spec"), ()),
    ("meeting", 0.08, ("meeting", "notes", "yesterday"), ("last week",)),
    ("research", 0.06, ("research", "benchmark", "evaluate"), ()),
)


def intent_boost(kind: Column, query: str) -> Column:
    import re

    tokens = re.findall(r"[^\W_]+", query.lower())
    phrase = " ".join(tokens)
    out = F.lit(0.0)
    for name, boost, single, phrases in INTENTS:
        if set(tokens) & set(single) or any(f" {p} " in f" {phrase} " for p in phrases):
            out = out + F.when(kind == name, boost).otherwise(0.0)
    return out


def best(rows: DataFrame, limit: int, min_score: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """The ``limit`` best rows, ties to the smaller id; the bound itself is kept. ``by`` cuts per group."""
    rows = rows.where(F.col("score") >= min_score)
    if not by:
        return rows.orderBy(F.desc("score"), "id").limit(limit)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def without_promoted(memories: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Memories whose promoted artifact is not among the results."""
    known = knowledge.select(F.col("id").alias("promoted_to")).distinct()
    return memories.join(known, "promoted_to", "left_anti")


def without_digested(results: DataFrame, digests: DataFrame) -> DataFrame:
    """Results that no digest among them covers; ``digests``: (digest_id, source_id)."""
    present = digests.join(results.select(F.col("id").alias("digest_id")), "digest_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return results.join(present, "id", "left_anti")


def pack(rows: DataFrame, budget: int, order: list[str], keys: list[str]) -> DataFrame:
    """``keys`` and (tokens, place, running, taken): blocks in ``order`` until the budget is spent; one that does not fit is left out, and later ones may still fit.

    ``rows`` are what a recall with a limit gave: they are folded as one bounded list.
    """
    return _folded(rows.withColumn("stub_tokens", F.lit(None).cast("long")), budget, order, keys).drop("stubbed")


def pack_with_stubs(rows: DataFrame, budget: int, order: list[str], keys: list[str]) -> DataFrame:
    """As ``pack``, but a block that does not fit stands as a stub of ``stub_tokens``, which counts as well; every block is taken."""
    return _folded(rows, budget, order, keys).drop("taken")


def _folded(rows: DataFrame, budget: int, order: list[str], keys: list[str]) -> DataFrame:
    names = list(dict.fromkeys([*order, *keys, "tokens", "stub_tokens"]))
    blocks = rows.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("blocks"))

    def step(state: Column, b: Column) -> Column:
        fits = state.total + b.tokens <= budget
        stub = b.stub_tokens.isNotNull()
        cost = F.when(fits, b.tokens).when(stub, b.stub_tokens).otherwise(F.lit(0)).cast("long")
        one = F.struct(*[b[k].alias(k) for k in keys], cost.alias("tokens"), (F.size(state.out) + 1).cast("long").alias("place"), (state.total + cost).alias("running"), (fits | stub).alias("taken"), (~fits & stub).alias("stubbed"))
        return F.struct((state.total + cost).alias("total"), F.concat(state.out, F.array(one)).alias("out"))

    types = {f.name: f.dataType.simpleString() for f in rows.select(*names).schema}
    empty = "array<struct<" + ",".join(f"{k}:{types[k]}" for k in keys) + ",tokens:bigint,place:bigint,running:bigint,taken:boolean,stubbed:boolean>>"
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(empty).alias("out"))
    return blocks.select(F.explode(F.aggregate("blocks", start, step, lambda s: s.out)).alias("b")).select("b.*")
