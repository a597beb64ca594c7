"""Entity graph: neighbours, symbol resolution, links between artifacts of a text, and PageRank."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, checkpointed

#: At most this many qualified names are broadcast; more are joined by a shuffle.
MAX_BROADCAST_NAMES = 500_000
#: About as many entities of one name and type stand in a block; at most this many types of a name in more than one block are broadcast.
SAME_AS_BLOCK, MAX_BROADCAST_TYPES = 500, 500_000
#: About as many edges are made by one task.
SAME_AS_EDGES = 5_000_000


def neighbours(relations: DataFrame, entities: DataFrame, predicates: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(entity_id, neighbour_id, predicate, direction, confidence) of the given entities ``(entity_id)``; a self-loop shows twice."""
    edges = relations if predicates is None else relations.where(F.col("predicate").isin(predicates))
    out = edges.select(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("neighbour_id"), "predicate", F.lit("out").alias("direction"), "confidence")
    back = edges.select(F.col("object_id").alias("entity_id"), F.col("subject_id").alias("neighbour_id"), "predicate", F.lit("in").alias("direction"), "confidence")
    every = {"out": out, "in": back}.get(direction)
    every = out.unionByName(back) if every is None else every
    return every.join(entities.select("entity_id"), "entity_id", "left_semi")


#: Fixed order in which the kinds of symbols are tried.
SYMBOL_KINDS = ("function", "method", "type", "struct", "interface", "class", "module", "package", "variable", "file")


#: Kinds that a name qualified by an import may stand for, in order.
CODE_KINDS = ("function", "method", "type", "struct", "interface", "class", "variable")


def suffix_keys(canonical: Column) -> Column:
    """A name and what follows each ``.``, ``::`` and ``#`` in it: what it can be found by."""
    after = lambda i: F.substring(canonical, i - 1, F.lit(1)).isin(".", "#") | (F.substring(canonical, i - 2, F.lit(2)) == "::") & (i > 2)
    starts = F.filter(F.sequence(F.lit(2), F.length(canonical)), after)
    ends = F.when(F.length(canonical) > 1, F.transform(starts, lambda i: F.substring(canonical, i, F.length(canonical)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(canonical), ends))


def by_suffix(entities: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """(name, entity_id, place): per name the entities whose canonical name is it or ends with it after ``.``, ``::`` or ``#``, the shortest first, ties to the smaller id.

    Every suffix of a canonical name is a key, so that names of several parts are joined by equality; names and suffixes without a partner do not meet.
    """
    asked = names.select("name").where("name <> ''").distinct()
    keys = entities.select("entity_id", F.length("canonical").alias("_n"), F.explode(suffix_keys(F.col("canonical"))).alias("name"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("_n", "entity_id"))
    return keys.join(asked, "name", "left_semi").withColumn("place", place).where(F.col("place") <= limit).select("name", "entity_id", "place")


def resolve_symbols(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(name, entity_id): per name the entity of exactly that canonical name by the order of kinds, else the shortest that ends with it (see ``by_suffix``)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in SYMBOL_KINDS]), F.col("entity_type"))
    whole = entities.select(F.col("canonical").alias("name"), "entity_id", rank.alias("kind")).where("kind > 0").join(names.select("name"), "name", "left_semi")
    exact = whole.groupBy("name").agg(F.min_by("entity_id", F.struct("kind", "entity_id")).alias("entity_id"), F.lit(0).alias("way"))
    ends = by_suffix(entities, names, 1).select("name", "entity_id", F.lit(1).alias("way"))
    return exact.unionByName(ends).groupBy("name").agg(F.min_by("entity_id", "way").alias("entity_id"))


def qualified_names(entities: DataFrame) -> DataFrame:
    """(head, name, entity_id, kind): every canonical name of a kind in ``CODE_KINDS`` cut at each of its dots, with the first kind that bears it, ties to the smaller id."""
    rank = F.array_position(F.array(*[F.lit(k) for k in CODE_KINDS]), F.col("entity_type"))
    first = entities.select("canonical", F.struct(rank.alias("kind"), "entity_id").alias("s")).where("s.kind > 0").groupBy("canonical").agg(F.min("s").alias("s"))
    dots = F.filter(F.sequence(F.lit(1), F.length("canonical")), lambda i: F.substring(F.col("canonical"), i, F.lit(1)) == ".")
    cut = first.select("canonical", "s", F.explode(dots).alias("i"))
    head, name = F.substring(F.col("canonical"), F.lit(1), F.col("i") - 1), F.substring(F.col("canonical"), F.col("i") + 1, F.length("canonical"))
    return cut.select(head.alias("head"), name.alias("name"), "s.entity_id", "s.kind")


def resolve_targets(asked: DataFrame, local: DataFrame, imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(file, name, entity_id, stage): what a name that a file calls or uses stands for; names that nothing bears are absent.

    ``asked``: (file, name); ``local``: (file, name, entity_id), the symbols of a file; ``imports``: (file, canonical, name) of imported packages;
    ``entities``: (entity_id, entity_type, canonical). First the file's own symbols, then a package's canonical or plain name with the name, in the order of packages, of
    these two and of kinds, then the shortest canonical name that ends with it.

    A file's names meet its packages where the file lies: only packages and names that some canonical name begins and ends with, and only
    to ask the broadcast ``qualified_names``; what they make together is neither written nor sorted, unless those are too many to broadcast.
    """
    asked = checkpointed(asked.select("file", "name").distinct())
    first = local.groupBy("file", "name").agg(F.min("entity_id").alias("entity_id"))
    own = asked.join(first, ["file", "name"]).select("file", "name", "entity_id", F.lit(1).alias("stage"))
    known = checkpointed(qualified_names(entities))
    heads, names = (broadcast_if_small(known.select(c).distinct(), MAX_BROADCAST_NAMES) for c in ("head", "name"))
    package = imports.select("file", F.col("canonical").alias("package"), F.col("name").alias("plain")).distinct()
    package = package.select("file", "package", F.posexplode(F.array("package", "plain")).alias("form", "head")).join(heads, "head", "left_semi")
    wanted = asked.join(names, "name", "left_semi").join(package, "file").join(broadcast_if_small(known, MAX_BROADCAST_NAMES), ["head", "name"])
    through = wanted.groupBy("file", "name").agg(F.min_by("entity_id", F.struct("package", "form", "kind", "entity_id")).alias("entity_id")).withColumn("stage", F.lit(2))
    ends = asked.join(by_suffix(entities, asked, 1).drop("place"), "name").select("file", "name", "entity_id", F.lit(4).alias("stage"))
    every = own.unionByName(through).unionByName(ends)
    return every.groupBy("file", "name").agg(F.min_by("entity_id", "stage").alias("entity_id"), F.min("stage").alias("stage"))


@dataclass(frozen=True)
class Hop:
    """One step of a path: the predicates it may have (any without them), ``out``, ``in`` or ``both`` ways, and a condition on the entity it ends at."""

    predicates: tuple[str, ...] = ()
    direction: str = "out"
    where: Column | None = None


def match_paths(entities: DataFrame, relations: DataFrame, scope_id: str, start: Column | None, hops: list[Hop]) -> DataFrame:
    """(n0, p1, d1, n1, p2, d2, n2, ...): paths that begin at an entity of a scope: entity, predicate, direction, entity, and so on.

    The scope bounds the first entity before anything is joined; conditions are on columns of ``entities (entity_id, scope_id, ...)`` and cut each side before its
    join. No path holds one relation twice; without hops it is the entities themselves. Hops without a direction that is known raise ``ValueError``.
    """
    if bad := [h.direction for h in hops if h.direction not in ("out", "in", "both")]:
        raise ValueError(f"no such direction: {bad[0]}")
    first = entities.where(F.col("scope_id") == scope_id)
    paths = (first if start is None else first.where(start)).select(F.col("entity_id").alias("n0"))
    for k, hop in enumerate(hops, 1):
        edges = relations.where(F.col("predicate").isin(*hop.predicates)) if hop.predicates else relations
        key = F.struct("scope_id", "subject_id", "predicate", "object_id").alias(f"_e{k}")
        ways = {"out": ("subject_id", "object_id"), "in": ("object_id", "subject_id")}
        each = [edges.select(F.col(a).alias(f"n{k - 1}"), F.col("predicate").alias(f"p{k}"), F.lit(d).alias(f"d{k}"), F.col(b).alias(f"n{k}"), key) for d, (a, b) in ways.items() if hop.direction in (d, "both")]
        step = each[0] if len(each) == 1 else each[0].unionByName(each[1].where(F.col(f"n{k}") != F.col(f"n{k - 1}")))  # a loop is one step, whichever way
        if hop.where is not None:
            step = step.join(entities.where(hop.where).select(F.col("entity_id").alias(f"n{k}")), f"n{k}", "left_semi")
        paths = paths.join(step, f"n{k - 1}")
        for j in range(1, k):
            paths = paths.where(F.col(f"_e{j}") != F.col(f"_e{k}"))
    names = [c for k in range(1, len(hops) + 1) for c in (f"p{k}", f"d{k}", f"n{k}")]
    return paths.select("n0", *names)


def co_occurrences(links: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): pairs of items of one group, smaller first, with the number of groups that hold both.

    Groups are small by nature (the entities of one memory); pairs are aggregated on the map side.
    """
    x = links.select(F.col(group).alias("g"), F.col(item).alias("a")).distinct()
    return x.join(x.withColumnRenamed("a", "b"), "g").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def same_as(entities: DataFrame) -> DataFrame:
    """(subject_id, object_id): pairs of entities ``(id, canonical, t)`` of equal canonical name and another type, the smaller id first.

    There are as many pairs as there are, but no others are looked at: entities of one name and type stand in blocks, each two blocks of
    a name and different types are a tile whose pairs are all edges, and tiles are dealt to tasks by their own keys, as many as the edges need.
    """
    e = entities.select("id", "canonical", "t").dropna()
    sizes = checkpointed(e.groupBy("canonical", "t").agg(F.count(F.lit(1)).alias("n")))
    total, own = F.sum("n").cast("double"), F.sum(F.col("n").cast("double") * F.col("n"))
    edges = sizes.groupBy("canonical").agg(((total * total - own) / 2).alias("edges")).agg(F.sum("edges")).first()[0] or 0
    several = sizes.where(F.col("n") > SAME_AS_BLOCK).select("canonical", "t", F.ceil(F.col("n") / SAME_AS_BLOCK).alias("k"))
    placed = e.join(broadcast_if_small(several, MAX_BROADCAST_TYPES), ["canonical", "t"], "left")
    block = F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).alias("block")
    blocks = placed.select("canonical", "t", block, "id").groupBy("canonical", "t", "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    others = blocks.select("canonical", F.col("t").alias("t2"), F.col("block").alias("block2"), F.col("ids").alias("ids2"))
    tiles = blocks.join(others, "canonical").where("t < t2").repartition(math.ceil(edges / SAME_AS_EDGES) or 1, "canonical", "t", "block", "t2", "block2")
    pairs = tiles.select(F.explode("ids").alias("a"), "ids2").select("a", F.explode("ids2").alias("b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("subject_id"), F.greatest("a", "b").alias("object_id"))


def chain(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order, next_order): every element with the one after it."""
    return rows.select(group, order, F.lead(order).over(Window.partitionBy(group).orderBy(order)).alias(f"next_{order}")).where(F.col(f"next_{order}").isNotNull())


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank): (1 - d) / N plus d times what comes over the edges; nodes without edges share theirs with all.

    Every fifth round is checkpointed, so that the plan stays short.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    nodes = checkpointed(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = checkpointed(edges.join(out, "src"))
    ranks = nodes.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", "degree", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        lost = ranks.where("degree IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        ranks = ranks.select("node", "degree").join(given, "node", "left").crossJoin(F.broadcast(lost)).select("node", "degree", new.alias("rank"))
        if k % 5 == 4:
            ranks = checkpointed(ranks)
    return ranks.select("node", "rank")


def augmented(hits: DataFrame, relations: DataFrame, memories: DataFrame, allowed: DataFrame, seen: DataFrame, per_neighbour: int = 3) -> DataFrame:
    """(id, score): the newest memories of the neighbours of every hit's entity, at hit score times confidence times 0.6.

    ``hits``: (entity_id, score); ``memories``: (id, scope_id, entity_id, created_at), of which those outside ``allowed (scope_id)`` and those in
    ``seen (id)`` are left out. The first hit counts, in the order of the results (score, entity) and then of confidence.
    """
    near = neighbours(relations, hits.select("entity_id").distinct()).groupBy("entity_id", "neighbour_id").agg(F.max("confidence").alias("confidence"))
    newest = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "id"))
    few = memories.withColumn("place", newest).where(F.col("place") <= per_neighbour).join(allowed.distinct(), "scope_id", "left_semi").join(seen.select("id"), "id", "left_anti")
    few = few.select("id", F.col("entity_id").alias("neighbour_id"))
    score: Column = F.col("score") * F.col("confidence") * 0.6
    order = F.struct(-F.col("score"), "entity_id", -F.col("confidence"), "neighbour_id")
    return near.join(hits, "entity_id").join(few, "neighbour_id").groupBy("id").agg(F.min_by(score, order).alias("score"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, symbol): what a called name in a file stands for.

    ``calls``: (file, name); ``symbols``: (file, name, symbol); ``imports``: (file, target). The name is looked up in the
    file itself, then in the files it imports, then anywhere if only one symbol there bears it.
    """
    asked = calls.select("file", "name").distinct()
    local = asked.join(symbols, ["file", "name"]).select("file", "name", "symbol", F.lit(1).alias("stage"))
    there = symbols.select(F.col("file").alias("target"), "name", "symbol")
    through = asked.join(imports.select("file", "target").distinct(), "file").join(there, ["target", "name"]).select("file", "name", "symbol", F.lit(2).alias("stage"))
    alone = symbols.groupBy("name").agg(F.min("symbol").alias("symbol"), F.count(F.lit(1)).alias("n")).where("n = 1")
    anywhere = asked.join(alone.drop("n"), "name").select("file", "name", "symbol", F.lit(3).alias("stage"))
    every = local.unionByName(through).unionByName(anywhere)
    return every.groupBy("file", "name").agg(F.min(F.struct("stage", "symbol")).alias("s")).select("file", "name", "s.symbol", "s.stage")
