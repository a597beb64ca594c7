"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders that remember what they replaced. Windows of
five canonical words are hashed and joined with the windows of the benchmark, so that a question
with other numbers or names still matches; the slots of a match must then map one way throughout.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import broadcast_if_small, checkpointed

WINDOW = 5
COVERAGE = 0.8
LEAST_LITERALS = 2
MAX_BROADCAST_WINDOWS = 1_000_000
MAX_BROADCAST_KEYS = 1_000_000

#: Private-use characters that open a typed placeholder, and one that joins the parts of a number.
NUM, NAME, UNIT, JOIN = "\ue000", "\ue001", "\ue002", "\ue003"
#: Fixed list: measures that may follow a number.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|l|ml|s|sec|min|h|hr|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|liters?|litres?|grams?|pounds?|dollars?|euros?|cents?|percent"

#: A run of capitalised words inside a sentence is one name; its value is the first of them. The run is possessive, which finds the
#: same: Java takes a greedy group one stack frame deeper for every word, so that one long run ended an executor.
NAMES = (r"([\p{Ll},;:]\x20)(\p{Lu}\p{Ll}+)(?:\x20\p{Lu}\p{Ll}+)*+", rf"$1{NAME}$2")
#: Replacements in texts with digits, in this order; all work alike in Java's and in RE2's regular expressions.
NUMBERS = (
    (r"([0-9])[.,]([0-9])", rf"$1{JOIN}$2"),
    (rf"[0-9][0-9{JOIN}]*", rf" {NUM}$0 "),
    (rf"({NUM}[0-9{JOIN}]+\x20+)({UNITS})\b", rf"$1{UNIT}$2"),
)
#: Blanks, ASCII punctuation, and Latin-1 and general punctuation part words.
_SPLIT = "[\\s\\p{Punct} -¿ -⁯]+"


def canonical_text(text: Column) -> Column:
    """Lower-cased text in which a placeholder is its type character and the value it replaced; such characters in the text itself part words."""
    marks = NUM + NAME + UNIT + JOIN
    own = reduce(or_, [F.contains(text, F.lit(m)) for m in marks])
    text = F.when(own, F.translate(text, marks, " " * len(marks))).otherwise(text)
    named = F.regexp_replace(text, *NAMES)
    full = named
    for pattern, new in NUMBERS:
        full = F.regexp_replace(full, pattern, new)
    return F.lower(F.when(text.rlike("[0-9]"), full).otherwise(named))


def canonical_words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPLIT), "")


def _is_slot(word: Column) -> Column:
    return (word >= NUM) & (word < JOIN)


def _literals(slots: list[Column]) -> Column:
    """How many words of a window are no placeholders."""
    return sum((s.isNull().cast("int") for s in slots), F.lit(0))


def _windows(rows: DataFrame, keys: list[str], size: int = WINDOW) -> DataFrame:
    """Rows (keys, h, at, r0 ... r4) from (keys, canonical text ``c``): one per window of ``size`` words, five at most.

    ``h`` hashes the window with placeholders reduced to their types, or with their values where
    it has fewer than ``LEAST_LITERALS`` other words or under five words and would match too much; ``r``
    hashes a placeholder with its value, and is null for other words and in short windows. Arrays are
    shifted and zipped, never indexed from inside a lambda, so that the work stays linear.
    """
    held = F.contains("c", F.lit(NUM)) | F.contains("c", F.lit(NAME)) | F.contains("c", F.lit(UNIT))
    words = rows.select(*keys, canonical_words(F.col("c")).alias("w"), held.alias("held"))
    typed = F.transform("w", lambda x: F.xxhash64(F.when(_is_slot(x), F.substring(x, 1, 1)).otherwise(x)))
    plain = F.transform("w", lambda x: F.xxhash64(x))
    value = F.transform("w", lambda x: F.when(_is_slot(x), F.xxhash64(x)))
    none = F.array().cast("array<bigint>")
    shift = lambda c: [F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))).alias(f"{c}{k}") for k in range(size)]
    if size < WINDOW:
        short = words.where(F.size("w") >= size).select(*keys, plain.alias("t"))
        flat = short.select(*keys, F.posexplode(F.arrays_zip(*shift("t"))).alias("at", "x")).where(f"x.t{size - 1} is not null")
        blank = [F.lit(None).cast("long").alias(f"r{k}") for k in range(WINDOW)]
        return flat.select(*keys, F.xxhash64(F.lit(size), *[F.col(f"x.t{k}") for k in range(size)]).alias("h"), "at", *blank)
    hashed = words.where(F.size("w") >= WINDOW).select(*keys, F.when(F.col("held"), typed).otherwise(plain).alias("t"), F.when(F.col("held"), value).otherwise(none).alias("r"))
    flat = hashed.select(*keys, F.posexplode(F.arrays_zip(*shift("t"), *shift("r"))).alias("at", "x")).where("x.t4 is not null")
    by_type = F.xxhash64(*[F.col(f"x.t{k}") for k in range(WINDOW)])
    by_value = F.xxhash64(*[F.coalesce(f"x.r{k}", f"x.t{k}") for k in range(WINDOW)])
    few = _literals([F.col(f"x.r{k}") for k in range(WINDOW)]) < LEAST_LITERALS
    return flat.select(*keys, F.when(few, by_value).otherwise(by_type).alias("h"), "at", *[F.col(f"x.r{k}") for k in range(WINDOW)])


def benchmark_windows(benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """Rows (h, item_id, n_words, item_at, a0 ... a4): ``a`` is the hashed value of a slot, null for a literal word.

    Items of under five words have no window, or with ``short_items`` one that is the whole item, word for word.
    """
    words = benchmark.where("item_id is not null").select("item_id", canonical_text(F.coalesce(F.col("text"), F.lit(""))).alias("c"))
    words = words.withColumn("n_words", F.size(canonical_words(F.col("c"))))
    rows = _windows(words, ["item_id", "n_words"])
    for k in range(1, WINDOW) if short_items else ():
        rows = rows.unionByName(_windows(words.where(F.col("n_words") == k), ["item_id", "n_words"], k))
    slot = [F.col(f"r{k}") for k in range(WINDOW)]
    return rows.select("h", "item_id", "n_words", F.col("at").alias("item_at"), *[s.alias(f"a{k}") for k, s in enumerate(slot)])


def document_key(doc_id: Column, text: Column) -> Column:
    """Identifies a row: its id, or where that is null its text."""
    return F.when(doc_id.isNull(), F.concat(F.lit("~"), F.md5(F.coalesce(text, F.lit(""))))).otherwise(doc_id.cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """Rows (key, doc_id, item_id, matched_words, item_words, coverage) for every document that holds an item.

    ``coverage`` is the share of the item's words inside five-word windows that the document has
    too, at ``coverage`` or more. Windows of one alignment (document position less item position)
    count only if equal slot values of the item stand for equal values in the document. A window
    with fewer than ``LEAST_LITERALS`` words that are no slots counts only word for word, and then
    asks nothing of the other slots. Items of under five words match nothing, or with ``short_items``
    wherever all their words stand in a row. Null
    and empty texts hold nothing; rows with a repeated id count as one document; rows with a null
    id are told apart by their text; other columns are ignored; empty inputs give an empty result.
    """
    items = checkpointed(benchmark_windows(benchmark, short_items))
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(document_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), canonical_text(text).alias("c"))
    windows = _windows(words, ["key", "doc_id"])
    if short_items:  # further windows only of lengths that some item has: four at most
        for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().orderBy("n_words").collect():
            windows = windows.unionByName(_windows(words, ["key", "doc_id"], r.n_words))
    hits = windows.join(broadcast_if_small(items, MAX_BROADCAST_WINDOWS), "h")
    few = _literals([F.col(f"a{k}") for k in range(WINDOW)]) < LEAST_LITERALS
    pairs = F.filter(F.array(*[F.struct(F.col(f"a{k}").alias("a"), F.col(f"r{k}").alias("b")) for k in range(WINDOW)]), lambda p: p.a.isNotNull() & ~few)
    line = hits.groupBy("key", "doc_id", "item_id", "n_words", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    one_way = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p.a)))
    places = F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.least(F.col("n_words"), F.lit(WINDOW)) - 1)))
    found = line.where(one_way).groupBy("key", "doc_id", "item_id", "n_words").agg(F.size(F.array_distinct(F.flatten(F.collect_set(places)))).alias("matched"))
    share = F.col("matched") / F.col("n_words")
    return found.where(share >= coverage).select(
        "key", "doc_id", "item_id", F.col("matched").cast("long").alias("matched_words"), F.col("n_words").cast("long").alias("item_words"), share.alias("coverage")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, short_items: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns, whatever their names, and all other rows stay.

    Rows that repeat an id go together; rows with a null id are judged each by its text; empty inputs drop nothing.
    """
    bad = checkpointed(contaminated(docs, benchmark, coverage, short_items=short_items).select("key").distinct())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, document_key(F.col("doc_id"), F.col("text")).alias("key"))
    return keyed.join(broadcast_if_small(bad, MAX_BROADCAST_KEYS), "key", "left_anti").select("row.*")
