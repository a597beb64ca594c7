"""English analysis for full-text search: words without accents, stop words, and the published English (Porter2) suffix rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed list: the published English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
    did doing a an the and but if or because as until while of at by for with about against between into through during before after above
    below to from up down in out on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Fixed values of the published suffix rules.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
UNCHANGED_WITHOUT_S = frozenset("inning outing canning herring earring proceed exceed succeed".split())
HEADS = ("gener", "commun", "arsen")
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
LI_ENDS = frozenset("cdeghkmnrt")
STEP_2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWELS = frozenset("aeiouy")


def _suffix(word: str, among: tuple[str, ...] | dict[str, str]) -> str | None:
    """The longest of some suffixes that a word ends in."""
    return max((s for s in among if word.endswith(s)), key=len, default=None)


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant after a vowel begins, from ``start`` on."""
    for k in range(start + 1, len(word)):
        if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
            return k + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """True if a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS and word[-1] not in "wxY"


def stem(word: str) -> str:
    """The stem of a lower-case word by the published rules; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word in WHOLE or word in UNCHANGED:
        return WHOLE.get(word, word)
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (k == 0 or w[k - 1] in _VOWELS) else c for k, c in enumerate(w))
    head = next((h for h in HEADS if w.startswith(h)), None)
    r1 = len(head) if head else _region(w, 0)
    r2 = _region(w, r1)
    w = w.removesuffix("'s'") if w.endswith("'s'") else w.removesuffix("'s") if w.endswith("'s") else w.removesuffix("'")
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in UNCHANGED_WITHOUT_S:
        return w
    end = _suffix(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and any(c in _VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in DOUBLES:
            w = w[:-1]
        elif _ends_short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    end = _suffix(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        before = w[-len(end) - 1 : -len(end)]
        if (end != "ogi" or before == "l") and (end != "li" or before in LI_ENDS):
            w = w[: -len(end)] + STEP_2[end]
    end = _suffix(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _suffix(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def term(word: str) -> str:
    """What a lower-case word is found by: its stem without accents, or nothing for a stop word."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return "" if plain in STOP_WORDS else stem(plain)


_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def simple_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, in order."""
    return _WORD.findall((text or "").lower())


def english_words(text: str | None, seen: dict[str, str] | None = None) -> list[str]:
    """Terms of the words in order; an empty one keeps a stop word's place. ``seen`` remembers the terms of words."""
    seen = {} if seen is None else seen
    words = simple_words(text)
    for w in set(words).difference(seen):
        seen[w] = term(w)
    return [seen[w] for w in words]


@F.pandas_udf(ArrayType(StringType()))
def english_terms(text: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    return text.map(lambda t: english_words(t, seen))


#: Fixed weight of a term without a label.
COVER_WEIGHT = 0.1


def cover_rank(places: Column, terms: int) -> Column:
    """Cover density: over the shortest runs that hold all query terms, the sum of 0.1 / (1 + words in the run that are no query terms).

    ``places``: sorted array of (at, term) of the query's terms in a text. A run ends where every term has occurred and begins at the earliest of
    the terms' last places; a run that holds another run does not count.
    """
    zero = F.struct(F.array_repeat(F.lit(-1), terms).alias("last"), F.lit(-1).alias("start"), F.lit(0).alias("n"), F.lit(0.0).alias("rank"))

    def step(s: Column, p: Column) -> Column:
        last = F.transform(s.last, lambda x, i: F.when(i == p.term, s.n).otherwise(x))
        low = F.array_min(last)
        fresh = (low >= 0) & (low > s.start)
        other = p["at"] - F.get(places, low)["at"] - (s.n - low)
        more = F.when(fresh, COVER_WEIGHT / (1 + other)).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(fresh, low).otherwise(s.start).alias("start"), (s.n + 1).alias("n"), (s["rank"] + more).alias("rank"))

    return F.aggregate(places, zero, step, lambda s: s["rank"])
