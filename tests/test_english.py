import itertools
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import english as E

#: The published sample of words and their stems.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight
knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock
knocks knock knopp knopp knot knot knots knot""".split()

#: Cases that the published rules name.
RULES = """caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi agreed agre luxuriated luxuri hopping hop hoping hope hopped hop hoped hope shredded shred
cry cri by by say say conditional condit rational ration sensibility sensibl analogously analog organization organ happiness happi hopefulness hope formative format
adjustment adjust replacement replac adoption adopt roll roll controlling control probate probat rate rate generate generat generously generous communism communism
arsenal arsenal skis ski dying die news news succeed succeed exceeding exceed innings inning early earli youth youth boyish boyish beautiful beauti sky sky bed bed bead bead""".split()


@pytest.mark.parametrize("pairs", [SAMPLE, RULES])
def test_stems_are_the_published_ones(pairs):
    wrong = {w: (E.stem(w), s) for w, s in zip(pairs[::2], pairs[1::2], strict=True) if E.stem(w) != s}
    assert not wrong


def test_terms_lose_accents_and_stop_words_keep_their_places():
    assert E.english_words("The Résumés of ÉTÉ-lovers, 42 runs") == ["", "resum", "", "ete", "lover", "42", "run"]
    assert E.english_words(None) == E.english_words("") == []


def covers(places, terms):
    """All runs between two places that hold every term and no shorter such run, by definition."""
    runs = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(places)), 2) if {t for _, t in places[i : j + 1]} == set(range(terms))]
    best = [r for r in runs if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in runs)]
    return sum(0.1 / (1 + places[j][0] - places[i][0] - (j - i)) for i, j in best)


def test_cover_rank_equals_its_definition(spark):
    r = random.Random(2)
    cases = []
    for n in range(60):
        terms = r.randint(1, 3)
        at = sorted(r.sample(range(40), r.randint(0, 12)))
        cases.append((n, terms, [(a, r.randrange(terms)) for a in at]))
    for terms in (1, 2, 3):
        own = [(n, p) for n, t, p in cases if t == terms]
        got = spark.createDataFrame(own, "n int, places array<struct<at:int,term:int>>").select("n", E.cover_rank(F.col("places"), terms).alias("rank")).collect()
        assert {x.n: pytest.approx(x["rank"]) for x in got} == {n: covers(p, terms) for n, p in own}
