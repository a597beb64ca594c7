import hashlib
import random
import re
import time

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm.pii import KINDS, SemiMarkov, base_spans, digest, find_pii, find_spans, fit_pii, fit_windows, luhn

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORDS = "the river ran past old mills and quiet fields before dusk".split()


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1249@.+-() é𝄞\n", max_size=60))
def test_base_spans_match_brute_force(text):
    assert base_spans(text) == brute(text)


def texts():
    out = []
    for i in range(120):
        w = WORDS[i % 7 :] + WORDS[: i % 7]
        what = [f"ann.b{i}@mail{i % 5}.example.com", f"{i}.20.{i % 200}.7", f"+1 (626) 555-{1000 + i}", "4111 1111 1111 1111" if i % 8 else "9582442921002355"][i % 4]
        out.append(" ".join([*w[:4], what, *w[4:]]))
    return out


def test_the_field_finds_other_spellings_and_keeps_base_spans():
    model = fit_windows(texts())
    base, spans = find_spans("please call (626) 555-1234 or write to ann.b@mail1.example.com soon", model)
    assert [k for k, _, _ in base] == ["email"]
    assert set(base) <= set(spans)
    assert ("phone", 12, 26) in spans
    clean = "the river ran past old mills in 2024 with 12 boats and 300 people"
    assert find_spans(clean, model) == ([], [])


def test_query_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(500, None, None, None), (501, "", None, None), (None, "a@b.cd", None, None), (3, "no", None, None), (502, "é𝄞 a@b.cd " + "1" * 5000 + " word " * 50000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base int")
    got = digest(find_pii(df, fit_pii(df))).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        b = brute(t) if t is None or len(t) < 10000 else base_spans(t)
        want.setdefault(i, []).append((tuple(sum(k == x for x, _, _ in b) for k in KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
    for r in got:
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) in want[r.doc_id]
    assert digest(find_pii(df.limit(0), fit_pii(df.limit(0)))).count() == 0


def segmentations(n, segs, at=0):
    """All ways to cover tokens from ``at`` on by single tokens outside and by segments."""
    if at == n:
        yield []
        return
    for rest in segmentations(n, segs, at + 1):
        yield rest
    for x, s in enumerate(segs):
        if s[0] == at:
            for rest in segmentations(n, segs, s[1]):
                yield [x, *rest]


def test_best_and_marginals_match_all_segmentations():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        segs = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(n)
            segs.append((a, rng.randint(a + 1, n), rng.choice(KINDS), a, a, [rng.randrange(50) for _ in range(3)]))
        model = SemiMarkov(np.array([rng.gauss(0, 1) for _ in range(50)]))
        every = list(segmentations(n, segs))
        score = [sum(model._score(segs[x]) for x in way) for way in every]
        assert np.isclose(sum(model._score(s) for s in model.best(n, segs)), max(score))
        total, got = model.marginals(n, segs)
        weight = np.exp(np.array(score) - total)
        assert np.isclose(weight.sum(), 1)
        assert np.allclose(got, [sum(w for w, way in zip(weight, every) if x in way) for x in range(len(segs))])


def test_fit_follows_the_slope_of_the_likelihood():
    data = [(4, [(0, 2, "phone", 0, 5, [1, 2]), (1, 3, "card", 2, 7, [1, 3]), (3, 4, "ip", 8, 9, [4])], {("phone", 0, 5)})]
    before, after = SemiMarkov(np.zeros(1 << 13)), SemiMarkov(np.zeros(1 << 13)).fit(data, epochs=30)
    gold = lambda m: sum(m._score(s) for s in data[0][1] if s[2:5] in data[0][2]) - m.marginals(*data[0][:2])[0]
    assert gold(after) > gold(before) and gold(after) > -0.3


def test_what_the_field_learns_to_find_and_to_leave():
    model = fit_windows(texts())
    for text, want in (("call me at 626 555 1234 please", ("phone", 11, 23)), ("or (626) 555-1234.", ("phone", 3, 17)), ("ann.b7(at)mail1.example.com now", ("email", 0, 27)), ("a card 4111.1111.1111.1111 there", ("card", 7, 26))):
        assert want in find_spans(text, model)[1], text
    name = "a" * 40 + "." + "b" * 40
    spelled = f"see {name} (at) {'c' * 35}(dot)example(dot)com for more"
    assert ("email", 4, len(spelled) - 9) in find_spans(spelled, model)[1]
    for text in ("version 1.2.3.4567 is out", "release 10.20.30.400 here", "on 2024-01-15 it rained", "build 1.2.3.4.5", "number 4111 1111 1111 1112 fails"):
        assert [s for s in find_spans(text, model)[1] if s not in find_spans(text, model)[0]] == [], text


def test_long_numeric_texts_take_linear_time():
    model = fit_windows(texts())
    for piece in ("1-2 ", "1.2.", "12 ", "(1) ", "a@", "1", "+1 ", "7@x.y "):
        start = time.time()
        find_spans(piece * 20_000, model)
        assert time.time() - start < 8, piece
