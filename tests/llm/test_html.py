import random
import re
import time
from collections import Counter

from mnemospark.llm.html import ContentModel, blocks, extract_pages, fit_counts, fit_pages, page_counts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu one</a></li><li>Menu two</li></ul></nav>
<div class="ad">Buy now all of these fine things</div><article><h1>Head &amp; {n}</h1><p><b>First  para&nbsp;graph</b> runs on.<br>Second <i>line</i></p><ul><li>point a</li><li>b</li></ul>
<aside>See also this</aside><form>Name <input> <button>Send</button></form><div class="comments"><p>Nice post!</p></div><p>Here the whole story ends.</p></article><footer>&copy; site words here</footer></body></html>"""
WANT = "Head & {n} First para graph runs on. Second line point a b Here the whole story ends."


def model():
    total = Counter()
    for n in range(20):
        total.update(page_counts(PAGE.format(n=n)))
    return fit_counts(total)


def test_article_without_furniture():
    assert model().extract(PAGE.format(n=3)) == WANT.format(n=3)


def test_page_without_article():
    page = PAGE.format(n=1).replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert model().extract(page) == WANT.format(n=1)


def test_odd_markup():
    m = model()
    assert m.extract(None) == m.extract("") == ""
    assert m.extract("just text") == "just text"
    assert m.extract("<article><p>open <b>never closed") == "open never closed"
    assert m.extract("<article>a &lt; b &#233; <!-- x <p> --> c</article></footer") == "a < b é c"
    assert m.extract("<script>only()") == ""
    assert "".join(b.text for b in blocks("<p>" * 2000 + "deep")) == "deep"


def brute_region(scores):
    best = 0.0
    for a in range(len(scores)):
        run = 0.0
        for z in range(a, len(scores)):
            run += scores[z][1] + (scores[z][0] if z > a else 0.0)
            best = max(best, run)
    return best


def test_region_has_the_largest_sum():
    m = ContentModel(furniture={"nav": -3.0}, tags={"p": -0.3, "/p": -0.2})
    for n in range(1, 9):
        parts = blocks("".join(f"<p>{'w ' * (k % n)}x</p><nav>{'m ' * (k % 3)}y</nav>" for k in range(2 * n)))
        a, z = m.region(parts)
        total = sum(own + (before if i else 0) for i, (before, own) in enumerate(m.scores(parts)[a:z]))
        assert abs(total - brute_region(m.scores(parts))) < 1e-9


def test_query_rows(spark):
    rows = [(n, "u", PAGE.format(n=n), "x", 1) for n in range(30)] + [(90, None, None, None, None), (91, "u", "", None, None), (None, "u", "<p>hello there</p>", None, None), (91, "u", "<article>" + "<p>word</p>" * 20000, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract_pages(df, fit_pages(df)).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id is not None and r.page_id < 30} == {WANT.format(n=n) for n in range(30)}
    assert [r.text for r in got if r.page_id is None] == ["hello there"]
    assert sorted(r.n_chars for r in got if r.page_id == 91) == [0, 5 * 20000 - 1]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(df.limit(0), fit_pages(df.limit(0))).count() == 0


def generated(rng):
    """A page without ``article``: menus, adverts and a footer around paragraphs, some adverts among them."""
    word = lambda n: " ".join(rng.choice(["oak", "elm", "ash", "fir", "yew"]) for _ in range(n))
    part = lambda: f"<p>{word(rng.randint(1, 30))} <i>{word(1)}</i></p>" if rng.random() < 0.7 else f'<div class="ad">{word(rng.randint(1, 9))}</div>'
    menu = "".join(f"<li><a href=x>{word(1)}</a></li>" for _ in range(rng.randint(1, 9)))
    return f"<body><nav><ul>{menu}</ul></nav>{''.join(part() for _ in range(rng.randint(1, 12)))}<ul>{menu}</ul><footer>{word(8)}</footer></body>"


def test_extract_is_the_best_of_all_regions():
    m, rng = model(), random.Random(3)
    for _ in range(60):
        page = generated(rng)
        parts = blocks(page)
        scores = m.scores(parts)
        total = lambda a, z: sum(own + (before if i else 0) for i, (before, own) in enumerate(scores[a:z]))  # noqa: B023, E731
        spans = [(a, z) for a in range(len(parts)) for z in range(a + 1, len(parts) + 1)]
        best = max(total(*s) for s in spans)
        texts = {" ".join(b.text for b, (_, own) in zip(parts[a:z], scores[a:z]) if own > 0) for a, z in spans if abs(total(a, z) - best) < 1e-9}
        assert m.extract(page) in texts


def test_what_is_learned_and_the_scan_decide():
    fitted, blank = model(), ContentModel()
    page = PAGE.format(n=5)
    assert blank.extract(page) != fitted.extract(page) == WANT.format(n=5)
    stray = '<div>Login</div><nav><a>m</a></nav>' + "<hr>" * 20 + "<p>" + "main text " * 20 + "</p>"
    everything = " ".join(b.text for b, (_, own) in zip(blocks(stray), fitted.scores(blocks(stray))) if own > 0)
    assert "Login" in everything and fitted.extract(stray) == ("main text " * 20).strip()
    total = Counter()
    for n in range(20):
        total.update(page_counts(f'<div class="zork">buy the thing number {n}</div><article><p class="zink">story of {n} told in full</p></article>'))
    m = fit_counts(total)
    assert m.extract('<div class="zork">offer of the day</div><p class="zink">a tale told</p>') == "a tale told"


def test_nothing_else_of_the_article_goes():
    m = model()
    page = '<article><p class="alert">A a</p><p class="social-science">B</p><p>C <math><mi>x</mi></math></p><svg><text>T</text></svg><noscript>n</noscript><canvas>c</canvas><ul><li>l</li></ul><p>wo<span class="hl">rd</span></p><br><br><br>z</article><p>beyond it</p>'
    assert m.extract(page) == "A a B C x T n c l word z"
    assert m.extract('<p>wo<span class="hl">rd</span> and more</p>') == "word and more"


def test_unclosed_markup_is_read_in_linear_time():
    for page in ("<div>" * 100_000 + "x", "<div class=a>x" * 30_000, "<b>x" * 50_000 + "</i>" * 50_000, "<p><div><b>" * 30_000 + "<li>x" * 30_000):
        start = time.time()
        blocks(page)
        assert time.time() - start < 6
    assert re.sub("x", "", "".join(b.text for b in blocks("<div class=a>x" * 3000))) == ""
