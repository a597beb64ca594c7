from mnemospark.llm.urls import RULES, judge_urls, match_rules

SCHEMA = "page_id long, url string, host int, rule string, id string"
MORE = RULES + (("example.org", "/es/a/", "allow"), ("example.org", "/es/a/b", "block"), ("blog.example.org", "/es/", "allow"), (None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("org", "/", "block"))
URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://A.Example.ORG/es/x?q=1", "https://example.org/es/a/b/c#t", "https://example.org/es/a/c",
    "https://blog.example.org/es/a/b", "https://xexample.org/es/", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/en/1",
    "http://x.net/de/", "http://example.org:80/es/", "http://example.org./es/", "x://y://example.org/es/", "http://É.example.org/es/\n", "ftp://com/fr/" + "a" * 3000, "http://a.b.c.d.e.f.org/z", "http://x.com/fr/1",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(-len(h + p), -len(h), h + p, a) for h, p, a in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_judgement_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, u, 1, "r", "x") for i, u in enumerate(URLS)] + [(None, URLS[6], 0, None, None), (6, URLS[6], 0, None, None)], SCHEMA)
    for rules in (RULES, MORE):
        got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
        want = [(p.page_id, *brute(p.url, rules)) for p in pages.collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_zones_in_parts_give_the_same(spark):
    urls = spark.createDataFrame([(i, f"h{i % 7}.example.org", f"/es/a/{'b' * (i % 3)}{i}") for i in range(300)], "id long, host string, path string")
    rules = spark.createDataFrame(MORE, "host string, path string, action string")
    one, many = match_rules(urls, rules), match_rules(urls, rules, rows_per_sweep=20)
    assert sorted(one.collect()) == sorted(many.collect())
    assert one.count() == 300


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert judge_urls(spark.createDataFrame([], SCHEMA), rules).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, rules.limit(0)).collect()] == ["allow"]


def test_hosts_of_very_many_labels_are_judged_as_others(spark):
    long = ".".join("abc"[i % 3] for i in range(100_000))
    urls = [f"http://{long}.example.org/es/x", f"http://{long}/de/", f"http://{long}.com/de/", "http://" + "." * 50_000 + "com/de/", *URLS]
    pages = spark.createDataFrame([(i, u, 1, "r", "x") for i, u in enumerate(urls)], SCHEMA)
    for rules in (RULES, MORE):
        got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
