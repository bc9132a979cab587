import random

from siftline.llm import url_filter as U
from siftline.llm.queries import URL_RULES

RULES = "verdict string, rule string, host string, path string"


def parts(url):
    rest = url.partition("://")[2] if url and "://" in url else None
    if rest is None:
        return "", ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute(rows, rules, default):
    out = []
    for page, url in rows:
        host, path = parts(url)
        fits = [(len(r), h.count("."), r, v) for v, r, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=str)


def run(spark, rows, rules, default="allow"):
    pages = spark.createDataFrame([(p, u, "x", "y") for p, u in rows], "page_id long, url string, host string, rule string").repartition(3)
    table = spark.createDataFrame(rules, RULES)
    return sorted(map(tuple, U.filter_urls(pages, table, default=default).collect()), key=str)


ODD = [None, "", "no scheme", "http://", "http:///p", "http://org", "https://org/", "http://a.example.org/es/x", "http://EXAMPLE.org/es/", "http://xexample.org/es/", "http://example.org/en/12?q#f", "http://example.org?x=/es/",
       "ftp://a.b.com/fr/1", "http://com/de/", "http://notcom/de/", "http://u:p@a.com:80/fr/", "a://b://c.com/fr/", "http://日本.org/é", "http://.org/", "http://a..org/x", "http://x.org/" + "p" * 20000, "http://İ.org/"]


def test_contract_rules_on_odd_urls(spark):
    rules = U.parse_rules(URL_RULES)
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://a.org/"), (None, None), (3, "http:///p"), (3, "http:///p")]
    assert run(spark, rows, rules) == brute(rows, rules, "allow")


def test_many_nested_rules_over_many_ranges(spark):
    rng = random.Random(4)
    labels, segments = ["a", "b", "www", "x-y"], ["p", "q", "pq", "p.html"]
    host = lambda: ".".join([rng.choice(labels) for _ in range(rng.randint(0, 3))] + [rng.choice(["com", "org", "co.uk"])])
    path = lambda: "/" + "/".join(rng.choice(segments) for _ in range(rng.randint(0, 4)))
    rules = [(rng.choice(["allow", "block"]), r, r.partition("/")[0], "/" + r.partition("/")[2]) for r in {(host() + path()) for _ in range(200)}]
    rows = [(i, f"http://{host()}{path()}") for i in range(500)] + [(1000 + i, "http://a.com/p/q") for i in range(300)]
    assert run(spark, rows, rules, "block") == brute(rows, rules, "block")


def test_empty_tables(spark):
    rows = [(1, "http://a.org/")]
    assert run(spark, [], U.parse_rules(URL_RULES)) == []
    assert run(spark, rows, []) == [(1, "a.org", "/", None, "allow")]
