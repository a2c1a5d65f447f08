"""Verdicts against plain Python for random rules and urls, with many ranges and hot hosts."""

import random

from folioscope.llm import rangejoin

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(LOWER), rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def brute(url, rules):
    host, path = parts(url)
    best = None
    for h, p, v in rules:
        if h is None or p is None:
            continue
        h = h.translate(LOWER)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h) + len(p), len(h), v == "block")
            if best is None or rank > best[0]:
                best = (rank, h + p, v)
    return host, path, best and best[1], best[2] if best else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in rangejoin.judge(pages, table).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_random_rules_and_a_hot_host(spark):
    random.seed(6)
    labels = ["a", "b", "com", "net", "x-y", "aa"]
    host = lambda: ".".join(random.choice(labels) for _ in range(random.randint(1, 4)))
    path = lambda: "/" + "/".join(random.choice(["", "p", "pp", "q"]) for _ in range(random.randint(0, 3)))
    rules = [(host(), path(), random.choice(["allow", "block"])) for _ in range(120)] + [(None, "/", "block"), ("a.com", None, "block")]
    urls = [f"http://{host()}{path()}?q#f" for _ in range(500)] + ["HTTPS://A.com/p"] * 300
    check(spark, urls, rules)


def test_edge_rows(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]
    urls = [
        None, "", "no scheme", "http://", "http://?x", "http://example.com", "http://Example.COM/en/a/b?c",
        "http://www.example.com/en/", "http://notexample.com/en/", "ftp://a.example.com/en/x#y", "x://com/" + "y" * 50000,
        "http://..com/", "http://example.com./en/",
    ]
    check(spark, urls, rules)
    check(spark, urls, [])
    pages = spark.createDataFrame([], "page_id long, url string")
    assert rangejoin.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
