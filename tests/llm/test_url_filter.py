import random

from tessera.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.net", "/es/x/", "allow"),
         ("a.net", "/es/x/", "block"), ("b.a.net", "/e", "block"), (None, "/", "block")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return host, tail[:end]


def brute(url, default):
    host, path = split_url(url)
    best = None
    for h, p, v in RULES:
        if h is None or not (host == h or host.endswith("." + h) or h == "") or not path.startswith(p):
            continue
        best = max(best or (), (len(h) + len(p), len(h), v, h + p)) if best else (len(h) + len(p), len(h), v, h + p)
    return (host, path, best[3], best[2]) if best else (host, path, None, default)


def judged(spark, rows, default="allow"):
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in rows],
                                  "page_id long, url string, host string, verdict string, n int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_filter.judge_urls(pages, rules, default=default)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, out.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    hosts = ["com", "EXAMPLE.com", "www.example.com", "x.www.Example.COM", "notexample.com", "net", "a.net",
             "b.a.net", "c.b.a.net", "example.com.", ".com", "com:80", "", "é.net", "a..net", "org"]
    paths = ["", "/", "/en/", "/en/1", "/en", "/es/x/y", "/es/x", "/fr/?q=/en/", "/e#/en/", "?x=/en/", "/EN/1"]
    rows = [(rng.choice([None, *range(9)]), rng.choice(["http://", "ftp://", "a://b://", ""]) + rng.choice(hosts)
             + rng.choice(paths)) for _ in range(300)]
    rows += [(1, None), (1, ""), (None, None), (2, "http://" + "a." * 300 + "example.com/en/" + "z" * 9000)]
    rows += [(7, "https://hot.example.com/en/1")] * 150
    want = sorted([(i, *brute(u, "block")) for i, u in rows], key=str)
    assert judged(spark, rows, "block") == want


def test_empty_tables(spark):
    assert judged(spark, []) == []
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.range(1).selectExpr("'com' host", "'/' path", "'block' verdict")
    plan = url_filter.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
