"""Exact top-k and URL rules against brute force."""

import math
import random

from fianchetto.llm import topk, url_filter


def brute_top(rows, k, step):
    """By row: rows that share an id are candidates and queries each."""
    held = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, terms) in enumerate(held):
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(terms, t)), c) for m, (c, t) in enumerate(held) if m != n)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 8)
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [9.0]), (None, [1.0]),
             (410, [1.0, 1.0]), (410, [1.0, 1.0]), (410, [0.5, 9.0]), (-20, [0.25] * 6)]
    df = spark.createDataFrame([(i, v, "x", 0.0, 1) for i, v in rows], "vec_id long, embedding array<float>, terms string, score double, qb int").repartition(5)
    got = sorted(map(tuple, topk.top_k(df, query_step=10).collect()))
    assert got == brute_top(rows, 10, 10)
    few = df.where("vec_id < 4")
    assert sorted(map(tuple, topk.top_k(few.where("vec_id >= 0"), query_step=2).collect())) == brute_top(rows[:4], 10, 2)
    assert [r.rank for r in topk.top_k(df.where("vec_id BETWEEN 0 AND 3"), query_step=100).orderBy("rank").collect()] == [1, 2, 3]
    assert topk.top_k(df.limit(0)).collect() == []


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.b.example.com", "", "allow"), ("tie.com", "/x", "allow"), ("TIE.com", "/x", "block"), (None, "/", "block"), ("", "/", "block"), ("nopath.com", None, "block")]
URLS = [None, "", "no scheme", "http://net", "http://net/", "https://WWW.Example.NET/en/1?x=/de/", "ftp://sub.example.net/de/", "http://example.com/de", "http://example.com/de/a",
        "http://x.org/fr/", "http://x.org/FR/", "http://xorg/fr/", "http://a.b.example.com?q", "http://a.b.example.com/de/1", "http://1.a.b.example.com/de/1", "http://t.tie.com/xy#f",
        "http://net:80/", "http:///path", "a://b://net/", "http://example.net/en", "http://nopath.com/", "http://.net/x", "http://" + "a." * 500 + "net/" + "p/" * 2000]


def brute_judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), v, (h + p).lower()) for h, p, v in RULES if h and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[1]) if fits else (host, path, None, "allow")


def test_urls(spark):
    pages = [(i, u, "<html>", "r", "v") for i, u in enumerate(URLS)] + [(None, URLS[4], "", "r", "v"), (1, URLS[5], "", "r", "v"), (1, URLS[5], "", "r", "v")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, rule string, _row string").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    key = lambda r: tuple("" if x is None else f"{x!r}" for x in r)
    got = sorted(map(tuple, url_filter.judge_urls(df, rules).collect()), key=key)
    assert got == sorted([(i, *brute_judge(u)) for i, u, *_ in pages], key=key)
    assert url_filter.judge_urls(df.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
