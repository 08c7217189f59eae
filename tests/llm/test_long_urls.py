"""URL filters on very long URLs and on columns with names of their own."""

import time

from crosswalk.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b.c", "/x", "block"), ("org", "/deep/er/path", "block"), ("org", "", "allow")]


def slow_judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end].lower(), rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_long_urls_are_linear(spark):
    long = ["http://www.example.net/" + "en/" * 350_000, "http://" + "a." * 500_000 + "net/x", "http://org/" + "deep/" * 200_000, "x" * 1_000_000, "http://a.b.c/" + "x" * 1_000_000,
            "http://x.a.b.c/xy?" + "q/" * 500_000, "http://deep.org/deep/er/pathology", "http://B.C/x", "http://a.b.c", None, "", "http://", "http://net", "http://net/"]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(u, "mine", "own", i) for i, u in enumerate(long)] * 2, "__url string, __url_best string, __best string, n int").repartition(2)
    start = time.perf_counter()
    rows = urls.judge_urls(pages, rules, url="__url").collect()
    assert time.perf_counter() - start < 30
    assert rows[0].__fields__ == ["__url", "__url_best", "__best", "n", "host", "path", "rule", "verdict"]
    assert sorted(r.n for r in rows) == sorted([*range(len(long))] * 2)
    for r in rows:
        assert (r["__url"], r["__url_best"], r["__best"]) == (long[r.n], "mine", "own")
        assert (r.host, r.path, r.rule, r.verdict) == slow_judge(long[r.n]), r.n
