"""Near-duplicates, URL filters and the pipeline against plain Python."""

import itertools
import random

import numpy as np

import corpus_pipeline
from crosswalk.llm import quality, simhash, urls
from crosswalk.llm.queries import URL_RULES
from llm_helpers import COLUMNS, TEXTS, documents, empty, fingerprint


def slow_components(prints):
    parent = {p: p for p in prints}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


def test_fingerprints_and_components(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = list(TEXTS)
    for n in range(30):
        base = [rnd.choice(words) for _ in range(60)]
        for m in range(6):
            copy = list(base)
            if m:
                copy[rnd.randrange(60)] = "x"
            texts.append((1000 + 10 * n + m, " ".join(copy)))
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    prints = [(i, fingerprint(t)) for i, t in texts]
    assert sorted(map(repr, prints)) == sorted(repr((r.doc_id, r.fingerprint % 2**64)) for r in rows)
    root = slow_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    for r in rows:
        assert r.component_id == least.get(root[r.fingerprint % 2**64])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_no_link_is_lost_in_crowds(spark):
    """Chains and clouds of fingerprints around a few centres, far above the size that is compared pair by pair."""
    rnd = random.Random(9)
    prints = {0, 2**64 - 1}
    for centre in (rnd.getrandbits(64) for _ in range(4)):
        x = centre
        for _ in range(150):
            prints.add(centre ^ (1 << rnd.randrange(10)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
            x ^= 1 << rnd.randrange(64)
            prints.add(x)
    data = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(p,) for p in data], "fingerprint long")
    edges = simhash.links(distinct)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in edges.collect())
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    wanted = slow_components(prints)
    mine, theirs = {}, {}
    for p in prints:
        mine.setdefault(roots.get(p, p), set()).add(p)
        theirs.setdefault(wanted[p], set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_pivots_never_discard_a_link():
    rnd = random.Random(2)
    a = np.array([rnd.getrandbits(64) for _ in range(500)], np.uint64)
    b = np.array([int(x) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for x in a], np.uint64)
    x, y = simhash.pivot_table(a), simhash.pivot_table(b)
    assert np.abs(x.astype(int) - y.astype(int)).max() <= simhash.RADIUS
    assert (simhash.pivot_keys(x) == simhash.pivot_keys(y)).any(axis=1).all()


def test_keep_one(spark):
    kept = simhash.keep_one(documents(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17]
    assert sum(r.doc_id is None for r in kept) == 2
    assert simhash.keep_one(empty(spark)).count() == 0


def test_long_texts_in_portions(monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 100)
    for _, t in TEXTS:
        if t and len(t) < 5000:
            assert simhash.fingerprint(t.encode()) == fingerprint(t)


def slow_judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
        path = rest[n:]
        path = path[:next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_urls(spark):
    rules = [*URL_RULES, ("a.b.org", "/x", "block"), ("b.org", "", "block"), ("Shop.com", "/p/q", "block"), ("bad", "nopath", "block"),
             ("twice.de", "/", "allow"), ("twice.de", "/", "block"), ("", "/", "block")]
    known = [(h.lower(), p, v) for h, p, v in rules if h and p != "nopath" and (h, v) != ("twice.de", "allow")]
    hosts = ["a.b.org", "b.org", "xb.org", "c.a.b.org", "shop.com", "SHOP.com", "example.net", "example.com", "w.example.com", "net", "twice.de", "é.net", "a..net", ".net"]
    tails = ["", "/", "/en/", "/en", "/de/x", "/fr/?q", "/x", "/xy/z", "/p/q", "/p/qr#f", "?u=/en/", "#a", "/en//", "/\n/x"]
    found = [f"https://{h}{t}" for h in hosts for t in tails] + [None, "", "no scheme", "://net/", "ftp://net://org/fr/", "https://", "https:///en/"] * 2
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(found)], "page_id long, url string, rule string, __n int")
    rows = urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(rows) == len(found)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == slow_judge(found[r.page_id], known), found[r.page_id]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge_urls(pages, none).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), none).count() == 0


def test_pipeline(spark, tmp_path):
    prose = [(100 + n, " ".join(f"{a}{b}{n * 7 + k}" for k, (a, b) in enumerate(itertools.product(("lo", "mi", "ra"), ("ta", "ne", "su", "wo")))) + " und noch viele andere worte mehr als zwanzig am ende") for n in range(6)]
    prose += [(200, prose[0][1]), (201, prose[1][1] + " password=hunter2hunter2hunter2")]
    spark.createDataFrame([(i, t, "de", "s", len(t or "")) for i, t in [*(x for x in TEXTS if x[0] not in (8, 9)), *prose]], ", ".join(COLUMNS.split(", ")[:5])).write.parquet(
        f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.measure(spark.read.parquet(f"{tmp_path}/documents.parquet")).filter("kept").collect()}
    assert set(left) <= good and {100, 101, 201} <= good and 200 not in left and {100, 101, 102} <= set(left)
    assert 201 not in left or left[201].endswith("[SECRET]")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(left)
