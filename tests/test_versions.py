"""Places over a table, and advisories as runs of places, against plain versions."""

import random
import time

from pyspark.sql import functions as F

from crosswalk.operators import scan
from crosswalk.operators.places import with_places

PACKAGES, ADVISORIES = "id long, name string, version string", "advisory string, name string, introduced string, fixed string"


def slow_hits(packages, advisories):
    def parts(v):
        numbers = [int(p) for p in v.split(".")]
        while numbers and not numbers[-1]:
            numbers.pop()
        return numbers
    def key(n):
        return n.lower().replace("_", "-").replace(".", "-")
    return sorted((i, a, f"{a} {n}@{v}") for i, n, v in packages if n is not None and v is not None for a, m, f, t in advisories
                  if m is not None and key(m) == key(n) and (f is None or parts(v) >= parts(f)) and (t is None or parts(v) < parts(t)))


def test_places(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, "a", "b", "hot", "hot", "hot"]), rnd.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(7)
    got = with_places(df, [F.col("k"), F.col("v")], "place").collect()
    assert sorted(r.place for r in got) == list(range(3000))
    order = [(r.k is not None, r.k or "", r.v) for r in sorted(got, key=lambda r: r.place)]
    assert order == sorted(order)
    assert with_places(df.limit(0), [F.col("k")], "place").count() == 0


def test_advisories_equal_all_pairs(spark):
    rnd = random.Random(4)
    def version():
        return rnd.choice(["1", "1.0", "1.0.0", "0", "2.5"]) if rnd.random() < 0.3 else f"{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(3)}"
    names = ["lib_a", "Lib-A", "lib.a", "b", "c", None]
    packages = [(i, rnd.choice(names), rnd.choice([None, *[version()] * 9])) for i in range(400)] * 2
    advisories = [(f"A{i % 40}", rnd.choice(names), rnd.choice([None, version()]), rnd.choice([None, version()])) for i in range(60)]
    advisories += advisories[:5] + [("same", "b", "1", "1"), ("back", "b", "2", "1"), (None, "c", None, None)]
    got = scan.match_advisories(spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(advisories, ADVISORIES), ["id"]).collect()
    want = slow_hits(packages, [a for a in advisories if a[0]])
    assert sorted(tuple(r) for r in got if r.advisory) == want and len(want) > 500
    nothing = spark.createDataFrame([], ADVISORIES)
    assert scan.match_advisories(spark.createDataFrame(packages, PACKAGES), nothing, ["id"]).count() == 0


def test_a_package_of_many_versions_and_ranges(spark):
    """A hundred thousand of each: ten thousand million pairs, of which few are hits."""
    n = 100_000
    packages = spark.range(n).select("id", F.lit("hot").alias("name"), F.concat(F.lit("1."), "id").alias("version"))
    advisories = spark.range(n).select(F.concat(F.lit("A"), "id").alias("advisory"), F.lit("HOT").alias("name"), F.concat(F.lit("1."), "id").alias("introduced"),
                                       F.concat(F.lit("1."), F.col("id") + F.col("id") % 4).alias("fixed"))
    start = time.perf_counter()
    counted = {r.d: r["count"] for r in scan.match_advisories(packages, advisories, ["id"]).groupBy(
        (F.col("id") - F.substring("advisory", 2, 9).cast("long")).alias("d")).count().collect()}
    assert time.perf_counter() - start < 120
    assert counted == {d: sum(1 for i in range(n) if i % 4 > d and i + d < n) for d in range(3)}
