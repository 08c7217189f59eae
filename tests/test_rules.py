"""Rules by literal factors against every rule asked of every line."""

import random
import re
import time

import pytest

from crosswalk.operators import rules, scan

PATTERNS = ["license", "(?i)License", r"\beval\(", r"\d{3}-\d{4}", "<[a-z]+>", "en\\.$", "^the", "a(?:bc|bd)e", "x?abc+d", "(?i)É", "é+t", "(ab){2,}c", "a|b", r"\Aend", r"end\Z",
            "a(?=b)", "(?<!a)b", "[^a]b", "", "a*", "(?P<q>['\"])x(?P=q)", "(?x) a b c # note", "(?i:AB)c", "b{0,2}ca", r"\s+x", "a++b", "[a]bc", "ab\\.c", "^$", r"(?:\w\s*+)$"]


def slow_scan(listed, text):
    return [(rule, n) for n, line in enumerate(text.split("\n"), 1) for rule, p in listed if re.search(p, line, re.ASCII)]


@pytest.mark.parametrize("pattern, factor", [("(?i)License", "license"), (r"\beval\(", "eval("), ("x?abc+d", "abc"), ("(ab){2,}c", "ab"), ("a|b", ""), ("a(?:bc|bd)e", "ab"),
                                             ("[a]bc", "abc"), ("b{0,2}ca", "ca"), (r"token = \"[0-9a-f]{40}\"", 'token = "'), ("[0-9]+", ""), ("a(?=bcd)e", "ae")])
def test_factors(pattern, factor):
    assert rules.literal_factor(pattern) == factor


def test_hits_equal_all_rules_on_all_lines():
    rnd = random.Random(5)
    listed = [(f"r{i}", p) for i, p in enumerate(PATTERNS)] + [("twice", "abc"), ("twice", "abc")]
    ready = rules.Rules(listed)
    bits = ["a", "b", "c", "ab", "abc", "abd", "e", "É", "é", "t", "\n", "\n", " ", "x", "'x'", "<b>", "123-4567", "License", "eval(", "en.", "the", "end", "\r", "İ", "😀"]
    for text in ["", "\n", "\n\n"] + ["".join(rnd.choices(bits, k=rnd.randint(1, 40))) for _ in range(1500)]:
        assert list(ready(text)) == slow_scan(listed, text), repr(text)


def test_a_hundred_thousand_rules_in_one_pass(spark):
    listed = [(f"r{i}", rf"key_{i}\b" if i % 2 else rf"(?i)Name-{i}=\d+") for i in range(100_000)]
    texts = [(i, f"prose\nkey_{i * 37} and name-{i * 38}=5\n" + "filler words\n" * 200) for i in range(400)] + [(None, None), (7, "")]
    df = spark.createDataFrame(texts, "rule long, text string").repartition(2)
    start = time.perf_counter()
    found = scan.scan_rules(df, spark.createDataFrame(listed, "rule string, pattern string"), ["rule"])
    assert found.columns == ["rule", "rule", "line"]
    got = sorted(tuple(r) for r in found.collect())
    assert time.perf_counter() - start < 60
    want = []
    for i, t in texts:
        for n, line in enumerate((t or "").split("\n"), 1):
            for a in re.findall(r"key_(\d+)\b", line):
                want += [(i, f"r{a}", n)] * (int(a) % 2)
            for a in re.findall(r"name-(\d+)=\d", line):
                want += [(i, f"r{a}", n)] * (int(a) % 2 == 0)
    assert got == sorted(want) and len(got) > 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("Repartition") <= 2
    assert scan.scan_rules(df, [], ["rule"]).count() == 0
