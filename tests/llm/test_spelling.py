"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from crosswalk.llm import spelling
from crosswalk.llm.queries import QUERIES, misspelled
from llm_helpers import COLUMNS, documents, empty, lower

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_counts(rows):
    counts = {}
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def slow_groups(counts):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if edits(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def sample_texts(n, seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abcdeéÿ", k=rnd.randint(5, 9))) for _ in range(40)] + ["colour", "color", "COLOUR", "Ärger", "ärger", "x" * 300]
    texts = []
    for key in range(n):
        words = []
        for _ in range(rnd.randint(0, 120)):
            w = rnd.choice(stems) if rnd.random() < 0.5 else stems[int(rnd.paretovariate(1)) % len(stems)]
            if rnd.random() < 0.4:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice("abcé") + w[at:], w[:at] + rnd.choice("abcé") + w[at + 1:]])
            words.append(w)
        texts.append((key, rnd.choice([" ", "-", "1", "ж"]).join(words)))
    return texts


AWKWARD = [(None, "colour colour colour"), (None, "colour"), (5, None), (5, ""), (6, "ж 12 ∑"), (7, "long" * 50_000), (8, "plain words " * 20_000)]


def groups(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("cell", [16_384, 20])
def test_variants_equal_all_pairs(spark, cell):
    """Also with cells so small that most neighbours lie in others."""
    texts = sample_texts(150, 3) + AWKWARD
    vocabulary = spelling.count_words(documents(spark, texts), change=misspelled)
    expected = slow_groups(slow_counts(texts))
    assert len(expected) > 300 and sum(r[1] is not None for r in expected) > 100
    assert groups(spelling.group_variants(vocabulary, cell=cell)) == expected


def test_a_small_sample_loses_no_pair(spark):
    texts = sample_texts(100, 5)
    vocabulary = spelling.count_words(documents(spark, texts), change=misspelled)
    assert groups(spelling.group_variants(vocabulary, sample=40, cell=16)) == slow_groups(slow_counts(texts))


def test_long_chains_and_hubs(spark):
    """A chain in which every form has a form, and a hub with every word at one edit from it."""
    chain = [("aaaaa" + "b" * i, 3 * 2 ** i) for i in range(20)]
    hub = [("zzzzzz"[:i] + c + "zzzzzz"[i + 1:], 3) for i in range(6) for c in "abcdefghijklmnopqrstuvwxyé"] + [("zzzzzz", 9)]
    vocabulary = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in chain + hub], "word binary, n long")
    rows = groups(spelling.group_variants(vocabulary, cell=32))
    assert rows == slow_groups(dict(chain + hub))
    assert ("aaaaa", "aaaaab", chain[-1][0], 3, 1, 6) in rows


def test_empty_tables_and_keys_of_text(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    assert spelling.spelling_variants(documents(spark, [(1, None), (2, "a b c")])).count() == 0
    named = spark.createDataFrame([("k", "tiger tiger tiger tigers tigers tigers tigers tigers tigers", 1)], "word string, text string, n int")
    assert groups(spelling.spelling_variants(named, key="word")) == {("tiger", "tigers", "tigers", 3, 1, 6), ("tigers", None, "tigers", 6, 1, None)}
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word binary, n long"), times=1)


def test_codes_bound_the_distance():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcéèêz", k=rnd.randint(1, 12))).encode("latin-1") for _ in range(200)]
    v, c = spelling.vectors(words), spelling.codes(spelling.vectors(words))
    for i, j in itertools.combinations(range(200), 2):
        assert int(np.bitwise_count(c[i] ^ c[j])) <= int(np.abs(v[i] - v[j]).sum())


def test_query_over_the_table(spark, tmp_path):
    texts = sample_texts(60, 9) + AWKWARD
    spark.createDataFrame([(k, t, "en", "s", 0, "x", 1, 2) for k, t in texts], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert groups(QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == slow_groups(slow_counts(texts))
