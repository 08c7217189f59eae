"""License scans against plain searches."""

import random
import re

from crosswalk.llm import licenses
from crosswalk.llm.license_texts import NOTICES, PHRASES
from crosswalk.llm.queries import QUERIES
from llm_helpers import COLUMNS, TEXTS, documents, empty, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT, APACHE = NOTICES[0][1], NOTICES[3][1]


def words(text):
    return WORD.findall(lower(text or ""))


def slow_base(text):
    w, found = words(text), []
    for label, phrase in PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def edited(text, rnd, share):
    w = text.split()
    for i in rnd.sample(range(len(w)), int(len(w) * share)):
        w[i] = rnd.choice(["", "foo", "foo bar", w[i] + "x"])
    return " ".join(w)


LICENSES = [
    (101, "CC-BY cc by Cc, by cc\nby"), (102, "All rights all rights reserved. reserved all rights"), (103, "the General Public  License"),
    (104, MIT), (105, MIT + " " + APACHE + " All rights reserved"), (106, "Licensed under CC BY-NC 4.0."), (107, "ccby all rights reservedé"),
    (108, "x " * 300_000 + MIT + " y" * 300_000), (109, "general public license " * 5000), (110, MIT[:300]),
    (111, "Übung cc\x00by generál public license"), (112, "the software is provided as is " * 400),
]


def test_statistics_are_longest_runs():
    rnd = random.Random(3)
    templates = [[rnd.randrange(4) for _ in range(rnd.randint(2, 30))] for _ in range(12)]
    a = licenses.Automaton(templates, 5)
    def inside(run, t):
        return [j for j in range(len(t) - len(run) + 1) if t[j:j + len(run)] == run]
    for _ in range(30):
        text = [rnd.randrange(5) for _ in range(60)]
        for i, (state, length) in enumerate(a.statistics(text)):
            best = max(n for n in range(i + 2) if n == 0 or any(inside(text[i + 1 - n:i + 1], t) for t in templates))
            assert length == best
            run = text[i + 1 - length:i + 1]
            if length:
                assert set(a.ends[state]) == {(s, j + length - 1) for s, t in enumerate(templates) for j in inside(run, t)}
            phrases = {s for s in a.phrases[state] if len(templates[s]) <= length}
            assert phrases == {s for s in range(5) if text[max(0, i + 1 - len(templates[s])):i + 1] == templates[s]}


def slow_best_chain(matches, gap):
    """Most words of any chain, by trying every next match."""
    def best(i):
        at, place, n = matches[i]
        more = 0
        for b, q, m in matches:
            over = max(0, at + n - b, place + n - q)
            if at < b and place < q and over < m and b - at - n <= gap and q - place - n <= gap:
                more = max(more, best(matches.index((b, q, m))) - over)
        return n + more
    return max(best(i) for i in range(len(matches)))


def test_chains():
    rnd = random.Random(8)
    for _ in range(300):
        matches = list({(rnd.randrange(40), rnd.randrange(40), rnd.randint(4, 9)) for _ in range(rnd.randint(1, 9))})
        found = licenses.chains(matches, 6)
        assert max(f[2] for f in found) == slow_best_chain(matches, 6)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert licenses.chains([], 5) == []


def test_base_places_equal_plain_search(spark, tmp_path):
    rnd = random.Random(2)
    bits = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "x"]
    texts = TEXTS + LICENSES + [(1000 + i, rnd.choice([" ", "-", ". "]).join(rnd.choices(bits, k=rnd.randint(0, 200)))) for i in range(60)]
    spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2) for i, t in texts], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op12_license_scans"](spark, str(tmp_path)).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert sorted(map(repr, got)) == sorted(repr((i, *slow_base(t))) for i, t in texts)
    by = {r.doc_id: r for r in rows}
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1 if r.n_base else True
    assert (by[104].labels, by[104].score, by[105].labels, by[106].labels) == ("mit", 1.0, "apache,mit,reserved", "cc-by,cc-by-nc")
    assert by[108].labels == "mit" and by[110].labels == "" and 0.1 < by[110].score < 0.8
    assert by[1].labels == "" and by[1].score < 0.1


def test_spans_of_edited_licences(spark):
    """A licence with every tenth word changed is found where it stands; half of the words changed are too many."""
    rnd = random.Random(5)
    texts, places = [], {}
    for i, (label, notice) in enumerate(NOTICES[:6]):
        head = ["prose"] * rnd.randint(0, 300)
        texts += [(i, " ".join(head) + " " + edited(notice, rnd, 0.06) + " tail" * 50), (100 + i, edited(notice, rnd, 0.5))]
        places[i] = (label, len(head))
    for r in licenses.scan_licenses(documents(spark, texts)).collect():
        spans = [s for s in r.spans if not s.phrase]
        if r.doc_id >= 100:
            assert spans == []
        else:
            label, at = places[r.doc_id]
            (span,) = [s for s in spans if s.label == label and s.matched > 12]
            assert abs(span.start - at) <= 12 and span.end <= r.n_words - 40 and span.share >= 0.8


def test_two_copies_are_two_spans(spark):
    (row,) = licenses.scan_licenses(documents(spark, [(1, f"{MIT} and once more {MIT}")])).collect()
    assert [(s.label, s.share) for s in row.spans] == [("mit", 1.0)] * 2


def test_empty_tables_and_own_templates(spark):
    assert licenses.scan_licenses(empty(spark)).count() == 0
    own = licenses.scan_licenses(documents(spark, [(1, "Do what you like with it, all of you"), (None, None)]), [], [("free", "do what you like with it")])
    rows = {r.doc_id: (r.n_words, [(s.label, s.start, s.end) for s in r.spans], r.score) for r in own.collect()}
    assert rows == {1: (9, [("free", 0, 6)], 1.0), None: (0, [], 0.0)}
