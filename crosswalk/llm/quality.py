"""Quality rules as a short-circuit cascade.

Each rule says when a text is rejected. On a sample every rule's cost and rejection rate are measured, and the rules
are asked in the order of rejections per second: most texts that go are gone after cheap questions. The order never
changes a verdict. Everything is a column expression.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import words

WINDOW = 8
SAMPLE_DOCS = 1000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, and only where the result is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found at two or more places, compared by 64-bit hash."""
    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def starts(s: Column) -> Column:
            again = F.transform(s, lambda x, k: F.when(
                (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h), x.i))
            return F.sort_array(F.array_compact(again))
        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
        return let(ranked, lambda s: let(starts(s), total))

    # single elements: slice() copies the whole array for each window
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    none = F.lit(0).cast("long")
    return F.when(F.size(w) <= window, none).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


@dataclass(frozen=True)
class Facts:
    """What rules may ask for. Each is a column: an expression over the text, or a column already measured."""
    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


def facts(text: Column, w: Column) -> Facts:
    return Facts(text, w, F.size(w).cast("long"), word_chars(w), symbol_count(text), duplicate_lines(text), repeated_words(w))


def _letters(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, rf"\P{{{kind}}}+", ""))


#: The two rules of the base verdict.
BASE_RULES: dict[str, Callable[[Facts], Column]] = {
    "too_short": lambda f: f.n_words < 20,
    "repetition": lambda f: F.lit(100) * f.n_repeat_words > F.lit(30) * f.n_words,
}
#: The further rules of the method.
RULES: dict[str, Callable[[Facts], Column]] = {
    "symbols": lambda f: F.lit(100) * f.n_symbols > F.lit(10) * f.n_words,
    "word_length": lambda f: (f.word_chars < F.lit(2) * f.n_words) | (f.word_chars > F.lit(15) * f.n_words),
    "duplicate_lines": lambda f: F.lit(2) * f.n_dup_lines > F.size(_lines(f.text)),
    "exclamations": lambda f: F.lit(100) * F.regexp_count(f.text, F.lit("!")) > F.lit(30) * f.n_words,
    "capitals": lambda f: F.lit(2) * _letters(f.text, "Lu") > _letters(f.text, "L"),
    "few_letters": lambda f: F.lit(2) * F.size(F.filter(f.words, lambda x: x.rlike(r"\p{L}"))) < f.n_words,
}


@dataclass(frozen=True)
class Step:
    name: str
    seconds_per_doc: float
    rejected: float


def plan_cascade(docs: DataFrame, rules: dict[str, Callable[[Facts], Column]], text: str = "text",
                 sample_docs: int = SAMPLE_DOCS) -> list[Step]:
    """The rules by rejections per second, both measured on ``sample_docs`` rows. Only verdicts of the sample reach the
    driver. The sample decides the order alone, never a verdict."""
    t = F.coalesce(F.col(text), F.lit(""))
    f = facts(F.col("t"), F.col("w"))

    def timed(question: Column) -> tuple[float, float]:
        start = time.perf_counter()
        rows = docs.select(t.alias("t")).withColumn("w", words(F.col("t")))  # words once for each text, where asked for
        got = rows.select(question.alias("answer")).limit(sample_docs).collect()
        return (time.perf_counter() - start) / max(len(got), 1), sum(bool(r[0]) for r in got) / max(len(got), 1)

    timed(F.length("t") < 0)
    idle = timed(F.length("t") < 0)[0]
    steps = []
    for name, rule in rules.items():
        seconds, rejected = timed(rule(f))
        steps.append(Step(name, max(seconds - idle, 1e-9), rejected))
    return sorted(steps, key=lambda s: (-s.rejected / s.seconds_per_doc, s.seconds_per_doc, s.name))


def cascade(f: Facts, rules: dict[str, Callable[[Facts], Column]], order: list[Step]) -> Column:
    """True where no rule rejects. A rule is asked only where those before it did not reject."""
    rejections = [rules[step.name](f) for step in order]
    verdict = F.when(rejections[0], F.lit(False))
    for rejection in rejections[1:]:
        verdict = verdict.when(rejection, F.lit(False))
    return verdict.otherwise(F.lit(True))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``key``, the measures, ``base_failed`` and ``kept``, one row per row of ``docs``.

    A null text counts as empty: no words, so it fails the base rules. Null keys stay null, repeated rows stay apart, and no
    other column is looked at."""
    order = plan_cascade(docs, RULES, text, sample_docs)
    split = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    f = facts(F.col("t"), F.col("w"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measured = split.select("key", "t", "w", *[getattr(f, n).alias(n) for n in names])
    known = Facts(F.col("t"), F.col("w"), *[F.col(n) for n in names])
    base = BASE_RULES["too_short"](known) | BASE_RULES["repetition"](known)
    return measured.select(F.col("key").alias(key), *names, base.alias("base_failed"),
                           F.when(base, F.lit(False)).otherwise(cascade(known, RULES, order)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, base rules included, all columns as they are."""
    rules = BASE_RULES | RULES
    order = plan_cascade(docs, rules, text, sample_docs)
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.filter(let(t, lambda own: let(words(own), lambda w: cascade(facts(own, w), rules, order))))
