"""License scans by a suffix automaton of licence texts.

A generalised suffix automaton holds every run of words of all templates. A text streams through it word by word: the state
tells the longest run of template words that ends there (matching statistics). Runs that cannot be made longer and have at least
``LONG`` words are chained, in the order of both text and template, into spans; a span that covers enough of its template names its
licence. Phrases are templates that have to stand whole: they end where their state, or one that it links to, is reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crosswalk.llm.common import map_rows, with_bytes
from crosswalk.llm.license_texts import NOTICES, PHRASES

#: Words are runs of 0-9, a-z (A-Z in lower case) and all bytes beyond ASCII.
_AS_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
_CHUNK = 1 << 20
#: Least words of a match that is chained, most words left out between two matches of a chain, least share of a template.
LONG, GAP, COVERED = 4, 24, 0.8


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """All words in order, about a megabyte of text at a time."""
    start = 0
    while start < len(data):
        end = min(start + _CHUNK, len(data))
        while end < len(data) and _AS_WORDS[data[end]] != 32:
            end += 1
        yield data[start:end].translate(_AS_WORDS).split()
        start = end


class Automaton:
    """Generalised suffix automaton of sequences of small numbers. ``ends[state]``: each (sequence, last place) where the words of
    the state occur; ``phrases[state]``: the marked sequences that the words of the state end with, longest first."""

    def __init__(self, sequences: list[list[int]], marked: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for s, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, own)
                own[last].append((s, place))
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.ends = own
        for state in reversed(by_length):
            if self.link[state] > 0:
                self.ends[self.link[state]] = sorted({*self.ends[self.link[state]], *self.ends[state]})
        whole: dict[int, list[int]] = {}
        for s in range(marked):
            whole.setdefault(self.state_of(sequences[s]), []).append(s)
        self.phrases: list[tuple[int, ...]] = [()] * len(self.link)
        for state in by_length:
            here = sorted(whole.get(state, ()), key=lambda s: -len(sequences[s]))
            self.phrases[state] = (*here, *self.phrases[self.link[state]])

    def _add(self, length: int, following: dict[int, int], link: int, own: list) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        own.append([])
        return len(self.link) - 1

    def _clone(self, state: int, word: int, old: int, own: list) -> int:
        """The runs of ``old`` that are not longer than those of ``state`` and one word, as a state of their own."""
        new = self._add(self.length[state] + 1, dict(self.next[old]), self.link[old], own)
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int, own: list) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known, own)
        new, state = self._add(self.length[last] + 1, {}, 0, own), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            old = self.next[state][word]
            self.link[new] = old if self.length[old] == self.length[state] + 1 else self._clone(state, word, old, own)
        return new

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """``state, length`` of the longest run that ends at each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            yield state, length


@dataclass(frozen=True)
class Span:
    """Words ``start`` to ``end`` (excluded) of a text; ``matched`` words of the template are there, ``share`` of them all."""
    label: str
    phrase: bool
    start: int
    end: int
    matched: int
    share: float


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """``start, end, matched`` of disjoint chains of the matches ``(place in the text, place in the template, words)`` of one
    template. A chain goes forward in both and leaves out at most ``gap`` words between two matches in either; words that
    two matches of a chain share count once. Chains are taken by most words, then the first."""
    matches = sorted(matches)
    total, before, first = [0] * len(matches), [-1] * len(matches), 0
    reach = max((m[2] for m in matches), default=0) + gap
    for i, (at, place, n) in enumerate(matches):
        total[i] = n
        while matches[first][0] + reach < at:
            first += 1
        for j in range(first, i):
            at_j, place_j, n_j = matches[j]
            over = max(0, at_j + n_j - at, place_j + n_j - place)
            if at_j < at and place_j < place and over < n and at - at_j - n_j <= gap and place - place_j - n_j <= gap \
                    and total[j] + n - over > total[i]:
                total[i], before[i] = total[j] + n - over, j
    found, used = [], [False] * len(matches)
    for i in sorted(range(len(matches)), key=lambda i: (-total[i], matches[i])):
        members, j = [], i
        while j >= 0 and not used[j]:
            members.append(j)
            j = before[j]
        for m in members:
            used[m] = True
        if j < 0 and members:
            start, end = matches[members[-1]][0], matches[i][0] + matches[i][2]
            if all(end <= s or e <= start for s, e, _ in found):
                found.append((start, end, total[i]))
    return sorted(found)


class Scanner:
    """Spans of templates and phrases in texts."""

    def __init__(self, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], long: int = LONG, gap: int = GAP,
                 covered: float = COVERED):
        self.long, self.gap, self.covered = long, gap, covered
        self.labels = [label for label, _ in [*phrases, *notices]]
        self.n_phrases, self.words = len(phrases), {}
        self.templates = [[self.words.setdefault(w, len(self.words)) for chunk in word_chunks(text.encode()) for w in chunk]
                          for _, text in [*phrases, *notices]]
        if any(len(t) < 2 for t in self.templates):
            raise ValueError("a template has two words or more")
        self.automaton = Automaton(self.templates, self.n_phrases)
        self.size = len(self.words) + 1
        pairs = np.zeros((self.size, self.size), bool)  # which words follow each other in templates; the last row is other words
        for t in self.templates:
            pairs[t[:-1], t[1:]] = True
        self.pairs = pairs.ravel()

    def numbers(self, data: bytes) -> np.ndarray:
        get, other = self.words.get, len(self.words)
        parts = [np.fromiter([get(w, other) for w in chunk], np.int32, len(chunk)) for chunk in word_chunks(data)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def __call__(self, data: bytes) -> tuple[int, list[Span], float]:
        """Words of the text, its spans by place, and the largest share of a template that a chain covers."""
        numbers = self.numbers(data)
        joined = np.flatnonzero(self.pairs[numbers[:-1] * self.size + numbers[1:]]) if len(numbers) > 1 else numbers[:0]
        if not len(joined):
            return len(numbers), [], 0.0
        # stretches of words that follow each other in some template; no match of two words or more leaves one
        breaks = np.flatnonzero(np.diff(joined) > 1)
        starts, ends = joined[np.r_[0, breaks + 1]], joined[np.r_[breaks, len(joined) - 1]] + 2
        spans, matches = [], {}
        for start, end in zip(starts.tolist(), ends.tolist()):
            self._stretch(numbers[start:end].tolist(), start, spans, matches)
        score = 1.0 if spans else 0.0
        for s, found in matches.items():
            size = len(self.templates[s])
            for start, end, matched in chains(found, self.gap):
                share = min(1.0, matched / size)
                score = max(score, share)
                if share >= self.covered:
                    spans.append(Span(self.labels[s], False, start, end, matched, share))
        return len(numbers), sorted(spans, key=lambda x: (x.start, x.end, x.label, x.phrase)), score

    def _stretch(self, words: list[int], offset: int, spans: list[Span], matches: dict[int, list]) -> None:
        a, before = self.automaton, (0, 0)
        for i, now in enumerate([*a.statistics(words), (0, 0)]):
            state, length = before
            if now[1] <= length and length >= self.long:  # not made longer by the next word
                for s, last in a.ends[state]:
                    if s >= self.n_phrases:
                        matches.setdefault(s, []).append((offset + i - length, last + 1 - length, length))
            for s in a.phrases[now[0]]:
                n = len(self.templates[s])
                if n <= now[1]:
                    spans.append(Span(self.labels[s], True, offset + i + 1 - n, offset + i + 1, n, 1.0))
            before = now


@lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple, long: int, gap: int, covered: float) -> Scanner:
    """One for each worker process."""
    return Scanner(list(phrases), list(notices), long, gap, covered)


SPANS = "array<struct<label:string,phrase:boolean,start:bigint,end:bigint,matched:bigint,share:double>>"


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, long: int = LONG,
                  gap: int = GAP, covered: float = COVERED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, spans, score`` of every row, without a shuffle.

    A span says its label, whether it is a phrase, its words (``end`` excluded), how many words of the template it has and which share
    of them. All places of phrases are spans, also overlapping ones; chains are where ``covered`` of a template or more is there.
    ``score`` is the largest share of any chain, 1 where a phrase stands. Null and empty texts have no words, null keys stay, repeated
    rows stay apart; whole texts are read, whatever their length."""
    arguments = (tuple(phrases), tuple(notices), long, gap, covered)
    kinds = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
                                ("matched", pa.int64()), ("share", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan = scanner(*arguments)
        found = [scan(data) for data in with_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([[vars(s) for s in f[1]] for f in found], kinds),
            pa.array([f[2] for f in found], pa.float64())], ["key", "n_words", "spans", "score"])
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), run, f"key {kind}, n_words long, spans {SPANS}, score double").withColumnRenamed("key", key)
