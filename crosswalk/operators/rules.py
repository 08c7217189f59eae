"""Text rules found by literal factors: what each pattern cannot match without is looked for first, for all rules at once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants as ops
from re import _parser

import ahocorasick

_REPEATS = {ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT}
#: Parts of patterns that see the same in a line by itself and in a text, with ``^`` and ``$`` taken by line.
_BY_LINE = {ops.AT_BEGINNING, ops.AT_END, ops.AT_BOUNDARY, ops.AT_NON_BOUNDARY}


_BEYOND = {ops.ASSERT, ops.ASSERT_NOT, ops.GROUPREF_EXISTS, ops.ATOMIC_GROUP, ops.POSSESSIVE_REPEAT}


def literal_factor(pattern: str) -> str:
    """The longest run of characters that is in everything the pattern matches, A-Z in lower case; empty where none is certain."""
    best, run = "", ""

    def walk(parsed) -> None:
        nonlocal best, run
        for op, argument in parsed:
            if op is ops.LITERAL:
                run += chr(argument)
            elif op is ops.SUBPATTERN:
                walk(argument[-1])
            elif op is ops.ATOMIC_GROUP:
                walk(argument)
            elif op is ops.AT or op in (ops.ASSERT, ops.ASSERT_NOT):
                continue  # takes up no characters
            elif op in _REPEATS and argument[0] >= 1:
                walk(argument[2])
                keep, run = run, ""  # what follows stands after the last of the repeats
                best = max(best, keep, key=len)
            else:
                best, run = max(best, run, key=len), ""
            best = max(best, run, key=len)
    walk(_parser.parse(pattern, re.ASCII))
    return best.encode().lower().decode()


def _line_by_line(parsed) -> bool:
    """Whether a match in a line means that the whole text has one, too: nothing looks beyond the match or gives nothing back."""
    for op, argument in parsed:
        if op in _BEYOND or (op is ops.AT and argument not in _BY_LINE):
            return False
        inner = argument[-1] if op is ops.SUBPATTERN else argument[2] if op in _REPEATS else ()
        if not _line_by_line(inner) or (op is ops.BRANCH and not all(map(_line_by_line, argument[1]))):
            return False
    return True


class Rules:
    """Rules ``(rule, pattern)`` ready to scan texts with. Classes such as ``\\d`` and small letters are those of ASCII."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.rules = list(rules)
        self.lines: dict[int, re.Pattern] = {}
        self.texts: dict[int, re.Pattern | None] = {}
        self.everywhere, by_factor = [], {}
        for i, (_, pattern) in enumerate(self.rules):
            factor = literal_factor(pattern)
            if not factor or "\n" in factor:
                self.everywhere.append(i)
            else:
                by_factor.setdefault(factor.encode().decode("latin-1"), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for factor, members in by_factor.items():
            self.automaton.add_word(factor, members)
        if by_factor:
            self.automaton.make_automaton()

    def _line(self, i: int) -> re.Pattern:
        if i not in self.lines:
            self.lines[i] = re.compile(self.rules[i][1], re.ASCII)
        return self.lines[i]

    def _in_text(self, i: int, text: str) -> bool:
        """Whether any line may have the rule; asks the text once where the pattern allows it."""
        if i not in self.texts:
            parsed = _parser.parse(self.rules[i][1], re.ASCII)
            self.texts[i] = re.compile(self.rules[i][1], re.ASCII | re.MULTILINE) if _line_by_line(parsed) else None
        return self.texts[i] is None or self.texts[i].search(text) is not None

    def __call__(self, text: str) -> Iterator[tuple[str, int]]:
        """``rule, line`` of every rule and line that match, by line, then in the order of the rules."""
        wanted: dict[int, set[int]] = {}
        if len(self.automaton):
            data = text.encode().lower()
            line, at = 1, 0
            for end, members in self.automaton.iter(data.decode("latin-1")):
                line, at = line + data.count(b"\n", at, end), end
                wanted.setdefault(line, set()).update(members)
        always = [i for i in self.everywhere if self._in_text(i, text)]
        if not wanted and not always:
            return
        lines = text.split("\n")
        for number in range(1, len(lines) + 1) if always else sorted(wanted):
            for i in sorted(wanted.get(number, set()).union(always)):
                if self._line(i).search(lines[number - 1]) is not None:
                    yield self.rules[i][0], number
