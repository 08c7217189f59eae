"""Repair of the structure of conversations by a streamed dynamic program.

A conversation should be ``(s?(ua)+)?``: nothing, or turns of a user and an assistant in alternation, after a system turn if
there is one. Rows are dealt out by conversation and sorted by turn; each task streams through its conversations over
Arrow batches and carries the program's four states (nothing yet, after system, after user, after assistant). For each state
it keeps the cheapest edits and, among equals, the least in ASCII order. What comes before a state is a few bits for each
row; these and the texts spill to disk for giant conversations, so memory does not grow with a conversation.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby
from tempfile import SpooledTemporaryFile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_BLANKS = " \t\n\x0b\x0c\r"
_ENDS = ".!?"
_FAR = 1 << 30
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a user or an assistant is added, and after a row is kept, by the row's initial.
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_KEPT = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
#: What may happen up to and with one row: insertions before it, then what becomes of it.
_WORDS = ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]
#: Bytes of texts and backpointers of a conversation that stay in memory, and rows whose backpointers are read back at once.
HELD, _BLOCK = 8 << 20, 1 << 16
#: Repaired rows that are handed on at once.
_BATCH = 2048


def _row_words(state: int, initial: str, must_go: bool, truncated: bool) -> Iterator[tuple[int, int, int]]:
    """``word, state after, cost`` of all that one row allows."""
    for number, word in enumerate(_WORDS):
        now, cost = state, 0
        for _ in word[:-1]:
            now, cost = _NEXT[now], cost + INSERT
        if word[-1] == "D":
            yield number, now, cost + DELETE
        elif not must_go:
            if word[-1] == "R":
                yield number, _NEXT[now], cost + REROLE + truncated * TRUNCATED
            elif now in _KEPT.get(initial, {}):
                yield number, _KEPT[initial][now], cost + truncated * TRUNCATED


class Steps:
    """The program over one row after another. All that matters of the rows before is a ``stage``: the cost of each state
    above the cheapest, and the order of their edits. There are few stages, so each step is looked up once it was made.

    Edits of two states never begin with each other, as they take up the same rows and end with one; so which are less is
    decided by the rows before, and by the row's own edits only between those of one state."""

    def __init__(self):
        self.stages: list[tuple] = [((0, _FAR, _FAR, _FAR), (0, 1, 2, 3))]
        self.number = {self.stages[0]: 0}
        self.made: dict[tuple, tuple[int, int, int]] = {}

    def __call__(self, stage: int, kind: tuple[str, bool, bool]) -> tuple[int, int, int]:
        """The next stage, what was added to the cheapest cost, and the backpointers: for each state six bits, the state before
        and the word."""
        found = self.made.get((stage, kind))
        if found is None:
            found = self.made[stage, kind] = self._make(stage, kind)
        return found

    def _make(self, stage: int, kind: tuple[str, bool, bool]) -> tuple[int, int, int]:
        costs, order = self.stages[stage]
        best: list[tuple | None] = [None] * 4
        for state in range(4):
            if costs[state] < _FAR:
                for word, after, cost in _row_words(state, *kind):
                    way = (costs[state] + cost, order[state], word, state)
                    if best[after] is None or way < best[after]:
                        best[after] = way
        least = min(b[0] for b in best if b)
        ranked = sorted((b[1:3], s) for s, b in enumerate(best) if b)
        place = {s: i for i, (_, s) in enumerate(ranked)}
        key = (tuple(b[0] - least if b else _FAR for b in best), tuple(place.get(s, 4) for s in range(4)))
        if key not in self.number:
            self.number[key] = len(self.stages)
            self.stages.append(key)
        back = sum((b[3] | b[2] << 2) << 6 * s for s, b in enumerate(best) if b)
        return self.number[key], least, back

    def finish(self, stage: int) -> tuple[int, int, int]:
        """``cost, state, insertions`` with which the last rows' edits end at nothing or an assistant."""
        costs, order = self.stages[stage]
        ways = []
        for state in range(4):
            now, inserted = state, 0
            while now not in (_START, _ASSISTANT):
                now, inserted = _NEXT[now], inserted + 1
            if costs[state] < _FAR:
                ways.append((costs[state] + INSERT * inserted, order[state], state, inserted))
        cost, _, state, inserted = min(ways)
        return cost, state, inserted


class Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, steps: Steps, held: int):
        self.steps, self.stage, self.cost, self.rows = steps, 0, 0, 0
        self.backs, self.waiting, self.texts = SpooledTemporaryFile(held), [], SpooledTemporaryFile(held)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before, self.turns, self.first, self.last = None, 0, None, None

    def add(self, role: str, text: str, turn: int | None, again: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.before is not None and (self.before + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        body = text.rstrip(_BLANKS)
        blank, cut = not body, bool(body) and body[-1] not in _ENDS
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        kind = (initial if initial in _KEPT else "", blank or again, cut)
        self.stage, added, back = self.steps(self.stage, kind)
        self.cost += added
        self.rows += 1
        self.waiting.append(back)
        if len(self.waiting) >= _BLOCK:
            self._put_backs()
        one, two = role.encode(), text.encode()
        self.texts.write(b"%s%s%s" % (struct.pack("<qq", len(one), len(two)), one, two))

    def _put_backs(self) -> None:
        self.backs.write(np.array(self.waiting, "<u4").tobytes())
        self.waiting.clear()

    def audit(self) -> str:
        """The cheapest edits, least in ASCII order; ``cost`` is theirs afterwards."""
        more, state, inserted = self.steps.finish(self.stage)
        self.cost += more
        self._put_backs()
        parts, end = ["I" * inserted], self.rows
        while end:
            start = max(0, end - _BLOCK)
            self.backs.seek(4 * start)
            part = []
            for back in reversed(np.frombuffer(self.backs.read(4 * (end - start)), "<u4").tolist()):
                bits = back >> 6 * state & 63
                part.append(_WORDS[bits >> 2])
                state = bits & 3
            parts.append("".join(reversed(part)))
            end = start
        return "".join(reversed(parts))

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str, int | None]]:
        """``edit, role, text, place among the rows`` of what stays."""
        self.texts.seek(0)
        state, row = _START, 0
        for edit in audit:
            role = text = ""
            if edit != "I":
                one, two = struct.unpack("<qq", self.texts.read(16))
                role, text = self.texts.read(one).decode(), self.texts.read(two).decode()
                row += 1
            if edit == "D":
                continue
            state = _KEPT[role[:1]][state] if edit == "K" else _NEXT[state]
            yield edit, role if edit == "K" else _ROLES[state], text, None if edit == "I" else row - 1

    def close(self) -> None:
        self.backs.close()
        self.texts.close()


def _keyed(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with keys that are never null, and what orders the rows of a conversation. Null roles and texts are one blank."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    turn_ = F.col(turn).cast("long")
    return rows.select(
        F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n")).alias("k"), turn_.isNotNull().alias("known"),
        F.coalesce(turn_, F.lit(0)).alias("turn"), role_.alias("role"), F.unhex(F.md5(text_)).alias("digest"), text_.alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows, and before each that has the role and text of one with an earlier turn a marker without text. Found over digests by
    conversation, role and digest, so that a conversation of any size is spread over tasks; copies within one turn stand
    side by side when sorted and need no marker."""
    light = rows.select("k", "role", "digest", F.struct("known", "turn").alias("at"))
    firsts = (light.groupBy("k", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
              .filter("first < last").select("k", "role", "digest", "first"))
    markers = (light.join(firsts, ["k", "role", "digest"]).filter("first < at").select("k", "at.known", "at.turn", "role", "digest")
               .distinct())
    return rows.withColumn("marker", F.lit(0)).unionByName(
        markers.select("*", F.lit(None).cast("string").alias("text"), F.lit(-1).alias("marker")))


REPORT = ("n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
REPAIRED = "place long, edit string, role string, text string, from_row long"


def _stream(rows: DataFrame, key: str, turn: str, role: str, text: str, with_rows: bool, held: int) -> DataFrame:
    keyed = _marked(_keyed(rows, key, turn, role, text))
    dealt = keyed.repartition("k").sortWithinPartitions("k", "known", "turn", "role", "digest", "marker")
    names = ["k", "known", "turn", "role", "digest", "marker", "text"]
    report_names = [c.split()[0] for c in REPORT.split(", ")]
    row_names = [c.split()[0] for c in REPAIRED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = Steps()

        def records() -> Iterator[tuple]:
            for frame in frames:
                yield from zip(*(frame[c].tolist() for c in names))

        def one(k: str, members: Iterator[tuple]) -> Iterator[tuple]:
            conversation = Conversation(steps, held)
            marked = last = None
            for _, known, turn_, role_, digest, marker, text_ in members:
                here = (known, turn_, role_, digest)
                if marker:
                    marked = here
                    continue
                conversation.add(role_, text_, turn_ if known else None, here == marked or here == last)
                last = here
            audit, total = conversation.audit(), hashlib.sha256()
            for place, (edit, role_, text_, row) in enumerate(conversation.repaired(audit)):
                total.update(("\n" if place else "").encode() + f"{role_}:{text_}".encode())
                if with_rows:
                    yield k, place, edit, role_, text_, row
            c = conversation
            gaps = 0 if c.first is None else c.last - c.first + 1 - c.turns
            if not with_rows:
                yield k, c.rows, gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, audit, total.hexdigest()
            c.close()
        waiting = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(waiting, columns=["k", *(row_names if with_rows else report_names)], dtype=object)
            waiting.clear()
            return out
        for k, members in groupby(records(), key=lambda r: r[0]):
            for row in one(k, members):
                waiting.append(row)
                if len(waiting) >= _BATCH:
                    yield frame()
        if waiting:
            yield frame()
    found = dealt.select(*names).mapInPandas(run, f"k string, {REPAIRED if with_rows else REPORT}")
    kind = rows.schema[key].dataType
    return found.select(F.when(F.col("k").startswith("v"), F.expr("substring(k, 2)")).cast(kind).alias(key),
                        *[F.col(c) for c in found.columns if c != "k"])


def repair_reports(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   held: int = HELD) -> DataFrame:
    """One row for each conversation: ``key``, its faults, the cost of the cheapest edits, their letters (``audit``), and the digest
    of the repaired ``role:text`` lines.

    Rows are taken by turn, null turns first; those of one turn by role, then by digest of the text. A row is blank, a
    ``duplicate`` (role and text of an earlier row) or ``truncated`` (no ``.``, ``!`` or ``?`` at its end), whichever holds
    first. Blank and duplicate rows must go. Null roles and texts are one blank; null keys are one conversation. An empty
    table has no conversations. Other columns are left out. Of a conversation only ``held`` bytes stay in memory besides
    its audit, whatever its size; a lost task starts its conversations anew."""
    return _stream(rows, key, turn, role, text, False, held)


def repaired_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  held: int = HELD) -> DataFrame:
    """The repaired conversations: ``key, place, edit, role, text, from_row``. ``edit`` is K (kept), R (given another role) or I (put in,
    without text); ``from_row`` counts the conversation's rows from 0. Taken as in ``repair_reports``."""
    return _stream(rows, key, turn, role, text, True, held)


def with_all(reports: DataFrame, rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``reports`` and, for each key of ``rows`` that has none, the report of a conversation without rows."""
    keys = rows.select(F.col(key).alias("__key")).distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(nothing.get(c, 0))).alias(c)
    joined = keys.join(reports, F.col("__key").eqNullSafe(F.col(key)), "left")
    return joined.select(F.col("__key").alias(key), *[filled(c) for c in reports.columns if c != key])
