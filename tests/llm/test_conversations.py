"""Conversation repair against a search through all edits."""

import random
import re
import zlib
from functools import lru_cache

import pytest

from crosswalk.llm import conversations
from crosswalk.llm.queries import QUERIES
from llm_helpers import sha

SCHEMA = "conv_id long, turn long, role string, text string, k string, marker long"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def slow_edits(rows):
    """Cheapest edits of ``(initial, must go, truncated)``, least in ASCII order, from the end backwards. ``done``: the last initial."""
    @lru_cache(None)
    def best(i, done, inserts):
        ways = [(0, "")] if i == len(rows) and done in ("", "a") else []
        following = {"": "u", "s": "u", "u": "a", "a": "u"}[done]
        if inserts < 3:
            cost, audit = best(i, following, inserts + 1)
            ways.append((cost + 2, "I" + audit))
        if i < len(rows):
            initial, gone, cut = rows[i]
            cost, audit = best(i + 1, done, 0)
            ways.append((cost + 3, "D" + audit))
            if not gone:
                if initial == following or (done == "" and initial == "s"):
                    cost, audit = best(i + 1, initial, 0)
                    ways.append((cost + cut, "K" + audit))
                cost, audit = best(i + 1, following, 0)
                ways.append((cost + 2 + cut, "R" + audit))
        return min(ways, default=(10**9, ""))
    return best(0, "", 0)


def slow_report(rows):
    """Rows of one conversation as ``turn, role, text``."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], zlib.crc32(r[2].encode())))
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    cost, audit = slow_edits(tuple(kinds))
    lines, left, state = [], list(rows), ""
    for edit in audit:
        row = None if edit == "I" else left.pop(0)
        if edit == "D":
            continue
        state = row[1][0] if edit == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        lines.append((row[1] if edit == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + ("" if row is None else row[2]))
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines))), lines


def slow_reports(rows, damage=True):
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in slow_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        groups[conv].append((turn, role, text))
    return {(conv, *slow_report(members)[0]) for conv, members in groups.items()}


def sample(n, seed, roles=("user", "assistant", "system", "tool", "", None, "agent")):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rnd.randint(-2, 3)
        for _ in range(rnd.randint(0, 9)):
            turn += rnd.choice([1, 1, 1, 2])
            text = rnd.choice(["Yes.", "No", "Why? ", " \t\n", None, "", "Go on!\n", "cut off", f"{rnd.random()}.", "Ünï ∑."])
            rows.append((conv, turn, rnd.choice(roles[:2] if rnd.random() < 0.7 else roles), text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (n, None, "user", "One?"), (n, 4, "assistant", "Two."), (n + 1, None, "system", "S.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(5)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_reports_equal_the_search(spark):
    rows = sample(300, 1)
    assert found(conversations.repair_reports(frame(spark, rows))) == slow_reports(rows, damage=False)


def test_query_equals_the_search(spark, tmp_path):
    rows = sample(400, 2)
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = found(QUERIES["op13_conversation_repair"](spark, str(tmp_path))), slow_reports(rows)
    assert got == want and any(r[7] == "" for r in want) and len(want) == len({r[0] for r in rows})


def test_every_short_conversation():
    """All sequences of up to four rows over every kind of row."""
    kinds = [(i, g, c) for i in ("s", "u", "a", "") for g, c in ((False, False), (False, True))] + [("u", True, False)]
    texts = {(False, False): ".", (False, True): "x", (True, False): ""}
    def all_of(n):
        return [()] if not n else [(*s, k) for s in all_of(n - 1) for k in kinds]
    steps = conversations.Steps()
    for rows in [r for n in range(5) for r in all_of(n)]:
        c = conversations.Conversation(steps, 1 << 20)
        for initial, gone, cut in rows:
            c.add({"s": "system", "u": "user", "a": "assistant", "": "tool"}[initial], texts[gone, cut], None, False)
        audit = c.audit()
        assert (c.cost, audit) == slow_edits(rows), rows
    assert len(steps.stages) < 2000


def test_giant_conversation_spills_and_crosses_batches(spark):
    rnd = random.Random(4)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"Text {t} {'x' * 50}" + rnd.choice([".", ""])) for t in range(30_000)]
    rows += [(2, 0, "user", "A."), (2, 1, "assistant", "B.")]
    small, large = (found(conversations.repair_reports(frame(spark, rows), held=h)) for h in (1 << 10, 1 << 28))
    assert small == large
    (giant,) = (r for r in small if r[0] == 1)
    # the same program over whole strings
    best = {"": (0, "")}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    for _, _, role, text in rows[:30_000]:
        now, cut = {}, text[-1] != "."
        for state, (cost, audit) in best.items():
            for many in (0, 1):
                at, c, letters = (follow[state], cost + 2, audit + "I") if many else (state, cost, audit)
                for to, more, letter in ((at, 3, "D"), (follow[at], 2 + cut, "R"), (role[0] if follow[at] == role[0] else None, cut, "K")):
                    if to is not None and (to not in now or (c + more, letters + letter) < now[to]):
                        now[to] = (c + more, letters + letter)
        best = now
    ends = [best[s] for s in ("", "a") if s in best] + [(best["u"][0] + 2, best["u"][1] + "I")]
    assert giant[6:8] == min(ends)


def test_repaired_rows_are_the_digest(spark):
    rows = sample(60, 6)
    lines = {}
    for r in conversations.repaired_rows(frame(spark, rows)).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert (r.from_row is None) == (r.edit == "I")
    for r in conversations.repair_reports(frame(spark, rows)).collect():
        assert sha("\n".join(lines.get(r.conv_id, []))) == r.repaired_sha256


def test_empty_table_text_keys_and_null_columns(spark):
    assert conversations.repair_reports(frame(spark, [])).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "Hm."), ("a", 2, "assistant", "Ja."), (None, None, None, None)],
                                  "name string, n int, by string, said string")
    rows = {r.name: (r.cost, r.audit) for r in conversations.repair_reports(named, "name", "n", "by", "said").collect()}
    assert rows == {"a": (0, "KK"), None: (3, "D")}


@pytest.mark.parametrize("copies", [2, 500])
def test_repeated_rows_are_duplicates(spark, copies):
    rows = [(1, 5, "user", "Same.")] * copies + [(1, 9, "user", "Same."), (1, 7, "assistant", "Other.")]
    (row,) = conversations.repair_reports(frame(spark, rows)).collect()
    assert (row.duplicate, row.audit, row.cost) == (copies, "K" + "D" * (copies - 1) + "KD", 3 * copies)
