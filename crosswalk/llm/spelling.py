"""Spelling variants: words that one edit turns into much more frequent ones.

A word is a vector of letter counts. One inserted or deleted letter moves the vector by one in one coordinate, a replaced one
by one down and one up, so words at one edit lie within an L1 distance of two. A coarse k-d tree over all words, split at a
bounded sample of them, deals the words out to cells; every word is also sent to the cells that its box of possible
neighbours reaches. In each cell a k-d tree for each pair of lengths (equal, or one apart) is searched for all of them at once:
boxes out of reach are pruned, leaves are compared by a 64-bit code of the counts, and the order of the letters is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import cut_lineage

#: Letters as Latin-1 bytes: runs of them are words, A-Z in lower case; every other byte is a blank.
_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
_AS_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in set(_LETTERS) else 32 for b in range(256))
_PLACE = np.zeros(256, np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))
DIMENSIONS = len(_LETTERS)
#: One bit more or less for each step of a count: two bits of a Gray code for a-z, parities for the others in twelve groups.
_GRAY = np.array([0, 1, 3, 2], np.uint64)
#: Words of the sample that the coarse tree is split at, words a cell shall have, words of a leaf.
SAMPLE, CELL, LEAF = 65_536, 16_384, 48
#: Entries of a task's own counts, and pairs of a cell, before they are passed on or folded.
_HELD, _PAIRS = 400_000, 2_000_000
INDEXED, SAME, LONGER = 1, 2, 4


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, one byte for each code point."""
    return text.encode("latin-1", "replace").translate(_AS_WORDS).split()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3,
                change: Callable[[object, Counter], Iterable[tuple[bytes, int]]] | None = None) -> DataFrame:
    """``word, n``: words of at least ``shortest`` letters found ``least`` times or more in all whole texts, as Latin-1 bytes.
    ``change`` may turn the counted runs of one text into others. Null texts have no words, null keys are passed on,
    repeated rows count again. Counted per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                if not t.is_valid:
                    continue
                counted = Counter([w for w in runs(t.as_py()) if len(w) >= shortest])
                for w, n in change(k.as_py(), counted) if change else counted.items():
                    if len(w) >= shortest:
                        total[w] = total.get(w, 0) + n
                if len(total) >= _HELD:
                    yield flush()
        if total:
            yield flush()
    return (docs.select(key, text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least))


def letters(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts of words of any lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = _PLACE[np.frombuffer(b"".join(words), np.uint8)]
    at = np.repeat(np.arange(len(words)), sizes) * DIMENSIONS + flat
    return np.bincount(at, minlength=len(words) * DIMENSIONS).reshape(len(words), DIMENSIONS).astype(np.int32)


def codes(v: np.ndarray) -> np.ndarray:
    """64 bits of each vector; vectors at an L1 distance of d differ in d bits at most."""
    out = np.zeros(len(v), np.uint64)
    for i in range(26):
        out |= _GRAY[v[:, i] & 3] << np.uint64(2 * i)
    for g in range(12):
        out |= (v[:, 26 + g::12].sum(axis=1) & 1).astype(np.uint64) << np.uint64(52 + g)
    return out


def _split(v: np.ndarray) -> tuple[int, int] | None:
    """The coordinate with the largest variance and a bound that leaves vectors on both sides; None where all are equal."""
    spread = v.var(axis=0)
    c = int(spread.argmax())
    if spread[c] == 0:
        return None
    column = v[:, c]
    bound = int(np.median(column))
    return c, bound if bound < column.max() else bound - 1


@dataclass
class Reach:
    """Words on their way down a tree: which, their coordinates, and whether one count may still be one more or one less."""
    at: np.ndarray
    up: np.ndarray
    down: np.ndarray

    def sides(self, column: np.ndarray, bound: int) -> tuple[Reach, Reach]:
        """What reaches the vectors up to ``bound`` and those above; ``column`` has the coordinate of every word."""
        x = column[self.at]
        low, rise, fall = x <= bound, (x == bound) & self.up, (x == bound + 1) & self.down
        def joined(stay: np.ndarray, cross: np.ndarray, up: bool) -> Reach:
            return Reach(np.concatenate([self.at[stay], self.at[cross]]),
                         np.concatenate([self.up[stay], np.zeros(cross.sum(), bool) if up else self.up[cross]]),
                         np.concatenate([self.down[stay], self.down[cross] if up else np.zeros(cross.sum(), bool)]))
        return joined(low, fall, False), joined(~low, rise, True)


def coarse_tree(sample: list[bytes], cells: int) -> list[tuple]:
    """Nodes ``(coordinate, bound, left, right)`` of a tree with about ``cells`` leaves, ``(cell,)``; node 0 is the root. The last
    coordinate is the length."""
    nodes: list[tuple] = []
    table = np.zeros((0, DIMENSIONS + 1), np.int32)
    if sample:
        v = vectors(sample)
        table = np.concatenate([v, v.sum(axis=1, keepdims=True)], axis=1)
    share, found = max(8, len(sample) / max(1, cells)), 0

    def grow(at: np.ndarray) -> int:
        nonlocal found
        me = len(nodes)
        nodes.append(())
        split = _split(table[at]) if len(at) > share * 1.5 else None
        if split is None:
            nodes[me] = (found,)
            found += 1
        else:
            low = table[at, split[0]] <= split[1]
            nodes[me] = (*split, grow(at[low]), grow(at[~low]))
        return me
    grow(np.arange(len(table)))
    return nodes


def visited(nodes: list[tuple], table: np.ndarray, up: bool, down: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Cells and the words (rows of ``table``, letter counts and the length looked for) whose boxes reach them."""
    n = len(table)
    stack = [(0, Reach(np.arange(n), np.full(n, up), np.full(n, down)))]
    while stack:
        node, here = stack.pop()
        if not len(here.at):
            continue
        if len(nodes[node]) == 1:
            yield nodes[node][0], here.at
            continue
        c, bound, left, right = nodes[node]
        if c == DIMENSIONS:  # the length looked for is fixed
            low = table[here.at, c] <= bound
            sides = [Reach(here.at[s], here.up[s], here.down[s]) for s in (low, ~low)]
        else:
            sides = here.sides(table[:, c], bound)
        stack += [(left, sides[0]), (right, sides[1])]


def deal(vocabulary: DataFrame, nodes: list[tuple]) -> DataFrame:
    """``cell, word, n, flags``: each word where it is indexed, and where it looks for words of its length (cells after its own;
    the earlier ones look for it) and of one letter more."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 8192):
                batch = whole.slice(first, 8192)
                v = vectors(batch.column(0).to_pylist())
                size = v.sum(axis=1, keepdims=True)
                n = len(v)
                own = np.zeros(n, np.int64)
                for cell, at in visited(tree, np.concatenate([v, size], axis=1), False, False):
                    own[at] = cell
                rows, cells, flags = [np.arange(n)], [own], [np.full(n, INDEXED | SAME)]
                for cell, at in visited(tree, np.concatenate([v, size], axis=1), True, True):
                    at = at[own[at] < cell]
                    rows.append(at), cells.append(np.full(len(at), cell)), flags.append(np.full(len(at), SAME))
                for cell, at in visited(tree, np.concatenate([v, size + 1], axis=1), True, False):
                    rows.append(at), cells.append(np.full(len(at), cell)), flags.append(np.full(len(at), LONGER))
                place = np.concatenate(rows) * len(tree) + np.concatenate(cells)
                places, where = np.unique(place, return_inverse=True)
                joined = np.zeros(len(places), np.int64)
                np.bitwise_or.at(joined, where, np.concatenate(flags))
                row = pa.array(places // len(tree))
                yield pa.RecordBatch.from_arrays([
                    pa.array((places % len(tree)).astype(np.int32)), batch.column(0).take(row), batch.column(1).take(row),
                    pa.array(joined.astype(np.int32))], ["cell", "word", "n", "flags"])
    return vocabulary.select("word", "n").mapInArrow(run, "cell int, word binary, n long, flags int")


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters of equal length differ in one place, or those of ``b`` have one letter more than those of ``a``."""
    length = a.shape[1]
    if length == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :length], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= length


def near_pairs(indexed: np.ndarray, queries: np.ndarray, v: np.ndarray, code: np.ndarray, spelled: dict[int, np.ndarray],
               row: np.ndarray, size: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, indexed) at one edit: ``indexed`` words are of one length, ``queries`` all of that or all of one letter less.
    With ``own`` lengths are equal and of two indexed words only the later is found by the earlier one. All
    arguments are numbers of rows of ``v``, ``code``, ``row`` (place in ``spelled[size]``)."""
    if not len(indexed) or not len(queries):
        return
    target, source = spelled[size[indexed[0]]], spelled[size[queries[0]]]
    bits = 2 if own else 1
    stack = [(indexed, Reach(queries, np.ones(len(queries), bool), np.full(len(queries), own)))]
    while stack:
        members, here = stack.pop()
        if not len(here.at):
            continue
        split = _split(v[members]) if len(members) > LEAF else None
        if split is not None:
            c, bound = split
            low = v[members, c] <= bound
            left, right = here.sides(v[:, c], bound)
            stack += [(members[low], left), (members[~low], right)]
            continue
        at = here.at
        step = max(1, (1 << 22) // len(members))
        for k in range(0, len(at), step):
            some = at[k:k + step]
            close = np.bitwise_count(code[some][:, None] ^ code[members][None, :]) <= bits
            if own:
                close &= (members[None, :] > some[:, None]) | ~here_indexed(some, indexed)[:, None]
            q, m = np.nonzero(close)
            q, m = some[q], members[m]
            for j in range(0, len(q), 1 << 18):
                a, b = q[j:j + (1 << 18)], m[j:j + (1 << 18)]
                good = one_edit(source[row[a]], target[row[b]])
                yield a[good], b[good]


def here_indexed(some: np.ndarray, indexed: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(indexed, some), len(indexed) - 1)
    return indexed[at] == some


def _best(to: np.ndarray, other: np.ndarray, counts: np.ndarray, n: np.ndarray, rank: np.ndarray):
    """Of each word in ``to`` (sorted, once): how many others, and the one with the largest count, the smallest of equals."""
    order = np.lexsort((rank[other], -n[other], to))
    to, other, counts = to[order], other[order], counts[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    return to[first], other[first], np.add.reduceat(counts, first) if len(first) else counts


def search_cell(words: list[bytes], n: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of words with neighbours among the pairs this cell answers for, the best neighbour, and how many."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    v = vectors(words)
    code = codes(v)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    row, spelled = np.zeros(len(words), np.int64), {}
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        row[at] = np.arange(len(at))
        spelled[length] = letters([words[i] for i in at], length)
    is_index = flags & INDEXED > 0
    nothing = np.zeros(0, np.int64)
    held, waiting = [(nothing, nothing, nothing)], 0

    def fold() -> None:
        held[:] = [_best(*(np.concatenate(x) for x in zip(*held)), n, rank)]
    for length in np.unique(size[is_index]):
        indexed = np.flatnonzero(is_index & (size == length))
        same = np.flatnonzero((flags & SAME > 0) & (size == length))
        shorter = np.flatnonzero((flags & LONGER > 0) & (size == length - 1))
        for queries, own in ((same, True), (shorter, False)):
            for a, b in near_pairs(indexed, queries, v, code, spelled, row, size, own):
                one = np.ones(len(a), np.int64)
                held += [(a, b, one), (b, a, one)]
                waiting += 2 * len(a)
                if waiting > _PAIRS:
                    fold()
                    waiting = 0
    fold()
    return held[0]


def near_words(vocabulary: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``word, n_near, best, best_n`` of the words with a near word: one inserted, deleted or replaced letter. ``best`` is the near
    word of the largest ``n``, the smallest of equals. ``vocabulary`` (``word`` as Latin-1 bytes, ``n``) has each word once.
    About ``sample`` words at most reach the driver, chosen by hash; every word is indexed, and none is compared by sample."""
    total = vocabulary.count()
    share = max(1, -(-total // sample))
    chosen = vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").collect()
    nodes = coarse_tree(sorted(bytes(r.word) for r in chosen), -(-total // cell))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        words, n = [bytes(w) for w in rows["word"]], rows["n"].to_numpy()
        to, other, many = search_cell(words, n, rows["flags"].to_numpy())
        return pd.DataFrame({"word": [words[i] for i in to], "many": many, "best_n": n[other], "best": [words[i] for i in other]})
    found = deal(vocabulary, nodes).groupBy("cell").applyInPandas(search, "word binary, many long, best_n long, best binary")
    return (found.groupBy("word").agg(F.sum("many").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of each chain of forms, by doubling. A chain's counts at least double with each
    step, so it has fewer steps than a count has bits, and the rounds are fewer than the bits of that."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = cut_lineage(now.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def group_variants(vocabulary: DataFrame, times: int = 2, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word. The form is the best near word if its count is ``times`` (2 or more) times
    the word's or more; the root is where the chain of forms ends, the word itself if it has no form. An empty vocabulary
    gives no rows."""
    if times < 2:
        raise ValueError("forms must be at least twice as frequent, or chains need not end")
    words = cut_lineage(vocabulary)
    near = near_words(words, sample, cell)
    better = F.col("best_n") >= times * F.col("n")
    judged = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best")).alias("form"),
        F.when(better, F.col("best_n")).alias("form_n")))
    ends = roots(judged.filter(F.col("form").isNotNull()).select("word", "form"))
    def shown(c: str) -> Column:
        return F.decode(F.col(c), "ISO-8859-1").alias(c)
    return (judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
            .select(shown("word"), shown("form"), shown("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3,
                      change: Callable[[object, Counter], Iterable[tuple[bytes, int]]] | None = None) -> DataFrame:
    """``group_variants`` over the words of all whole texts; see ``count_words``."""
    return group_variants(count_words(docs, key, text, shortest, least, change))
