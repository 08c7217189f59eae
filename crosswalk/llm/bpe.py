"""Byte-level BPE by segment trees.

A piece of text is an array of byte positions, each the start of a part. A segment tree over the positions holds the rank of
the merge of the part with its right neighbour; the root gives the least rank, the leftmost of equals. A merge removes one
position and gives two live neighbours new ranks, each an update along one path of the tree. Trees of many pieces of one size
class stand side by side in an array and take each step together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_NONE = np.int64(1) << 62
#: Positions of all trees that are built at once.
_AT_ONCE = 1 << 21
#: As many trees as take fewer steps one by one.
_FEW = 24
#: Bytes of the pieces that a worker remembers before it starts anew, what an entry takes besides its key, and the characters
#: of texts that are encoded together.
MEMORY, _ENTRY, _PORTION = 96 << 20, 240, 1 << 22


class Ranks:
    """Tokens by rank and merges by pair of ranks. ``merge`` looks up many pairs at once in an open hash table."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.single = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [(self.rank[t[:i]] << 32 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t))
                 if t[:i] in self.rank and t[i:] in self.rank]
        size = 1 << (4 * len(pairs)).bit_length()
        self.mask, self.keys, self.values = np.int64(size - 1), np.full(size, -1, np.int64), np.full(size, _NONE)
        self.pairs = dict(pairs)
        keys, values = (np.array(x, np.int64) for x in zip(*pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(24)).astype(np.int64) & self.mask

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, ``_NONE`` where the pair does not merge or a side is missing (-1)."""
        keys = left << 32 | right
        out = np.full(len(keys), _NONE)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[open_])
        while len(open_):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            open_, slot = open_[go], (slot[go] + 1) & self.mask
        return out


def _finish(ranks: Ranks, shift: int, tree: list[int], ids: list[int], following: list[int], previous: list[int]) -> list[int]:
    """The rest of the merges of one tree, one after the other: where few trees are left, this is cheaper than steps of arrays."""
    width, none, rank_of = 1 << shift, int(_NONE), ranks.pairs.get

    def update(at: int, value: int) -> None:
        node = at + width
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return  # nothing above it changes either
            tree[node] = least
            node >>= 1

    def pair_value(at: int) -> int:
        after = following[at]
        rank = rank_of(ids[at] << 32 | ids[after]) if after < width and ids[at] >= 0 <= ids[after] else None
        return none if rank is None else rank << shift | at
    while tree[1] < none:
        at = tree[1] & (width - 1)
        gone = following[at]
        ids[at], ids[gone] = tree[1] >> shift, -1
        after = following[at] = following[gone]
        if after < width:
            previous[after] = at
        update(gone, none)
        update(at, pair_value(at))
        before = previous[at]
        if before >= 0:
            update(before, pair_value(before))
    return ids


def _encode_class(ranks: Ranks, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Pieces of at most ``width`` bytes, a power of two."""
    n, shift = len(pieces), width.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    ids = np.where(np.arange(width) < lengths[:, None], ranks.single[flat], -1)
    following = np.tile(np.arange(1, width + 1), (n, 1))
    previous = np.tile(np.arange(-1, width - 1), (n, 1))
    tree = np.full((n, 2 * width), _NONE)
    right = np.concatenate([ids[:, 1:], np.full((n, 1), -1)], axis=1)
    first = ranks.merge(ids.ravel(), right.ravel()).reshape(n, width)
    tree[:, width:] = np.where(first < _NONE, first << shift | np.arange(width), _NONE)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    active = np.flatnonzero(tree[:, 1] < _NONE)

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = value
        for _ in range(shift):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair_value(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = following[rows, at]
        right_ = np.where(after < width, ids[rows, np.minimum(after, width - 1)], -1)
        rank = ranks.merge(ids[rows, at], right_)
        return np.where(rank < _NONE, rank << shift | at, _NONE)
    while len(active):
        if len(active) <= _FEW:
            for i in active.tolist():
                ids[i] = _finish(ranks, shift, tree[i].tolist(), ids[i].tolist(), following[i].tolist(), previous[i].tolist())
            break
        best = tree[active, 1]
        at = best & (width - 1)
        gone = following[active, at]
        ids[active, at] = best >> shift
        ids[active, gone] = -1
        after = following[active, gone]
        following[active, at] = after
        inside = after < width
        previous[active[inside], after[inside]] = at[inside]
        update(active, gone, np.full(len(active), _NONE))
        update(active, at, pair_value(active, at))
        before = previous[active, at]
        some = before >= 0
        update(active[some], before[some], pair_value(active[some], before[some]))
        active = active[tree[active, 1] < _NONE]
    return [row[row >= 0] for row in ids]


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of each piece: its own rank where the whole piece is a token, else by merges."""
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = ranks.rank.get(piece)
        if whole is not None:
            out[i] = np.array([whole], np.int64)
        elif piece:
            classes.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
        else:
            out[i] = np.zeros(0, np.int64)
    for width, members in classes.items():
        step = max(1, _AT_ONCE // width)
        for k in range(0, len(members), step):
            part = members[k:k + step]
            for i, ids in zip(part, _encode_class(ranks, [pieces[j] for j in part], width)):
                out[i] = ids
    return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


class Strings:
    """Byte strings side by side, from which many are taken at once."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, which: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The strings ``which`` one after the other, up to each of ``ends``."""
        sizes = self.sizes[which]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        whole = self.data[np.arange(stops[-1]) + np.repeat(self.firsts[which] - stops[:-1], sizes)].tobytes()
        bounds = stops[np.concatenate([[0], ends])].tolist()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Texts to ids and ids to bytes. Pieces that were seen before are looked up; they take about ``2 * memory`` bytes at most."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        self.ranks, self.split = load_ranks(path), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memory, self.size = memory, 0
        tokens = [self.ranks.token.get(i, b"") for i in range(max(self.ranks.token, default=0) + 1)]
        self.tokens, self.numbers = Strings(tokens), Strings([b"%d," % i for i in range(len(tokens))])

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, as signed 32-bit numbers."""
        out = [self.known.get(p) for p in pieces]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = self.older.get(pieces[i])
        new = [i for i in missing if out[i] is None]
        for i, ids in zip(new, encode_pieces(self.ranks, [pieces[i].encode() for i in new])):
            out[i] = ids.astype("<i4").tobytes()
        for i in missing:
            self.size += _ENTRY + 3 * len(pieces[i])
            if self.size >= self.memory:
                self.older, self.known, self.size = self.known, {}, 0
            self.known[pieces[i]] = out[i]
        return out

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text ends. Every distinct piece is encoded once."""
        split = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array(chain.from_iterable(split), pa.large_string(), size=int(counts.sum())).dictionary_encode()
        found = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy()
        each = sizes[which]
        stops = np.concatenate([[0], np.cumsum(each)])
        ids = np.frombuffer(b"".join(found), "<i4")[np.arange(stops[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - stops[:-1], each)]
        return ids, stops[np.cumsum(counts)]

    def encode(self, text: str) -> list[int]:
        return self.many([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.tokens.join(np.array(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, memory: int) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern, memory)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each row: the ids of its text joined by commas, and the bytes they
    decode to. Null texts are like empty ones: no tokens, as are null keys and repeated rows no special case. A long piece takes time in
    proportion to its length and the logarithm of that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, memory)

        def portion(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
            ids, ends = own.many(texts)
            sums = [hashlib.sha256(x[:-1]).hexdigest() for x in own.numbers.join(ids, ends)]
            backs = [hashlib.sha256(x).hexdigest() for x in own.tokens.join(ids, ends)]
            return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ends, prepend=0)), pa.array(sums), pa.array(backs)],
                                              ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        for batch in batches:
            first, waiting, size = 0, [], 0
            for text in batch.column(1):
                waiting.append(text.as_py() or "")
                size += len(waiting[-1])
                if size >= _PORTION:
                    yield portion(batch.column(0).slice(first, len(waiting)), waiting)
                    first, waiting, size = first + len(waiting), [], 0
            if waiting:
                yield portion(batch.column(0).slice(first), waiting)
    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("key", key))
