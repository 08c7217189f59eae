"""Packing by vector bins: sequences limited in tokens, segments and loss-bearing tokens at once.

Every task packs what it has read, from a pool of bounded size, so nothing is shuffled. A sequence takes the waiting
example whose demand has the largest dot product with the room that is left, each in parts of the limits; so examples rich in
loss meet those rich in prompts, and short ones do not use up the segments. Where cutting is allowed an example is cut to fill
what is left, and a sequence that cannot be filled is divided into lengths that are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crosswalk.llm.tokens import word_encoder

POOL = 1024
END = (1).to_bytes(4, "little")


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Example:
    """Ids as little-endian unsigned 32-bit bytes. The first ``prompt`` ids bear no loss. ``start`` and ``end``: the part that
    is not placed yet."""
    key: object
    ids: bytes
    prompt: int
    start: int
    end: int

    def loss(self, start: int, end: int) -> int:
        return max(0, end - max(start, self.prompt))

    def demand(self) -> tuple[int, int, int]:
        return self.end - self.start, 1, self.loss(self.start, self.end)


@dataclass(frozen=True)
class Piece:
    example: Example
    start: int
    end: int
    sequence: int | None
    offset: int


class Packer:
    """``add`` examples and take the pieces that are placed meanwhile; ``finish`` places the rest."""

    def __init__(self, limits: Limits, cut: bool, first_sequence: int = 0, pool: int = POOL):
        self.limits, self.cut, self.next, self.size = limits, cut, first_sequence, pool
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: list[Example | None] = []
        self.demand = np.zeros((pool, 3))

    def _most(self, e: Example, tokens: int, loss: int) -> int:
        """How many ids from the start of the unplaced part fit."""
        return min(e.end - e.start, tokens, max(0, e.prompt - e.start) + loss)

    def add(self, e: Example) -> Iterator[Piece]:
        if self.cut:
            while (n := self._most(e, self.limits.tokens, self.limits.loss)) and (
                    n == self.limits.tokens or n < e.end - e.start):
                yield from self._close([(e, e.start, e.start + n)])
                e.start += n
        elif e.demand()[0] > self.limits.tokens or e.demand()[2] > self.limits.loss:
            yield Piece(e, e.start, e.end, None, 0)
            return
        if e.start < e.end:
            self.demand[len(self.waiting)] = e.demand()
            self.waiting.append(e)
        if len(self.waiting) == self.size:
            yield from self._drain(self.size // 2)

    def finish(self) -> Iterator[Piece]:
        yield from self._drain(0)

    def _drain(self, leave: int) -> Iterator[Piece]:
        """Fills sequences until ``leave`` examples are waiting."""
        while len(self.waiting) > leave:
            yield from self._close(self._fill())

    def _remove(self, i: int) -> None:
        last = len(self.waiting) - 1
        self.waiting[i], self.demand[i] = self.waiting[last], self.demand[last]
        self.waiting.pop()

    def _fill(self) -> list[tuple[Example, int, int]]:
        room, taken = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float), []
        while self.waiting and room.min() >= 0 and room[0] > 0 and room[1] > 0:
            demand = self.demand[:len(self.waiting)]
            fits = (demand <= room).all(axis=1)
            if fits.any() and not (self.cut and room[1] == 1 and len(taken)):
                i = int(np.argmax(np.where(fits, (demand * self.scale) @ (room * self.scale), -1.0)))
                e, n = self.waiting[i], int(demand[i, 0])
            elif self.cut:
                i = int(np.argmax(demand[:, 0]))
                e = self.waiting[i]
                n = self._most(e, int(room[0]), int(room[2]))
                if not n:
                    break
            else:
                break
            taken.append((e, e.start, e.start + n))
            room -= (n, 1, e.loss(e.start, e.start + n))
            e.start += n
            if e.start == e.end:
                self._remove(i)
            else:
                self.demand[i] = e.demand()
        return taken

    def _close(self, parts: list[tuple[Example, int, int]]) -> Iterator[Piece]:
        """One sequence; or, where cutting is allowed and it is not full, one for each binary digit of its length."""
        total = sum(end - start for _, start, end in parts)
        lengths = [total]
        if self.cut and total != self.limits.tokens:
            lengths = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        parts, k = list(parts), 0
        for length in lengths:
            at = 0
            while at < length:
                e, start, end = parts[k]
                n = min(end - start, length - at)
                yield Piece(e, start, start + n, self.next, at)
                at += n
                if start + n == end:
                    k += 1
                else:
                    parts[k] = (e, start + n, end)
            self.next += 1


SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), cut: bool = True, key: str = "doc_id",
                   text: str = "text", prompt: str | None = None) -> DataFrame:
    """``key`` and one row per piece: where it starts in its document, its length, the CRC of its ids, the document's
    tokens, its sequence, its place there, and the ids as little-endian unsigned 32-bit bytes.

    A document's ids are those of its text by the tokenizer file ``path`` without added special tokens, then id 1; all but the
    first bear loss. With a column ``prompt``, as instruction data has, the ids of the prompt stand before them and bear none (a null
    prompt has no ids); ``limits.loss`` then says how many tokens that bear loss a sequence may have. Null and empty texts are that one id. With ``cut`` every sequence has ``limits.tokens`` ids or a power
    of two. Without, examples stay whole, and one beyond the limits by itself gets no sequence. Sequence ids follow the
    partitions that are read. Null keys stay null and repeated rows stay apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        packer = Packer(limits, cut, TaskContext.get().partitionId() << 33)

        def pieces() -> Iterator[Piece | None]:
            for batch in batches:
                prompts = encoder.column(batch.column(2)) if prompt else repeat(None)
                for k, ids, before in zip(batch.column(0), encoder.column(batch.column(1)), prompts):
                    ids = (before or b"") + ids + END
                    yield from packer.add(Example(k.as_py(), ids, 1 if before is None else len(before) // 4, 0, len(ids) // 4))
            yield from packer.finish()

        def batch_of(rows: list[Piece]) -> pa.RecordBatch:
            ids = [p.example.ids[4 * p.start:4 * p.end] for p in rows]
            columns = [pa.array([p.example.key for p in rows], kinds)] + [pa.array(c, pa.int64()) for c in (
                [p.start for p in rows], [p.end - p.start for p in rows], [zlib.crc32(i) for i in ids],
                [len(p.example.ids) // 4 for p in rows], [p.sequence for p in rows], [p.offset for p in rows])]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())],
                                              ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        rows: list[Piece] = []
        for piece in pieces():
            rows.append(piece)
            if len(rows) == 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    kinds = to_arrow_type(docs.schema[key].dataType)
    columns = [F.col(key).alias("key"), F.col(text).alias("text"), *([F.col(prompt).alias("prompt")] if prompt else [])]
    return (docs.select(*columns).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {SCHEMA}")
            .withColumnRenamed("key", key))
