"""Document fingerprints by winnowing.

Every run of ``k`` characters is hashed with a rolling polynomial; of each window of ``w`` neighbouring hashes the smallest is
chosen, the rightmost of equals, and kept with its position. Two texts that share a passage of ``w + k - 1`` characters
share a fingerprint of it, and no shared passage shorter than ``k`` characters counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from crosswalk.session import written

K, WINDOW = 16, 64
#: Bytes of text in a range, characters of a text that tell ranges apart, and rows that show where ranges end.
RANGE_BYTES, HEAD, SAMPLED = 32 << 20, 48, 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_POSITION_BITS = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)


def _rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k code points: sum of point * base^(k-1-i), by doubling, mixed, its upper 40 bits."""
    with np.errstate(over="ignore"):
        done, length, total, power = None, 0, points.astype(np.uint64) + np.uint64(1), _BASE
        size, rest = 1, k
        while rest:
            if rest & 1:
                if done is None:
                    done, length = total, size
                else:  # what is done, followed by the next run of this size
                    n = len(points) - length - size + 1
                    done, length = done[:n] * power + total[length:length + n], length + size
            rest >>= 1
            if rest:
                n = len(points) - 2 * size + 1
                total = total[:n] * power + total[size:size + n]
                power, size = power * power, 2 * size
        done = (done ^ (done >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (done ^ (done >> np.uint64(29))) >> np.uint64(24)


def _window_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by doubling."""
    least, size = keys, 1
    while 2 * size <= w:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = w - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, positions`` chosen from the code points of a text, by position. A text of fewer than k characters has
    the hash of what it has at position 0, an empty one nothing; fewer than ``window`` hashes are one window."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(points))
    chosen, total = [], len(points) - k + 1
    window = min(window, total)
    for at in range(0, total - window + 1, _BLOCK):
        end = min(at + _BLOCK + window - 1, total)
        hashes = _rolling(points[at:end + k - 1], k)
        backwards = _LOW - np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the last has the least key
        least = np.unique(_window_least((hashes << _POSITION_BITS) | backwards, window))
        chosen.append(np.stack([least >> _POSITION_BITS, _LOW - (least & _LOW) + np.uint64(at)]))
    hashes, positions = np.unique(np.concatenate(chosen, axis=1), axis=1)
    order = np.argsort(positions, kind="stable")
    return hashes[order], positions[order].astype(np.int64)


def shown(hashes: np.ndarray, positions: np.ndarray) -> str:
    return ",".join(["%d:%010x" % pair for pair in zip(positions.tolist(), hashes.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; two empty fingerprints are alike."""
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    total = len(x) + len(y) - both
    return both / total if total else 1.0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _is_after(key: Column, head: Column, bound: Column) -> Column:
    """Whether a row stands at a bound or behind it: smaller keys behind larger ones, null keys last, equal keys by text."""
    smaller = F.coalesce(key < bound["key"], key.isNull() & bound["key"].isNotNull())
    return smaller | (key.eqNullSafe(bound["key"]) & (head >= bound["head"]))


def _bounds(sizes: DataFrame, ranges: int | None) -> list[Row]:
    """First rows of ranges with about the same number of bytes, from a sample of about ``SAMPLED`` rows, or 20 of each range."""
    total, n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if ranges is None:
        ranges = max(2 * int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2, total // RANGE_BYTES)
    share = min(1.0, max(SAMPLED, 20 * ranges) / max(n, 1))
    sample = (sizes if share == 1.0 else sizes.sample(share, seed=7)).orderBy(F.col("key").desc_nulls_last(), "head").collect()
    each, filled, found = sum(r.n for r in sample) / ranges, 0, []
    for row in sample:
        bound = Row(key=row.key, head=row.head)
        if filled >= each * (len(found) + 1) and bound != (found[-1] if found else None):
            found.append(bound)
        filled += row.n
    return found


def _place(key: Column, head: Column, bounds: list[Row], kind: str) -> Column:
    """Number of bounds that a row is not before: first among every so many bounds, then among those that follow."""
    if not bounds:
        return F.lit(0)

    def literal(rows: list[Row]) -> Column:
        return F.array(*[F.struct(F.lit(r.key).cast(kind).alias("key"), F.lit(r.head).alias("head")) for r in rows])

    def passed(rows: Column) -> Column:
        return F.size(F.filter(rows, lambda b: _is_after(key, head, b)))
    size = math.isqrt(len(bounds) - 1) + 1
    blocks = [bounds[i:i + size] for i in range(0, len(bounds), size)]
    block = passed(literal([b[0] for b in blocks]))
    return F.when(block == 0, F.lit(0)).otherwise(
        (block - 1) * size + passed(F.get(F.array(*[literal(b) for b in blocks]), block - 1)))


def _firsts(placed: DataFrame, sizes: DataFrame, kind: str) -> DataFrame:
    """The first row of every range, sent to the range before it; the first range follows the last one."""
    tops = {r.chunk: r.key for r in sizes.groupBy("chunk").agg(F.max("key").alias("key")).collect()}
    if not tops:
        return placed.limit(0)
    chunks = sorted(tops)
    before = {chunk: chunks[i - 1] for i, chunk in enumerate(chunks)}

    def at_chunk(values: dict, kind: str) -> Column:
        return F.get(F.array(*[F.lit(values.get(i)).cast(kind) for i in range(chunks[-1] + 1)]), F.col("chunk"))
    of_top = F.col("key").eqNullSafe(at_chunk(tops, kind))
    heads = {r.chunk: r.head for r in sizes.filter(of_top).groupBy("chunk").agg(F.min("head").alias("head")).collect()}
    first = (placed.filter(of_top & (F.col("head") == at_chunk(heads, "string"))).groupBy("chunk").agg(F.min("text").alias("text")))
    return first.select(at_chunk(tops, kind).alias("key"), "text", at_chunk(before, "int").alias("chunk"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW,
                 chunks: int | None = None) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The next document is the one with the next smaller key (rows with equal keys by text); after the last comes the first.
    Keys are of any type that has an order. Null texts are empty, null keys come last. A single row is followed by itself.
    Texts go once through a shuffle into ranges of about ``RANGE_BYTES``, by key and the first ``HEAD`` characters of the text, so that
    equal keys are many ranges; rows that are equal in both are one range, where a repeated row costs no second fingerprint. The
    first row of each range is also sent to the range before it. Keys, heads and sizes are written once to the checkpoint folder.
    The driver sees a sample of about ``SAMPLED`` of those (20 rows of each range if that is more) and a key and a head of each range."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("head", F.substring("text", 1, HEAD))
    sizes = written(rows.select("key", "head", (F.octet_length("text") + 64).cast("long").alias("n")), "fingerprint-sizes")
    bounds = _bounds(sizes, chunks)
    place = _place(F.col("key"), F.col("head"), bounds, kind).cast("int")
    placed = rows.withColumn("chunk", place)
    firsts = _firsts(placed, sizes.withColumn("chunk", place), kind)
    sent = (placed.select("key", "text", "chunk", F.lit(False).alias("borrowed"))
            .unionByName(firsts.select("key", "text", "chunk", F.lit(True).alias("borrowed"))))
    dealt = sent.repartitionById(len(bounds) + 1, F.col("chunk")).sortWithinPartitions(
        "chunk", "borrowed", F.col("key").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last, recorded = None, None

        def record(one: tuple, other: tuple) -> tuple:
            (_, own, (hashes, positions)), (_, following, (next_hashes, _)) = one, other
            new = edited(own, following)
            e_hashes, e_positions = winnow(_points(new), k, window)
            return (len(own), hashlib.sha256(new.encode()).hexdigest(), shown(hashes, positions), shown(e_hashes, e_positions),
                    likeness(hashes, e_hashes), likeness(hashes, next_hashes))
        for batch in batches:
            keys, out = [], []
            for key_, text_, chunk, borrowed in zip(*(c for c in batch.columns)):
                chunk, borrowed = chunk.as_py(), borrowed.as_py()
                if borrowed and (last is None or last[0] != chunk):
                    continue  # only the first borrowed row closes a range
                own = text_.as_py()
                same = last is not None and last[1][1] == own
                row = (key_, own, last[1][2] if same else winnow(_points(own), k, window))
                if last is not None:
                    keys.append(last[1][0])
                    if recorded is None or not same or last[1][1] != recorded[0] or own != recorded[1]:
                        recorded = (last[1][1], own, record(last[1], row))
                    out.append(recorded[2])
                last = None if borrowed else (chunk, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in keys], batch.schema.field(0).type)] + [
                    pa.array(c) for c in zip(*out)], names)
        if last is not None:
            raise RuntimeError("a range without a following row")

    schema = (f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double")
    return dealt.select("key", "text", "chunk", "borrowed").mapInArrow(run, schema).withColumnRenamed("key", key)
