"""SimHash near-duplicates found with pivot distance tables.

Every text gets a 64-bit fingerprint of its word shingles. Two fingerprints are linked when at most two bits differ.
For each distinct fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints are tabulated. By the triangle
inequality no coordinate of two linked fingerprints differs by more than the radius, so pairs beyond it are
discarded and only the survivors are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructField, StructType

from crosswalk.llm.common import cut_lineage, map_rows, with_bytes

SEED = 42
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256
_CHUNK = 1 << 20


def _word_runs(data: bytes):
    """Lists of lower-cased words that together are all words of ``data``; a list holds about a megabyte."""
    if len(data) <= _CHUNK:
        yield data.lower().split()
        return
    start = 0
    while start < len(data):
        end = min(start + _CHUNK, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield data[start:end].lower().split()
        start = end


def _bit_sums(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set."""
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + _LANES
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text: bit set where more than half of the shingle hashes have it. Memory stays
    bounded for very long texts. No words: zero. Fewer words than a shingle: the hash of them all."""
    sums, total, last = np.zeros(64, np.int64), 0, []
    for run in _word_runs(data):
        words = last + run
        if len(words) >= shingle:
            hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
            sums += _bit_sums(hashes)
            total += len(hashes)
            last = words[len(words) - shingle + 1:]
        else:
            last = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(sums * 2 > total, bitorder="little").view("<u8")[0])


# ---- pivot tables ----------------------------------------------------------------------------------------------

RADIUS = 2
#: Reference fingerprints: a base, the base with each of 32 pairs of bits turned, and 16 spread over the space.
_BASE = xxhash.xxh64_intdigest(b"pivot", SEED)
_PAIRS = 32
_SPREAD = 16
PIVOTS = np.array([_BASE, *[_BASE ^ (3 << 2 * i) for i in range(_PAIRS)],
                   *[xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(_SPREAD)]], dtype=np.uint64)
#: The turned pivots in six groups. Two linked fingerprints differ in at most two of the 32 pairs of bits, so in at
#: least four whole groups their distances to all pivots are as far from that to the base: one of the 15 choices of four.
_GROUPS = np.array_split(np.arange(_PAIRS), 6)
_CHOICES = list(combinations(range(6), 4))
#: Fingerprints of one key that are compared pair by pair. Those of larger keys take the way of ``_crowded``.
CROWD = 16


def pivot_table(fingerprints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fingerprints[:, None] ^ PIVOTS[None, :])


def pivot_keys(table: np.ndarray) -> np.ndarray:
    """The 15 keys of each row of a pivot table: what it says about the pairs of bits in four of the six groups."""
    relative = (table[:, 1:1 + _PAIRS].astype(np.int64) - table[:, :1] + 2) // 2  # 0, 1 or 2 bits of the pair agree
    codes = [(relative[:, g] * 3 ** np.arange(len(g))).sum(axis=1) for g in _GROUPS]
    keys = np.zeros((len(table), len(_CHOICES)), np.int64)
    for i, choice in enumerate(_CHOICES):
        for g in choice:
            keys[:, i] = keys[:, i] * 729 + codes[g]
        keys[:, i] = keys[:, i] * len(_CHOICES) + i
    return keys


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fingerprint`` (a long that holds the 64 bits) of every row; null texts are like empty ones."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(t, shingle) for t in with_bytes(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "fingerprint"])
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), run, f"key {kind}, fingerprint long").withColumnRenamed("key", key)


def _with_keys(distinct: DataFrame) -> DataFrame:
    """Each fingerprint under its 15 keys, with its distances to the spread pivots."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = batch.column(0).to_numpy().view(np.uint64)
        table = pivot_table(prints)
        far = [r.tobytes() for r in np.ascontiguousarray(table[:, 1 + _PAIRS:]).astype(np.uint8)]
        keys = pivot_keys(table)
        n = keys.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(prints, n).view(np.int64)),
                                           pa.array([f for f in far for _ in range(n)], pa.binary())], ["k", "f", "far"])
    return map_rows(distinct.select("fingerprint"), run, "k long, f long, far binary")


def _survivors(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that no spread pivot discards and whose bits then prove to be linked."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        table = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, _SPREAD).astype(np.int16)
                 for c in (batch.column(2), batch.column(3))]
        near = np.abs(table[0] - table[1]).max(axis=1) <= RADIUS
        a, b = (batch.column(i).to_numpy().view(np.uint64)[near] for i in (0, 1))
        linked = np.bitwise_count(a ^ b) <= RADIUS
        return pa.RecordBatch.from_arrays([pa.array(x[linked].view(np.int64)) for x in (a, b)], ["a", "b"])
    return map_rows(pairs.select("a", "b", "far_a", "far_b"), run, "a long, b long")


def _crowded(members: DataFrame) -> DataFrame:
    """Links among fingerprints ``f`` that share a key with too many others, without comparing pairs: each is filed under
    itself and its 64 neighbours at one bit. Two are linked exactly if they meet somewhere, all that meet are linked, and
    at most 65 can meet. One of them stands for the place."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = batch.column(0).to_numpy().view(np.uint64)
        places = prints[:, None] ^ np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)[None, :]
        return pa.RecordBatch.from_arrays([pa.array(places.ravel().view(np.int64)),
                                           pa.array(np.repeat(prints, 65).view(np.int64))], ["place", "f"])
    places = map_rows(members.select("f").distinct(), run, "place long, f long")
    met = places.groupBy("place").agg(F.collect_set("f").alias("fs")).filter(F.size("fs") > 1)
    return (met.select(F.array_min("fs").alias("a"), F.explode("fs").alias("b")).filter("a <> b").distinct())


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect the same fingerprints as all links would; ``distinct`` has every fingerprint once."""
    keyed = _with_keys(distinct)
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut_lineage(keyed.join(shared, "k"))
    few = met.filter(F.col("n") <= CROWD)
    pairs = (few.select("k", F.col("f").alias("a"), F.col("far").alias("far_a"))
             .join(few.select("k", F.col("f").alias("b"), F.col("far").alias("far_b")), "k").filter("a < b"))
    return _survivors(pairs).unionByName(_crowded(met.filter(F.col("n") > CROWD))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b``): root is the smallest node that can be reached. Alternating
    large-star and small-star rounds; the links of each round are written and the round before is forgotten."""
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                                F.col("m").alias("v")).filter("u <> v").distinct())
        now = cut_lineage(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = seen


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fingerprint, component_id`` for each row of ``docs``: the bits as a long, and the smallest key that can be
    reached over links of at most two differing bits. Texts without words have fingerprint zero and are linked like
    others. Rows with null keys take part in linking; a component of null keys only has a null id."""
    prints = cut_lineage(fingerprints(docs, key, text, shingle))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min(key).alias("__least")))
    roots = cut_lineage(components(links(distinct)))
    joined = (distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
              .withColumn("root", F.coalesce("root", "fingerprint")))
    least = joined.groupBy("root").agg(F.min("__least").alias("component_id"))
    return prints.join(joined.join(least, "root").select("fingerprint", "component_id"), "fingerprint").select(
        key, "fingerprint", "component_id")


def keep_rows(docs: DataFrame, found: DataFrame, key: str, text: str, name: Callable[[bytes], object], column: str,
              kind: DataType) -> DataFrame:
    """One row of each component of ``found`` (``key``, ``column``, ``component_id``), one of its smallest key. ``column`` holds
    what ``name`` says of a text. Rows without key stay. Keys are looked at first: only where some are repeated do rows have to be
    told apart by that name; of those that are left the least by the other columns stays."""
    if found.groupBy(key).count().filter("count > 1").isEmpty():
        gone = found.filter(F.col(key) != F.col("component_id")).select(key)
        return docs.join(gone, key, "left_anti").select(*docs.columns)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("__own")
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = pa.array([name(t) for t in with_bytes(batch.column(0).field(at))], to_arrow_type(kind))
        return pa.RecordBatch.from_arrays([batch.column(0), names], ["__own", "__print"])
    rows = map_rows(docs.filter(F.col(key).isNotNull()).select(own), run, StructType(
        [StructField("__own", docs.schema), StructField("__print", kind)]))
    stay = found.filter(F.col(key) == F.col("component_id")).select(
        F.col(key).alias("__key"), F.col(column).alias("__print")).distinct()
    kept = rows.withColumn("__key", F.col("__own")[key]).join(stay, ["__key", "__print"])
    ranked = kept.withColumn("__rank", F.row_number().over(Window.partitionBy("__key").orderBy("__own")))
    return ranked.filter("__rank = 1").select("__own.*").unionByName(docs.filter(F.col(key).isNull()))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each component of fingerprints, one of its smallest key. Rows without key stay."""
    found = cut_lineage(near_duplicates(docs.filter(F.col(key).isNotNull()), key, text, shingle))
    return keep_rows(docs, found, key, text, lambda t: (fingerprint(t, shingle) + 2**63) % 2**64 - 2**63, "fingerprint", LongType())
