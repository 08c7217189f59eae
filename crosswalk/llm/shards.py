"""Token sequences written once in training order.

The texts are read as one stream of ids per partition and cut into sequences of equal length. A keyed Feistel permutation
with cycle-walking gives each of the N sequences its own slot from 0 to N - 1. Shard s holds the slots from s times the shard
size on, in order, each record of the same number of bytes, so that a reader finds any slot by one seek and goes on from it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import fresh_folder, map_rows
from crosswalk.llm.tokens import load, word_encoder

#: Fills the last sequence of a partition; no id of the vocabularies that are taken.
PAD = 0xFFFF
END = 1
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> list[int]:
    return [int(_mix(np.array([key + 1], np.uint64), 0x9E3779B97F4A7C15 * (i + 1))[0]) for i in range(ROUNDS)]


def _walk(x: np.ndarray, n: int, key: int, backwards: bool) -> np.ndarray:
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)
    out = np.array(x, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in reversed(keys) if backwards else keys:
            if backwards:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slot of each sequence: a permutation of 0 to n - 1."""
    return _walk(index, n, key, False)


def indexes(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The sequence in each slot: undoes ``slots``."""
    return _walk(slot, n, key, True)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[bytes]:
    """The partition's sequences as unsigned 16-bit bytes; the last one is filled up."""
    encoder, size = word_encoder(path), 2 * length
    waiting = bytearray()
    for batch in batches:
        for found in encoder.column(batch.column(0)):
            ids = np.frombuffer(found, "<u4").astype("<u2")
            waiting += ids.tobytes() + END.to_bytes(2, "little")
            if len(waiting) >= size:
                whole = len(waiting) // size * size
                for at in range(0, whole, size):
                    yield bytes(waiting[at:at + size])
                del waiting[:whole]
        pa.default_memory_pool().release_unused()
    if waiting:
        yield bytes(waiting) + PAD.to_bytes(2, "little") * ((size - len(waiting)) // 2)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def write_shards(docs: DataFrame, path: str, folder: str, length: int = 1024, per_shard: int = 8192, key: int = 42,
                 text: str = "text") -> int:
    """Writes the ids of all texts (each followed by id 1) to ``folder``/shard=s/ and returns the number N of sequences.

    A record is ``length`` ids as unsigned 16-bit little-endian numbers and one line feed. The texts are encoded once, into a
    table of sequences in the shared folder: slots need N, and a table gives the same order however often a lost executor
    makes it be read. One count per partition reaches the driver. On the way to its shard each record is compressed by
    itself; one task holds one shard. Null and empty texts are one end id, repeated rows are written again, other columns
    are left out. A vocabulary with more ids than 16 bits tell apart is refused. An empty table gives no shards and 0."""
    if load(path).get_vocab_size() > PAD:
        raise ValueError(f"ids of {path} do not fit into 16 bits beside the id that fills up")
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rows = TaskContext.get().partitionId(), 0, []

        def batch_of() -> pa.RecordBatch:
            at = np.arange(n - len(rows), n)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), pa.array(at), pa.array(rows, pa.binary())],
                                              ["part", "n", "record"])
        for sequence in _sequences(batches, path, length):
            rows.append(sequence)
            n += 1
            if len(rows) == 1024:
                yield batch_of()
                rows = []
        if rows:
            yield batch_of()
    stored = fresh_folder(spark, "sequences")
    (docs.select(text).mapInArrow(encode, "part int, n long, record binary")
     .write.option("compression", "zstd").parquet(stored))
    sequences = spark.read.schema("part int, n long, record binary").parquet(stored)
    firsts, total = {}, 0
    for part, n in sorted(tuple(r) for r in sequences.groupBy("part").count().collect()):
        firsts[part] = total
        total += n
    if not total:
        return 0
    where = spark.sparkContext.broadcast(firsts)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec()
        first = np.fromiter(map(where.value.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
        to = slots(first + batch.column(1).to_numpy(), total, key)
        records = [codec.compress(r.as_buffer(), asbytes=True) for r in batch.column(2)]
        return pa.RecordBatch.from_arrays([pa.array((to // per_shard).astype(np.int32)), pa.array(to), pa.array(records, pa.binary())],
                                          ["shard", "slot", "record"])

    def restore(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec()
        records = [codec.decompress(r.as_buffer(), 2 * length, asbytes=True) for r in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(records, pa.binary())], ["shard", "slot", "record"])

    form = "shard int, slot long, record binary"
    dealt = map_rows(sequences, place, form).repartitionById((total - 1) // per_shard + 1, F.col("shard"))
    (map_rows(dealt, restore, form).sortWithinPartitions("shard", "slot")
     .select(F.col("record").cast("string").alias("value"), "shard")
     .write.partitionBy("shard").option("compression", "none").text(folder))
    return total


def read_shards(spark, folder: str, total: int, length: int = 1024, per_shard: int = 8192, key: int = 42) -> DataFrame:
    """One row per sequence as it lies in the shards: ``slot, shard, byte_offset, sequence_index, n_tokens, ids_crc32``."""
    stride = 2 * length + 1
    schema = "slot long, shard long, byte_offset long, sequence_index long, n_tokens long, ids_crc32 long"
    if not total:
        return spark.createDataFrame([], schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shard, at, crc = (batch.column(i).to_numpy() for i in (0, 1, 3))
        slot = shard * per_shard + at
        tokens = [int((np.frombuffer(r.as_buffer(), "<u2") != PAD).sum()) for r in batch.column(2)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (slot, shard, at * stride, indexes(slot, total, key), tokens, crc)],
                                          ["slot", "shard", "byte_offset", "sequence_index", "n_tokens", "ids_crc32"])
    files = spark.read.format("binaryFile").load(f"{folder}/shard=*")
    places = F.sequence(F.lit(0), (F.col("length") / stride).cast("int") - 1)
    records = (files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content", F.explode(places).alias("at"))
               .select("shard", F.col("at").cast("long").alias("at"),
                       F.expr(f"substring(content, at * {stride} + 1, {stride - 1})").alias("record"))
               .withColumn("crc", F.crc32("record")))
    return map_rows(records, run, schema)


def records_from(folder: str, slot: int, length: int = 1024, per_shard: int = 8192) -> Iterator[tuple[int, np.ndarray]]:
    """``slot, ids`` of every record from ``slot`` on, in training order. One seek finds the first record, whatever comes before
    it; a training run that was stopped goes on with the slot after its last. ``folder`` may be in any store that Arrow opens."""
    store, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder.removeprefix("file:"))
    stride = 2 * length + 1
    shard, at = divmod(slot, per_shard)
    while True:
        chosen = pa.fs.FileSelector(f"{root}/shard={shard}", allow_not_found=True)
        files = [f.path for f in store.get_file_info(chosen) if f.is_file and f.base_name.startswith("part-")]
        if not files:
            return
        with store.open_input_file(files[0]) as records:
            records.seek(at * stride)
            while record := records.read(stride):
                yield shard * per_shard + at, np.frombuffer(record, "<u2", length)
                at += 1
        shard, at = shard + 1, 0


def materialise(docs: DataFrame, path: str, length: int = 1024, per_shard: int = 8192, key: int = 42, text: str = "text") -> DataFrame:
    """``write_shards`` to a new shared folder, read back by ``read_shards``."""
    folder = fresh_folder(docs.sparkSession, "shards")
    total = write_shards(docs, path, folder, length, per_shard, key, text)
    return read_shards(docs.sparkSession, folder, total, length, per_shard, key)
