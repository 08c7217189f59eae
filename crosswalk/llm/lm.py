"""Scores of a log-bilinear neural language model.

The two words before a word predict a vector, C1 r(w-1) + C2 r(w-2), and a word's score is its product with that vector
plus a bias. The model is trained by noise-contrastive estimation on all training texts: every task trains on what it
reads, and the weighted mean of all tasks is where the next round starts. Scoring is normalised: one batched matrix product
for each earlier word gives the normaliser of every pair of contexts. Words outside the model's vocabulary share one class in
it and are told apart by their counts in the whole training corpus.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import cut_lineage

FOLDS, HELD_OUT = 5, 1
#: The word that ends a text. Words are never empty.
END = b""
#: Words with counts at hand in every task; longer ones and the others meet their counts in a join.
LISTED, LONGEST = 131_072, 64


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 1024
    dimensions: int = 24
    noise: int = 64
    batch: int = 4096
    rate: float = 0.1
    rounds: int = 2
    seed: int = 7


def held_out(key: object) -> bool:
    """By the key as text; a null key counts as empty text."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % FOLDS == HELD_OUT


def _portions(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Keys and lower-cased words of a batch, about a megabyte of text at a time."""
    rows, size = [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
        rows.append((key.as_py(), data.lower().split()))
        size += len(data)
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def training_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``w, c``: every distinct word of the training texts, and the end of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for rows in _portions(batch):
                for k, words in rows:
                    if not held_out(k):
                        counts.update(words)
                        counts[END] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                                 ["w", "c"])
    return docs.select(key, text).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Model:
    """Parameters in one vector. Word ids: the vocabulary, then the class of all others; contexts have one more, the start."""

    def __init__(self, s: Settings, chances: np.ndarray):
        self.s, self.v, d = s, len(chances), s.dimensions
        rng = np.random.default_rng(s.seed)
        self.shapes = [(self.v + 1, d), (self.v, d), (self.v,), (d, d), (d, d)]
        start = [rng.normal(0, 0.1, self.shapes[0]), rng.normal(0, 0.1, self.shapes[1]), np.log(chances), np.eye(d), np.eye(d) / 2]
        self.vector = np.concatenate([x.ravel() for x in start])

    def parts(self, vector: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(x) for x in self.shapes])
        return [p.reshape(x) for p, x in zip(np.split(vector, ends[:-1]), self.shapes)]


def _scatter(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
    out = np.zeros((rows, values.shape[1]), np.float32)
    out[at[order][starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad; the samples of noise are shared by a batch."""

    def __init__(self, model: Model, vector: np.ndarray, chances: np.ndarray, part: int):
        self.s, self.model = model.s, model
        self.now = [p.astype(np.float32).copy() for p in model.parts(vector)]
        self.squares = [np.full(p.shape, 1e-2, np.float32) for p in self.now]
        self.rng = np.random.default_rng([model.s.seed, part])
        self.bounds, self.log_noise = np.cumsum(chances), np.log(model.s.noise * chances).astype(np.float32)
        self.seen = 0

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        r, q, b, c1, c2 = self.now
        n = len(word)
        noise = np.minimum(np.searchsorted(self.bounds, self.rng.random(self.s.noise)), self.model.v - 1)
        r1, r2 = r[one], r[two]
        hidden = r1 @ c1 + r2 @ c2
        true = (hidden * q[word]).sum(axis=1) + b[word] - self.log_noise[word]
        false = hidden @ q[noise].T + b[noise] - self.log_noise[noise]
        g_true = (1.0 / (1.0 + np.exp(-true)) - 1.0) / n
        g_false = 1.0 / (1.0 + np.exp(-false)) / n
        back = g_true[:, None] * q[word] + g_false @ q[noise]
        g_q = _scatter(len(q), word, g_true[:, None] * hidden) + _scatter(len(q), noise, g_false.T @ hidden)
        g_b = np.bincount(word, g_true, len(b)) + np.bincount(noise, g_false.sum(axis=0), len(b))
        g_r = _scatter(len(r), one, back @ c1.T) + _scatter(len(r), two, back @ c2.T)
        for p, s, g in zip(self.now, self.squares, (g_r, g_q, g_b.astype(np.float32), r1.T @ back, r2.T @ back)):
            s += g * g
            p -= self.s.rate * g / np.sqrt(s)
        self.seen += n


def _contexts(ids: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before, the one before that, and the word, of all texts one after the other."""
    before = [np.concatenate([[start, start], i])[:-1] for i in ids]
    return np.concatenate([x[1:] for x in before]), np.concatenate([x[:-1] for x in before]), np.concatenate(ids)


def train(docs: DataFrame, key: str, text: str, model: Model, ids: dict[bytes, int], chances: np.ndarray) -> np.ndarray:
    """Each training text is used once, in the round that its key's CRC names. A round moves one vector per task."""
    spark, other, start = docs.sparkSession, model.v - 1, model.v
    words_of = spark.sparkContext.broadcast(ids)
    vector = model.vector
    for turn in range(model.s.rounds):
        shared = spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, get = Trainer(model, shared.value, chances, TaskContext.get().partitionId()), words_of.value.get
            for batch in batches:
                for rows in _portions(batch):
                    texts = [np.array([get(w, other) for w in words] + [get(END, other)]) for k, words in rows
                             if not held_out(k) and zlib.crc32(b"%d" % zlib.crc32(str(k).encode())) % model.s.rounds == turn]
                    if texts:
                        one, two, word = _contexts(texts, start)
                        for at in range(0, len(word), model.s.batch):
                            end = at + model.s.batch
                            trainer.step(one[at:end], two[at:end], word[at:end])
            if trainer.seen:
                mine = np.concatenate([p.ravel() for p in trainer.now]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mine), dtype=np.int32)), pa.array(mine * trainer.seen),
                                                  pa.array(np.full(len(mine), float(trainer.seen)))], ["i", "v", "weight"])
        means = (docs.select(key, text).mapInArrow(run, "i int, v double, weight double")
                 .groupBy("i").agg((F.sum("v") / F.sum("weight")).alias("v")).toPandas())
        if len(means):
            vector = means.sort_values("i")["v"].to_numpy()
    return vector


def score_tables(spark, model: Model, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``one[w1, w] + two[w2, w] - log_total[w1, w2]`` is the natural logarithm of the chance of w after w2 w1."""
    r, q, b, c1, c2 = model.parts(vector)
    one, two = ((r @ c1) @ q.T + b).astype(np.float32), ((r @ c2) @ q.T).astype(np.float32)
    tables = spark.sparkContext.broadcast((one, two))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tables.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                scores = second + first[i]
                top = scores.max(axis=1)
                totals = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([totals.astype("<f4").tobytes()])], ["i", "row"])
    found = spark.range(0, len(one), numPartitions=24).mapInArrow(run, "i long, row binary").collect()
    total = np.stack([np.frombuffer(r.row, "<f4") for r in sorted(found, key=lambda r: r.i)])
    return one, two, total


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """Words of at most ``LONGEST`` bytes by count, as many whole classes of counts (64 to each doubling) as have ``LISTED``
    words together at most. The classes are counted first: a few thousand numbers reach the driver, then the words."""
    short = counts.filter(F.length("w") <= LONGEST).withColumn("class", F.floor(F.log2("c") * 64))
    lowest, seen = None, 0
    for row in sorted(short.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["class"]):
        seen += row.n
        if seen > LISTED:
            break
        lowest = row["class"]
    if lowest is None:
        return []
    return sorted(((bytes(r.w), r.c) for r in short.filter(F.col("class") >= lowest).collect()), key=lambda x: (-x[1], x[0]))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are lower-cased words and one end per text. Base: unigrams smoothed by a half. Score: log10 of the model's chance of
    the whole text. Null texts are only an end, null keys train, repeated rows stay apart. To the driver come the
    counts of at most ``LISTED`` words of at most ``LONGEST`` bytes, and the model, whose size is fixed."""
    spark = docs.sparkSession
    counts = cut_lineage(training_counts(docs, key, text))
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    listed = most_frequent(counts)
    names = [w for w, _ in listed]
    vocabulary = ([END] if END in names else []) + [w for w in names if w != END]
    vocabulary = vocabulary[:settings.vocabulary]
    ids = {w: i for i, w in enumerate(vocabulary)}
    count_of = dict(listed)
    other = len(vocabulary)
    rest, rest_distinct = total - sum(count_of[w] for w in vocabulary), distinct - len(vocabulary)
    chances = np.array([count_of[w] for w in vocabulary] + [rest + 0.5], float)
    chances /= chances.sum()
    model = Model(settings, chances)
    vector = train(docs, key, text, model, ids, chances) if total else model.vector
    tables = score_tables(spark, model, vector)
    whole, within = total + 0.5 * (distinct + 1), rest + 0.5 * (rest_distinct + 1)
    place = {w: i for i, w in enumerate(vocabulary)} | {
        w: other + 1 + i for i, w in enumerate(w for w in names if w not in ids)}
    by_place = np.zeros(len(place) + 1)
    for w, i in place.items():
        by_place[i] = count_of[w]
    shared = spark.sparkContext.broadcast((place, by_place, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, listed_counts, (one_t, two_t, log_total) = shared.value
        get, number = places.get, TaskContext.get().partitionId() << 33
        base_of = np.log10((listed_counts + 0.5) / whole)
        within_of = np.log10((listed_counts + 0.5) / within)
        within_of[:other] = 0.0
        base_of[other] = within_of[other] = 0.0  # the place of words that are not listed
        known = listed_counts > 0
        known[other] = False
        for batch in batches:
            for rows in _portions(batch):
                at = [np.array([get(w, other) for w in words] + [get(END, other)]) for _, words in rows]
                one, two, word = _contexts([np.minimum(a, other) for a in at], other + 1)
                flat = np.concatenate(at)
                starts = np.concatenate([[0], np.cumsum([len(a) for a in at])[:-1]])
                logs = (one_t[one, word] + two_t[two, word] - log_total[one, two]).astype(float) / math.log(10)
                sums = [np.add.reduceat(x, starts) for x in (known[flat].astype(np.int64), base_of[flat], logs + within_of[flat])]
                own = np.arange(number, number + len(rows))
                number += len(rows)
                rare_row, rare_word, rare_n = [], [], []
                for i, (a, (_, words)) in enumerate(zip(at, rows)):
                    missing = Counter(words[j] if j < len(words) else END for j in np.flatnonzero(a == other).tolist())
                    rare_row += [own[i]] * len(missing)
                    rare_word += missing.keys()
                    rare_n += missing.values()
                n, m = len(rows), len(rare_row)
                empty = np.zeros(m)
                keys = pa.concat_arrays([pa.array([k for k, _ in rows], batch.schema.field(0).type), pa.nulls(m, batch.schema.field(0).type)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([b" %d" % x for x in own] + rare_word, pa.binary()), pa.array(np.concatenate([own, np.array(rare_row, np.int64)])),
                    keys, pa.array([held_out(k) for k, _ in rows] + [None] * m, pa.bool_()),
                    pa.array([len(a) for a in at] + [0] * m, pa.int64()), pa.array(np.concatenate([sums[0], empty.astype(np.int64)])),
                    pa.array(np.concatenate([sums[1], empty])), pa.array(np.concatenate([sums[2], empty])),
                    pa.array([0] * n + rare_n, pa.int64())], ["w", "row", "key", "held_out", "n_tokens", "n_known", "base", "score", "rare"])
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(run, f"w binary, row long, key {kind}, held_out boolean, n_tokens long, n_known long, "
                                                  "base double, score double, rare long")
    c = F.coalesce("c", F.lit(0))
    met = rows.join(counts, "w", "left").select(
        "row", "key", "held_out", "n_tokens", F.when(c > 0, F.col("n_known") + F.col("rare")).otherwise(F.col("n_known")).alias("n_known"),
        (F.col("base") + F.col("rare") * F.log10((c + 0.5) / whole)).alias("base"),
        (F.col("score") + F.col("rare") * F.log10((c + 0.5) / within)).alias("score"))
    return met.groupBy("row").agg(
        F.max("key").alias(key), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"),
        F.sum("score").alias("score")).drop("row")
