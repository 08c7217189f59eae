"""Secrets, token counts, quality rules, BPE, language model, packing, winnowing, shards against plain Python."""

import datetime
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crosswalk.llm import bpe, lm, packing, quality, secrets, shards, tokens, winnow
from llm_helpers import (LONG, SECRET, TEXTS, WORD, base_spans, documents, empty, is_held_out, lower, path, repeated, sha)


def key_order(rows):
    return sorted(rows, key=repr)


def test_secrets(spark):
    docs = documents(spark)
    scanned = secrets.scan(docs, ["doc_id"])
    rows = secrets.secret_spans(scanned, secrets.thresholds(scanned), ["doc_id"]).collect()
    wanted = key_order((i, ",".join(base_spans(t or ""))) for i, t in TEXTS)
    assert key_order((r.doc_id, r.base_spans) for r in rows) == wanted
    by = {r.doc_id: r for r in rows}
    at = [11, 11 + len(SECRET) + 12]
    assert by[11].spans == ",".join(f"random:{s}:{s + len(SECRET)}" for s in at)
    assert by[10].n_assign == 1 and by[10].n_access == 1 and by[10].n_hex == 1
    assert all(r.spans == r.base_spans for r in rows if r.doc_id != 11)
    clean = {r.doc_id: r for r in secrets.redact_secrets(docs).filter("doc_id in (1, 3, 10, 11)").collect()}
    assert clean[11].text == "a key like [SECRET] in prose 😀 [SECRET]" and clean[11].n_chars == len(clean[11].text)
    assert clean[10].text == '[SECRET]" and [SECRET]\ntoken:short [SECRET] Secret:abcdefghijk'
    assert clean[1].text == TEXTS[0][1] and clean[3].text is None and clean[3].n_chars is None and clean[1].w == 1
    assert secrets.secret_spans(secrets.scan(empty(spark), ["doc_id"]), {}, ["doc_id"]).count() == 0
    assert secrets.redact_secrets(empty(spark)).columns == docs.columns


def test_false_discoveries_are_held_down(spark):
    """Thousands of long words with capitals and digits give no findings, random keys among them do."""
    rnd = random.Random(5)
    syllables = ["ther", "ing", "tion", "keit", "schaft", "ment", "aux", "der", "los", "pre"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(4, 8))).title() + rnd.choice(["", "7", "2024"]) for _ in range(4000)]
    keys = ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, f"{w} " + (keys[i] if i < 40 else "x")) for i, w in enumerate(words)], "doc_id long, text string")
    scanned = secrets.scan(docs, ["doc_id"])
    rows = secrets.secret_spans(scanned, secrets.thresholds(scanned), ["doc_id"]).collect()
    hits = {r.doc_id for r in rows if r.spans}
    assert len(hits & set(range(40))) >= 36 and len(hits - set(range(40))) <= 1


def test_quality(spark):
    rows = quality.measure(documents(spark)).collect()
    def plain(i, t):
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n, again = len(words), repeated(words)
        return (i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, n < 20 or 100 * again > 30 * n)
    assert key_order(tuple(r)[:7] for r in rows) == key_order(plain(*x) for x in TEXTS)
    assert all(not r.kept for r in rows if r.base_failed)
    kept = {r.doc_id for r in quality.keep_good(documents(spark)).collect()}
    assert kept == {r.doc_id for r in rows if r.kept} and 1 in kept and not kept & {3, 4, 13, 16}
    assert quality.measure(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_cascade_order_never_changes_a_verdict(spark):
    from pyspark.sql import functions as F
    docs, rules = documents(spark), quality.BASE_RULES | quality.RULES
    def verdicts(names):
        f = quality.facts(F.col("text"), F.col("ws"))
        order = [quality.Step(n, 1.0, 0.5) for n in names]
        return sorted(docs.filter("text is not null").withColumn("ws", quality.words(F.col("text")))
                      .select("doc_id", quality.cascade(f, rules, order).alias("k")).collect(), key=repr)
    assert verdicts(list(rules)) == verdicts(list(reversed(rules)))


def test_token_counts(spark):
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = tokens.count_tokens(documents(spark), path("byte_bpe_50k.json"), 1024, memory=500).collect()
    def plain(i, t):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        return i, len((t or "").encode()), n, n > 1024
    assert key_order(tuple(r) for r in rows) == key_order(plain(*x) for x in TEXTS)
    assert tokens.count_tokens(empty(spark), path("byte_bpe_50k.json"), 1).count() == 0


def test_word_encoder_is_the_library():
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    encoder, rnd = tokens.WordEncoder(path("word_bpe_49k.json"), 50), random.Random(3)
    letters = "abzABZ'sStTd  \n\t\x1c\x85\xa009.,!?éÉßẞİıΣσςǅ中か́ำ١​😀"
    for t in [t or "" for _, t in TEXTS if t != LONG] + ["".join(rnd.choice(letters) for _ in range(30)) for _ in range(500)]:
        assert np.frombuffer(encoder(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_bpe(spark):
    file, pattern = path("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Ranks(file).rank, special_tokens={})
    rows = bpe.round_trip(documents(spark), file, pattern, memory=300).collect()
    def plain(i, t):
        ids = own.encode_ordinary(t or "")
        return i, len(ids), sha(",".join(map(str, ids))), sha(t or "")
    assert key_order(tuple(r) for r in rows) == key_order(plain(*x) for x in TEXTS)
    encoder = bpe.Encoder(file, pattern, 10)
    for t in ("ab" * 3000, "  \n x\x00\x7f", "aaaaaaaaaaaaaaaa", "الحروف العربية"):
        assert encoder.encode(t) == own.encode_ordinary(t) and encoder.decode(encoder.encode(t)) == t.encode()
    assert bpe.round_trip(empty(spark), file, pattern).count() == 0


def test_language_model(spark):
    rows = lm.score(documents(spark)).collect()
    counts = Counter()
    for i, t in TEXTS:
        if not is_held_out(i):
            counts.update(WORD.findall(lower(t or "")) + [""])
    total, distinct = sum(counts.values()), len(counts)
    def plain(i, t):
        words = WORD.findall(lower(t or "")) + [""]
        return (i, is_held_out(i), len(words), sum(counts[w] > 0 for w in words), total,
                round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words), 6))
    assert key_order((*tuple(r)[:5], round(r.base_score, 6)) for r in rows) == key_order(plain(*x) for x in TEXTS)
    assert all(r.score < 0 for r in rows)
    assert lm.score(empty(spark)).count() == 0


def test_language_model_is_normalised_and_learns(spark):
    rnd = random.Random(1)
    pairs = {"a": "b", "b": "c", "c": "d", "d": "a"}
    def walk():
        out = [rnd.choice("abcd")]
        for _ in range(60):
            out.append(pairs[out[-1]] if rnd.random() < 0.9 else rnd.choice("abcd"))
        return " ".join(out)
    docs = spark.createDataFrame([(i, walk()) for i in range(600)], "doc_id long, text string").repartition(2)
    rows = lm.score(docs, settings=lm.Settings(batch=256)).filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.6 * sum(r.base_score for r in rows)
    chances = np.array([0.4, 0.3, 0.2, 0.1])
    model = lm.Model(lm.Settings(), chances)
    one, two, whole = lm.score_tables(spark, model, model.vector)
    for a in range(5):
        for b in range(5):
            assert abs(np.exp(one[a] + two[b] - whole[a, b]).sum() - 1) < 1e-5


@pytest.mark.parametrize("cut", [True, False])
def test_packing(spark, cut):
    limits = packing.Limits(tokens=64, segments=5, loss=50)
    rows = packing.pack_documents(documents(spark), path("word_bpe_49k.json"), limits, cut).collect()
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    wanted = Counter()
    for i, t in TEXTS:
        wanted[i, np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and 4 * r.length == len(r.ids) for r in rows)
    assert sum(r.length for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in wanted.items())
    for (i, ids), n in wanted.items():
        mine = [r for r in rows if r.doc_id == i and r.doc_tokens == len(ids) // 4]
        for r in mine:
            assert r.ids == ids[4 * r.start:4 * (r.start + r.length)]
        covered = Counter(p for r in mine for p in range(r.start, r.start + r.length))
        assert covered == Counter({p: n for p in range(len(ids) // 4)})
    placed = {}
    for r in rows:
        if r.sequence_id is not None:
            placed.setdefault(r.sequence_id, []).append(r)
    for parts in placed.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        total = sum(r.length for r in parts)
        assert total <= 64 and len(parts) <= 5 and sum(r.length - (r.start == 0) for r in parts) <= 50
        assert not cut or total & (total - 1) == 0
    assert cut or {r.doc_id for r in rows if r.sequence_id is None} >= {8, 9}
    assert packing.pack_documents(empty(spark), path("word_bpe_49k.json")).count() == 0


def slow_winnow(text, k, w):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not text:
        return []
    k = min(k, len(points))
    hashes = [int(winnow._rolling(points[i:i + k], k)[0]) for i in range(len(points) - k + 1)]
    w = min(w, len(hashes))
    chosen = set()
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i:i + w])
        chosen.add(max(j for j in range(i, i + w) if hashes[j] == least))
    return [f"{j}:{hashes[j]:010x}" for j in sorted(chosen)]


def test_winnowing(spark):
    rnd = random.Random(4)
    for _ in range(40):
        t = "".join(rnd.choice("ab😀") for _ in range(rnd.randint(0, 120)))
        k, w = rnd.randint(1, 9), rnd.randint(1, 9)
        assert winnow.shown(*winnow.winnow(winnow._points(t), k, w)) == ",".join(slow_winnow(t, k, w))
    texts = [(i, t) for i, t in TEXTS if t != LONG]
    for chunks in (1, 3, 40):
        rows = winnow.fingerprints(documents(spark, texts), chunks=chunks).collect()
        order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
        wanted = []
        for n, (i, t) in enumerate(order):
            t, following = t or "", order[(n + 1) % len(order)][1] or ""
            half = len(t) // 2
            new = t[:len(t) - half] + following[:half]
            a, b, c = (set(winnow.winnow(winnow._points(x))[0].tolist()) for x in (t, new, following))
            near = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
            wanted.append((i, len(t), sha(new), winnow.shown(*winnow.winnow(winnow._points(t))),
                           winnow.shown(*winnow.winnow(winnow._points(new))), *near))
        assert key_order(tuple(r) for r in rows) == key_order(wanted)
    one = winnow.fingerprints(documents(spark, [(1, "only one")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert winnow.fingerprints(empty(spark)).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        for key in (1, 2):
            to = shards.slots(np.arange(n), n, key)
            assert sorted(to.tolist()) == list(range(n))
            assert shards.indexes(to, n, key).tolist() == list(range(n))
    assert shards.slots(np.arange(1000), 1000, 1).tolist() != shards.slots(np.arange(1000), 1000, 2).tolist()


def test_shards(spark, tmp_path):
    folder, length, per_shard = str(tmp_path / "out"), 32, 100
    docs = documents(spark)
    total = shards.write_shards(docs, path("word_bpe_49k.json"), folder, length, per_shard)
    rows = shards.read_shards(spark, folder, total, length, per_shard).collect()
    assert sorted(r.slot for r in rows) == list(range(total)) == sorted(r.sequence_index for r in rows)
    encoder = tokens.WordEncoder(path("word_bpe_49k.json"))
    streams = {}
    from pyspark.sql import functions as F
    for r in docs.select(F.spark_partition_id().alias("p"), "text").collect():
        ids = np.frombuffer(encoder(r.text or ""), "<u4").tolist() + [1]
        streams[r.p] = streams.get(r.p, []) + ids
    wanted = []
    for p in sorted(streams):
        s = streams[p] + [shards.PAD] * (-len(streams[p]) % length)
        wanted += [np.array(s[i:i + length], "<u2").tobytes() for i in range(0, len(s), length)]
    stride = 2 * length + 1
    for r in rows:
        (file,) = (tmp_path / "out" / f"shard={r.shard}").glob("*.txt")
        with open(file, "rb") as f:
            f.seek(r.byte_offset)
            record = f.read(stride)
        assert record[:-1] == wanted[r.sequence_index] and zlib.crc32(record[:-1]) == r.ids_crc32
        assert r.slot == r.shard * per_shard + r.byte_offset // stride
    assert shards.materialise(empty(spark), path("word_bpe_49k.json")).count() == 0


def plain_hash(points, k):
    """Sum of (point + 1) * base^(k-1-i) in 64 bits, mixed, upper 40 bits."""
    low, total = (1 << 64) - 1, 0
    for p in points[:k]:
        total = (total * 0x9E3779B97F4A7C15 + int(p) + 1) & low
    total = ((total ^ (total >> 31)) * 0xBF58476D1CE4E5B9) & low
    return (total ^ (total >> 29)) >> 24


def test_rolling_hash_equals_the_plain_sum():
    rnd = random.Random(9)
    for k in range(1, 40):
        points = np.array([rnd.randint(0, 0x10FFFF) for _ in range(60)], np.uint32)
        assert winnow._rolling(points, k).tolist() == [plain_hash(points[i:], k) for i in range(len(points) - k + 1)]


def neighbours(rows, order):
    """Keys, edited text and likeness to the next of rows in an order, as plain Python gives them."""
    wanted = []
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        a, b = (set(winnow.winnow(winnow._points(x))[0].tolist()) for x in (t, following))
        wanted.append((i, sha(winnow.edited(t, following)), len(a & b) / len(a | b) if a | b else 1.0))
    return key_order((r[0], r.edited_sha256, r.near_next) for r in rows) == key_order(wanted)


@pytest.mark.parametrize("kind", ["string", "date", "double"])
def test_keys_of_other_types_and_equal_keys(spark, kind):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["ab", "ünd", "xyz", "q"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    made = {"string": lambda i: f"k{i}", "date": lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i), "double": lambda i: i / 7}[kind]
    rows = [(None if i % 11 == 0 else made(3 if i % 3 else i), t) for i, t in enumerate(texts + texts[:20] * 2)]
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: r[1])
    order = sorted(order, key=lambda r: r[0], reverse=True) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    assert neighbours(winnow.fingerprints(docs, chunks=9).collect(), order)


def test_one_key_is_many_ranges(spark):
    docs = spark.range(1000).selectExpr("1 AS doc_id", "concat(sha2(cast(id AS string), 256), ' text') AS text", "id AS head", "id AS chunk")
    found = winnow.fingerprints(docs, chunks=8).withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in found.groupBy("task").count().collect()]
    assert sum(per_task) == 1000 and len(per_task) == 8 and max(per_task) < 250
    same = spark.range(500).selectExpr("'k' AS doc_id", "'one text that is repeated' AS text")
    assert {tuple(r) for r in winnow.fingerprints(same, chunks=8).select("near_next", "n_chars").collect()} == {(1.0, 25)}
