"""Encoders over many texts at once, prompts, readers of shards, secrets that reach beyond a known shape."""

import base64
import random
import string
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models

from crosswalk.llm import bpe, packing, secrets, shards, tokens
from llm_helpers import TEXTS, documents, path

FILE = path("byte_bpe_multi_50k.tiktoken")


def test_many_texts_at_once_are_the_library():
    own, rnd = Tokenizer.from_file(path("word_bpe_49k.json")), random.Random(8)
    letters = "abzABZ'sStTd  \n\t\x1c\x85\xa009.,!?éÉßẞİıΣσςǅ中か́ำ١​😀"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(800)] + [t or "" for _, t in TEXTS if len(t or "") < 1000]
    rnd.shuffle(texts)
    for some in (texts, [], [""], ["", " ", "a b"]):
        found = tokens.WordEncoder(path("word_bpe_49k.json"), 4000).many(some)
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [own.encode(t, add_special_tokens=False).ids for t in some]


def test_long_pieces_are_merged_in_time():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))})
    encoder, rnd = bpe.Encoder(FILE, public_tokenizers.PATTERN), random.Random(2)
    long = "".join(rnd.choices(string.ascii_lowercase, k=1_000_000))
    for text in (long[:20_000], "ab" * 4000, "a" * 10_000, long[:3000] + " " + long[:3000] + "." * 3000):
        assert encoder.encode(text) == own.encode_ordinary(text)
    start = time.process_time()
    ids = encoder.encode(long)
    assert time.process_time() - start < 20 and encoder.decode(ids) == long.encode()
    assert own.decode(ids[:1000]) == encoder.decode(ids[:1000]).decode()


def test_prompts_bear_no_loss(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["answer"] * rnd.randint(0, 20)), None if i % 7 == 0 else " ".join(["question"] * rnd.randint(0, 30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(2)
    limits = packing.Limits(tokens=64, segments=8, loss=24)
    encoder, placed = tokens.word_encoder(path("word_bpe_49k.json")), {}
    before = {i: len(encoder(p or "")) // 4 for i, _, p in rows}
    for r in packing.pack_documents(docs, path("word_bpe_49k.json"), limits, prompt="prompt").collect():
        placed.setdefault(r.sequence_id, []).append((r.length, max(0, r.start + r.length - max(r.start, before[r.doc_id]))))
    full = [parts for parts in placed.values() if sum(n for n, _ in parts) > 32]
    assert all(sum(n for n, _ in p) <= 64 and sum(loss for _, loss in p) <= 24 for p in placed.values())
    assert sum(n for p in placed.values() for n, _ in p) == sum(before[i] + len(encoder(t)) // 4 + 1 for i, t, _ in rows)
    assert any(sum(loss for _, loss in p) == 24 for p in full)


def test_reading_goes_on_at_any_slot(spark, tmp_path):
    folder, length, per_shard = str(tmp_path / "out"), 16, 50
    total = shards.write_shards(documents(spark, [(i, f"text number {i} " * (i % 30)) for i in range(300)]), path("word_bpe_49k.json"), folder, length, per_shard)
    everything = list(shards.records_from(folder, 0, length, per_shard))
    assert [s for s, _ in everything] == list(range(total)) and total > 3 * per_shard
    crcs = {r.slot: r.ids_crc32 for r in shards.read_shards(spark, folder, total, length, per_shard).collect()}
    assert crcs == {s: zlib.crc32(ids.tobytes()) for s, ids in everything}
    for slot in (1, per_shard - 1, per_shard, total - 1, total, total + 500):
        rest = list(shards.records_from(folder, slot, length, per_shard))
        assert [(s, i.tolist()) for s, i in rest] == [(s, i.tolist()) for s, i in everything[slot:]]


def test_wide_vocabularies_are_refused(spark, tmp_path):
    wide = str(tmp_path / "wide.json")
    Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, "w0")).save(wide)
    with pytest.raises(ValueError):
        shards.write_shards(documents(spark), wide, str(tmp_path / "out"))


def test_a_key_around_a_known_shape_is_found_whole(spark):
    rnd = random.Random(6)
    letters = string.ascii_letters + string.digits
    keys = ["".join(rnd.choices(letters, k=60)) + "".join(rnd.choices("0123456789abcdef", k=16)) + "".join(rnd.choices(letters, k=60)) for _ in range(20)]
    texts = [(i, f"the key is {key} in the file") for i, key in enumerate(keys)] + [(100, "password=" + keys[0][:40])]
    scanned = secrets.scan(documents(spark, texts), ["doc_id"])
    rows = {r.doc_id: r for r in secrets.secret_spans(scanned, secrets.thresholds(scanned), ["doc_id"]).collect()}
    whole = [i for i in range(20) if "random:11:147" in rows[i].spans and rows[i].n_hex]
    assert len(whole) >= 17 and "random" not in rows[100].spans
    kept = {r.doc_id: r.text for r in secrets.redact_secrets(documents(spark, texts)).collect()}
    assert all(kept[i] == "the key is [SECRET] in the file" for i in whole)


def test_redaction_with_clashing_columns(spark):
    rows = [(1, "password = abcdefghijkl", 23, "own", "t", 5), (1, "password = abcdefghijkl", 23, "own", "t", 5), (None, None, None, None, None, None), (2, "", 0, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __own string, __text string, __n int")
    got = sorted(map(repr, map(tuple, secrets.redact_secrets(docs).collect())))
    assert got == sorted(map(repr, [(1, "[SECRET]", 8, "own", "t", 5)] * 2 + rows[2:]))
