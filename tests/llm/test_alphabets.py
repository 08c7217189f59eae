"""Random keys of plain alphabets among ordinary long words."""

import random
import string

from crosswalk.llm import secrets

KEYS = {"base36lower": (string.ascii_lowercase + string.digits, (32, 64, 128)), "base36": (string.ascii_uppercase + string.digits, (32, 64, 128)),
        "base32lower": (string.ascii_lowercase + "234567", (32, 64, 128)), "lower": (string.ascii_lowercase, (128,))}


def test_keys_of_every_alphabet_are_found(spark):
    rnd = random.Random(8)
    syllables = ["ther", "ing", "tion", "keit", "schaft", "ment", "aux", "der", "los", "pre"]
    words = ["".join(rnd.choices(syllables, k=rnd.randint(4, 8))) + rnd.choice(["", "7", "2024"]) for _ in range(1000)]
    keys = [(name, n, "".join(rnd.choices(letters, k=n))) for name, (letters, sizes) in KEYS.items() for n in sizes for _ in range(30)]
    rows = [(i, f"a {k} here") for i, (_, _, k) in enumerate(keys)] + [(10_000 + i, w) for i, w in enumerate(words)]
    scanned = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), ["doc_id"])
    hits = {r.doc_id for r in secrets.secret_spans(scanned, secrets.thresholds(scanned), ["doc_id"]).collect() if "random" in r.spans}
    for name, (_, sizes) in KEYS.items():
        for n in sizes:
            of = [i for i, k in enumerate(keys) if k[:2] == (name, n)]
            assert len(hits & set(of)) >= (26 if n > 32 else 20), (name, n, len(hits & set(of)))
    assert sum(i >= 10_000 for i in hits) <= 10
