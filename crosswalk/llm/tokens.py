"""Token ids and counts of whole texts by public tokenizers, looked up instead of encoded wherever possible.

A text is the concatenation of pieces that the tokenizer treats apart from each other. What a piece gives is looked up,
first in a table sent to every worker, then in the worker's own bounded memory of earlier pieces; only what neither holds is
encoded. No piece is ever shuffled.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: Bytes of the pieces that a worker remembers before it starts anew, and what an entry takes besides its key.
MEMORY, _ENTRY = 96 << 20, 160
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""


class Remembered(dict):
    """A dict from texts that computes what it lacks. When it is full it becomes the older generation, from which what is asked
    for again comes back; the rest is forgotten with the next change. It takes about twice ``limit`` bytes at most."""

    def __init__(self, compute: Callable, limit: int = MEMORY):
        super().__init__()
        self.compute, self.limit, self.older, self.size = compute, limit, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.size += _ENTRY + 3 * len(key)
        if self.size >= self.limit:
            self.older, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


class Stable:
    """Whether all characters of a text are as old as Unicode 3.2, so that libraries with other Unicode tables agree on their
    classes. Texts with others are left whole to the tokenizer library. The characters of Unicode 3.2 that have changed
    class since are left out; of the rest each library was compared for every code point."""

    def __init__(self):
        self.known: set[str] = set()

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - self.known
        if not new:
            return True
        old = unicodedata.ucd_3_2_0.category
        good = {c for c in new if old(c) != "Cn" and old(c)[0] == unicodedata.category(c)[0]}
        self.known |= good
        return len(good) == len(new)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the
    next free one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=8)
def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer: Tokenizer) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


def frequent_lengths(path: str) -> dict[str, int]:
    """Token counts of the pre-tokens that a byte-level vocabulary holds whole: those that were frequent where it was
    made. At most one entry for each vocabulary entry. The counts are the library's own."""
    tokenizer = load(path)
    back = {c: b for b, c in byte_characters().items()}
    pieces = []
    split = regex.compile(BYTE_PATTERN)
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            piece = bytes(back[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split.fullmatch(piece):
            pieces.append(piece)
    return {p: len(e) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False))}


class Counter:
    """Counts tokens of whole texts by a byte-level tokenizer file."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int = MEMORY):
        self.tokenizer, self.split = load(path), regex.compile(BYTE_PATTERN).findall
        self.frequent, self.stable = frequent, Stable()
        self.specials = special_strings(self.tokenizer)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))).split
        self.missed = Remembered(self._encode, limit)

    def _encode(self, piece: str) -> int:
        known = self.frequent.get(piece)
        return len(self.tokenizer.encode(piece, add_special_tokens=False)) if known is None else known

    def _plain(self, text: str) -> int:
        if not self.stable(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        pieces = self.split(text)
        found = list(map(self.frequent.get, pieces))
        if None not in found:
            return sum(found)
        missed = self.missed
        return sum([missed[p] if n is None else n for p, n in zip(pieces, found)])

    def __call__(self, text: str) -> int:
        if not any(s in text for s in self.specials):
            return self._plain(text)
        parts = self.cut(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


#: Characters that Python takes for blanks and the tokenizer does not, and small letters that depend on their neighbours.
_NOT_PLAIN = {*map(chr, range(0x1C, 0x20)), "Σ", "İ"}
#: Characters of texts that are looked up together.
_PORTION = 1 << 22


class WordEncoder:
    """Ids by a tokenizer file whose pieces never span a blank, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = MEMORY):
        self.tokenizer = load(path)
        self.specials, self.stable = special_strings(self.tokenizer), Stable()
        self.split = regex.compile(WORD_PATTERN).findall
        self.as_characters = {b: c for b, c in byte_characters().items() if chr(b) != c}
        self.model = self.tokenizer.model
        self.word = Remembered(self._word, limit)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of what stands between blanks, in normal form and small letters; a piece of it splits into itself."""
        pieces = [word] if word.isalpha() else self.split(word)
        if len(pieces) > 1:
            return b"".join(map(self.word.__getitem__, pieces))
        # printable ASCII stands for itself
        characters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.as_characters)
        return array("I", [t.id for t in self.model.tokenize(characters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """One stretch without blanks: normal form, small letters and pieces as the library makes them, or the library
        itself where a special string, an unstable character or a capital sigma makes that doubtful."""
        if any(s in chunk for s in self.specials):
            return self._library(chunk)
        if not chunk.isascii():
            if not self.stable(chunk) or "Σ" in chunk or "İ" in chunk:
                return self._library(chunk)
            chunk = unicodedata.normalize("NFC", chunk)
        return b"".join(map(self.word.__getitem__, self.split(chunk.lower())))

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def _odd(self, texts: list[str]) -> list[bool]:
        """Whether a text has a special string or characters that make ``lower`` and ``split`` of the whole doubtful."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        present = "".join(map(chr, np.flatnonzero(np.bincount(points))))
        bad = {c for c in present if c in _NOT_PLAIN or not self.stable(c)}
        found = regex.compile("|".join([*map(regex.escape, [*self.specials, *sorted(bad)])])).search
        return [any(s in t for s in self.specials) for t in texts] if not bad else [found(t) is not None for t in texts]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Every distinct stretch between blanks is looked up once."""
        out = [b""] * len(texts)
        odd = self._odd(texts)
        for i in np.flatnonzero(odd):
            out[i] = b"".join(map(self._chunk, texts[i].split(" ")))
        plain = [i for i, o in enumerate(odd) if not o]
        if not plain:
            return out
        split = pa.compute.utf8_split_whitespace(pa.array([unicodedata.normalize("NFC", texts[i]).lower() for i in plain], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        found = [self.word[w] if w else b"" for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        data = np.frombuffer(b"".join(found), "<u4")
        which = coded.indices.to_numpy()
        each = sizes[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        firsts = np.cumsum(sizes) - sizes
        ids = data[np.arange(ends[-1]) + np.repeat(firsts[which] - ends[:-1], each)].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy()]).tolist()
        for k, i in enumerate(plain):
            out[i] = ids[bounds[k]:bounds[k + 1]]
        return out

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of an Arrow column, in portions; null counts as empty."""
        waiting, size = [], 0
        for t in texts:
            waiting.append(t.as_py() or "")
            size += len(waiting[-1])
            if size >= _PORTION:
                yield from self.many(waiting)
                waiting, size = [], 0
        yield from self.many(waiting)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its memory serves all tasks of the worker."""
    return WordEncoder(path)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text",
                 memory: int = MEMORY) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for each row, without begin, end or added special tokens; special strings
    inside texts count as the library takes them by default. Null texts count as empty: no bytes, no tokens."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, table.value, memory)
        count = _COUNTERS[path]
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([count(t.as_py() or "") for t in texts], pa.int64())
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pa.compute.greater(tokens, limit)],
                                             ["key", "n_bytes", "n_tokens", "over_limit"])
    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("key", key))
