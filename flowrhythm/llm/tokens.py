"""Token ids of whole texts, with a cache of what stands between white space.

The pre-tokenizer of the vocabulary used here never joins characters across white
space, so a text's ids are those of its white-space chunks one after another. Chunks
repeat a lot: the library is asked only for words that a task has not met yet.
"""

from __future__ import annotations

import array
import json
import re
import string
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Entries of the caches of other words and of chunks: fewer than before words of letters were kept once.
WORD_CACHE, CACHE = 1 << 16, 1 << 18
#: Characters of a chunk that is kept at most.
LONG = 256
#: Characters of the texts that are encoded together, a whole text at least.
SLICE = 1 << 20
#: Marks that make words of their own beside ASCII letters.
_MARKS = frozenset(string.punctuation)
#: Characters that str.split() drops and the vocabulary's pattern for white space doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@lru_cache(1)
def byte_chars() -> tuple[str, ...]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return tuple(chr(b if b in shown else next(hidden)) for b in range(256))


def byte_level(word: str) -> str:
    table = byte_chars()
    return "".join([table[b] for b in word.encode()])


class Spec:
    """The parts of a tokenizer file that this module follows: NFC, lower case, one pattern, byte-level BPE."""

    def __init__(self, source: str) -> None:
        d = json.loads(source)
        steps = [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
        split = (d["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or d["model"]["type"] != "BPE":
            raise ValueError("expected a lower-casing word vocabulary: NFC, white space, lower case; words by a pattern; BPE")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.suffix: str = d["model"]["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = d["model"]["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.tokens = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = {s[:2] for s in self.special}


def lower(text: str) -> str:
    """Lower case, character by character: a final sigma is no exception."""
    return text.replace("Σ", "σ").lower()


def normal(text: str) -> str:
    return lower(text if text.isascii() else unicodedata.normalize("NFC", text))


def letters(word: str) -> bool:
    """Whether there are only letters, all below U+0250, where every version of Unicode has the same ones."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class _Chunks(dict):
    """What `make` gives, kept in two halves: when the newer one is full it becomes the older, and what isn't met again until the next time goes."""

    def __init__(self, make, most: int = CACHE) -> None:
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = self.make(chunk)
        if len(chunk) <= LONG:
            if len(self) >= self.half:
                self.older.clear()
                self.older.update(self)
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Texts to little-endian unsigned 32-bit ids; words by the library's model."""

    def __init__(self, source: str, most: int = CACHE) -> None:
        self.spec = Spec(source)
        del self.spec.vocab, self.spec.merges, self.spec.tokens  # the model has them
        self._model = Tokenizer.from_str(source).model
        self._words = _Chunks(self.word, WORD_CACHE)
        self._chunks = _Chunks(self._chunk, most)

    def word(self, word: str) -> bytes:
        return array.array("I", [t.id for t in self._model.tokenize(word if word.isascii() and word.isalpha() else byte_level(word))]).tobytes()

    def _part(self, word: str) -> bytes:
        """Ids of a word of the pattern; one of letters is a chunk as well, and is kept once."""
        return self._chunks[word] if letters(word) else self._words[word]

    def _chunk(self, chunk: str) -> bytes:
        # most are letters, with a mark after them or without, and need no pattern
        if chunk[-1] in _MARKS:
            if letters(chunk[:-1]):
                return self._chunks[chunk[:-1]] + self._words[chunk[-1]]
        elif letters(chunk):
            return self.word(chunk)
        return b"".join(map(self._part, self.spec.pattern.findall(chunk)))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        text = normal(text)
        if _SEPARATORS.search(text):
            return self._chunk(text)
        return b"".join(map(self._chunks.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as bytes; special tokens in it become their ids; null counts as empty."""
        if not text:
            return b""
        if any(m in text for m in self.spec.marks):
            parts = self.spec.cut.split(text)
            return b"".join(self.plain(p) if k % 2 == 0 else self.spec.special[p].to_bytes(4, "little") for k, p in enumerate(parts))
        return self.plain(text)

    def _joined(self, chunk: str) -> bytes:
        """Ids of a chunk met for the first time in a batch; letters and the marks after them are kept apart only."""
        if chunk[-1:] in _MARKS and letters(word := chunk.rstrip(string.punctuation)):
            return self._chunks[word] + self._words[chunk[len(word) :]]
        return self._chunks[chunk] if chunk else b""

    def encode_all(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """What `encode` gives for each text; a chunk is looked up once for some SLICE characters."""
        first = size = 0
        for k, x in enumerate(texts, 1):
            size += len(x or "")
            if size >= SLICE or k == len(texts):
                yield from self._together(texts[first:k])
                first, size = k, 0

    def _together(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        special = {k for k, x in enumerate(texts) if x and any(m in x for m in self.spec.marks)}
        plain = pa.array([normal(x) if x and k not in special else "" for k, x in enumerate(texts)], pa.large_string())
        chunks = pc.ascii_split_whitespace(plain)  # other white space stays within chunks, and the pattern drops it
        each = chunks.values.dictionary_encode()
        made = pa.array([*map(self._joined, each.dictionary.to_numpy(zero_copy_only=False).tolist())], pa.large_binary())
        _, ends, ids = made.take(each.indices).buffers()
        at = np.frombuffer(ends, np.int64)[chunks.offsets.to_numpy()].tolist()
        raw = memoryview(ids or b"")
        for k, x in enumerate(texts):
            yield self.encode(x) if k in special else bytes(raw[at[k] : at[k + 1]])


_made: dict[tuple[type, int, int], Encoder] = {}


def encoder(source: str, kind: type = Encoder, most: int = CACHE) -> Encoder:
    """One encoder a worker, kept between tasks with what it has cached."""
    key = (kind, hash(source), most)
    if key not in _made:
        _made.clear()
        _made[key] = kind(source, most)
    return _made[key]


def read_source(path: str) -> str:
    """A tokenizer file, read where the job is planned and then broadcast: a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()
