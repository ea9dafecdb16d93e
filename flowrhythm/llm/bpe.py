"""Byte-pair encoding as a bounded-lookahead transducer, and incremental decoding.

Merges are tried in the order of their rank, so what stands far to the right can
only reach a boundary through a chain of merges of ever lower rank, each starting
where the one before ends. The longest such chain of the merge list bounds the
bytes after a boundary that can still change it: the sufficient lookahead. A word
of any length is encoded through a window; tokens that end before the lookahead are
emitted, and the window moves on to the first token that isn't stable yet. What
follows a token boundary is encoded as if the word began there, so the result is
that of the whole word.
"""

from __future__ import annotations

import array
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowrhythm.llm.common import bounded
from flowrhythm.llm.tokens import CACHE, WORD_CACHE, Encoder, Spec, _Chunks, byte_chars, encoder, read_source

_NEVER = 1 << 30
#: Characters of a text taken up at once; a cut is made at white space.
SLICE = 1 << 16


def sufficient_lookahead(merges: list[tuple[int, int, int]], lengths: dict[int, int]) -> int:
    """Bytes after a boundary that decide it. merges: (left, right, result), by rank; lengths: bytes of a symbol.

    reach[s]: the longest stretch that a chain beginning with a merge of left symbol s covers, from
    the merges so far. A merge (x, z) can be forestalled only by an earlier one that takes a symbol
    on the right edge of z, as z was built.
    """
    edge: dict[int, frozenset[int]] = {}
    reach: dict[int, int] = {}
    most = 0
    for x, z, out in merges:
        on_edge = edge.get(z) or frozenset((z,))
        g = lengths[z] + max((reach.get(s, 0) for s in on_edge), default=0)
        reach[x] = max(reach.get(x, 0), g)
        most = max(most, g)
        edge[out] = edge.get(out, frozenset((out,))) | on_edge
    return most


class Transducer(Encoder):
    """Texts to ids by the merge list alone."""

    def __init__(self, source: str, most: int = CACHE) -> None:
        self.spec = s = Spec(source)
        rows = [(s.vocab[a], s.vocab[b], s.vocab[a + b]) for a, b in s.merges]
        self._rank = {a << 20 | b: r for r, (a, b, _) in reversed([*enumerate(rows)])}
        self._result = [c for _, _, c in rows]
        self._plain = [s.vocab[c] for c in byte_chars()]
        self._last = [s.vocab[c + s.suffix] for c in byte_chars()]
        self.length = {i: len(t.removesuffix(s.suffix) if s.suffix and t != s.suffix else t) for t, i in s.vocab.items()}
        self.lookahead = sufficient_lookahead(rows, self.length)
        self.window = 2 * (self.lookahead + max(self.length.values()))
        self._words = _Chunks(self.word, WORD_CACHE)
        self._chunks = _Chunks(self._chunk, most)

    def _merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges: always the lowest rank, of equal ones the leftmost."""
        rank, result = self._rank.get, self._result
        ranks = [rank(a << 20 | b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            r = min(ranks)
            if r == _NEVER:
                break
            i = ranks.index(r)
            symbols[i] = s = result[r]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(s << 20 | symbols[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] << 20 | s, _NEVER)
        return symbols

    def stable(self, raw: bytes) -> Iterator[int]:
        """The tokens of one word, each as soon as it is stable."""
        start, n = 0, len(raw)
        while n - start > self.window:
            end = 0
            for t in self._merge([self._plain[b] for b in raw[start : start + self.window]]):
                if end + self.length[t] > self.window - self.lookahead:
                    break
                end += self.length[t]
                yield t
            start += end
        if start < n:
            symbols = [self._plain[b] for b in raw[start:]]
            symbols[-1] = self._last[raw[-1]]
            yield from self._merge(symbols)

    def word(self, word: str) -> bytes:
        return array.array("I", self.stable(word.encode())).tobytes()

    def stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that comes in pieces. Held at a time: a slice, or the longest stretch without white space."""
        rest = ""
        for p in pieces:
            rest += p
            if len(rest) >= SLICE and (cut := max(rest.rfind(" "), rest.rfind("\n"))) > 0:
                yield self.encode(rest[:cut])
                rest = rest[cut:]
        yield self.encode(rest)

    def slices(self, text: str | None) -> Iterator[bytes]:
        text = text or ""
        return self.stream(text[i : i + SLICE] for i in range(0, len(text), SLICE))


class Decoder:
    """Ids to text, piece by piece.

    As vocabulary: the tokens as the vocabulary writes them, with a space between, which is what a
    tokenizer without a decoder returns. As text: bytes are gathered until they make up characters,
    and the end of a word becomes a space. Unknown ids are left out of either.
    """

    def __init__(self, spec: Spec, as_vocabulary: bool = True) -> None:
        self.as_vocabulary = as_vocabulary
        if as_vocabulary:
            self.table = {i: s.encode() for i, s in spec.tokens.items()}
        else:
            back = {c: b for b, c in enumerate(byte_chars())}
            self.table = {i: bytes(back[c] for c in s.removesuffix(spec.suffix)) + b" " * s.endswith(spec.suffix) for i, s in spec.tokens.items() if i not in spec.special.values()} | {i: s.encode() for s, i in spec.special.items()}
        self.reset()

    def reset(self) -> None:
        self.begun = False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def raw(self, ids: Iterable[int]) -> bytes:
        """The bytes that these ids add."""
        known = [x for x in map(self.table.get, ids) if x is not None]
        if not self.as_vocabulary or not known:
            return b"".join(known)
        out = b" " * self.begun + b" ".join(known)
        self.begun = True
        return out

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        """The characters that these ids complete."""
        return self.state.decode(self.raw(ids), final)


def round_trip(docs: DataFrame, source: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row; a null text counts as empty. Repeated rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(held.value, Transducer)
        d = Decoder(t.spec)
        for b in batches:
            ids = [array.array("I", b"".join(t.slices(x.as_py()))) for x in b.column(1)]
            decoded = []
            for x in ids:
                d.reset()
                decoded.append(d.feed(x, True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return bounded(docs.select(doc_id, text)).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, source: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, both hashed as they come.

    A null text counts as empty: no tokens, digests of nothing. Repeated rows stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(held.value, Transducer)
        d = Decoder(t.spec)
        for b in batches:
            out: list[tuple[int, str, str]] = []
            for x in b.column(1):
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                d.reset()
                for raw in t.slices(x.as_py()):
                    n += len(raw) // 4
                    of_ids.update(raw)
                    of_text.update(d.raw(array.array("I", raw)))
                out.append((n, of_ids.hexdigest(), of_text.hexdigest()))
            cols = [*zip(*out)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return bounded(docs.select(doc_id, text)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_source(public_tokenizers.path("word_bpe_49k.json")))
