"""Substring dedup by sliding runs of sentences.

A text is cut after sentences and lines, and longer sentences also at points that their
words choose: of every CUT_WORDS gaps between words at least one is a cut, the one whose
two words have the least hash. So the cuts of a passage don't depend on what it is set
into, but for those near its ends.

Every run of consecutive sentences is hashed: from each cut on, the shortest run of at
least MIN_WORDS words, and likewise up to the end of each line and text. A run that occurs
more than once keeps its first occurrence, by document and place; what later ones cover
is removed. Any passage of 2 * CUT_WORDS + MIN_WORDS + CUT_WORDS words, 50 by default,
holds a whole run, wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrhythm.llm.common import bounded, fresh, materialise
from flowrhythm.llm.filters import bloom
from flowrhythm.llm.words import MIX, scan, spans

#: Words of a run at least, gaps of which one is a cut.
MIN_WORDS, CUT_WORDS = 20, 10
#: Characters of texts that are hashed at once.
SLICE = 1 << 18
_WORD = re.compile(r"\S+")
#: White space beyond spaces and line ends: of ASCII as spaces, other.
_BLANK = bytes.maketrans(b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f", b" " * 8)
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Marks that end a sentence, and those that may follow them.
_MARK, _AFTER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".!?", b".!?\"')]"))
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _plain(text: str) -> bytes:
    low = text.lower()
    return (low if low.isascii() else _WIDE.sub(" ", low)).encode().translate(_BLANK)


def cuts(texts: list[str], cut_words: int = CUT_WORDS) -> tuple[np.ndarray, ...]:
    """Of the words of all texts, one after another: hash, whether one begins a line, whether there is a cut before it; where each text begins."""
    whole, place, h, lines, starts = scan([_plain(t) for t in texts])
    n = len(h)
    # a word ends a sentence if a mark is among the marks at its end
    at = np.arange(len(whole))
    mark = np.maximum.accumulate(np.where(_MARK[whole], at, -1))
    other = np.maximum.accumulate(np.where(_AFTER[whole] | (whole == 32), -1, at))
    last = place[1:] - 2
    h = h & ~np.uint64(1) | ((mark[last] >= place[:-1]) & (mark[last] > other[last])).astype(np.uint64) if n else h
    begins = lines.copy()
    begins[1:] |= (h[:-1] & np.uint64(1)).astype(bool)
    gap = np.zeros(n + cut_words - 1, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (h[:-1] * MIX[0] ^ h[1:]) * MIX[1]
    gap[1:n] = mixed >> np.uint64(1) | np.uint64(1)
    gap[:n][begins] = 0
    cut = np.zeros(len(gap), bool)
    if n:
        cut[_first_least(gap, cut_words)] = True
    return h, lines, cut[:n], starts


def _first_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values the place of the first of its least ones, from windows of half the width."""
    least, at, w = x, np.arange(len(x)), 1
    while w < width:
        step = min(w, width - w)
        right = least[step:] < least[:-step]
        least, at, w = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step]), w + step
    return at


def runs(texts: list[str], min_words: int = MIN_WORDS, cut_words: int = CUT_WORDS) -> tuple[np.ndarray, ...]:
    """(text, first word, last word + 1, two words of hash) of all runs."""
    h, lines, cut, starts = cuts(texts, cut_words)
    n = len(h)
    at = np.append(np.flatnonzero(cut), n)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    # from each cut
    a = at[:-1]
    k = np.searchsorted(at, a + min_words)
    b = at[np.minimum(k, len(at) - 1)]
    good = (k < len(at)) & (b <= starts[of[a] + 1])
    # up to each end of a line
    e = np.append(np.flatnonzero(lines), n)
    e = e[e > 0]
    k = np.searchsorted(at, e - min_words, "right") - 1
    s = at[np.maximum(k, 0)]
    fit = (k >= 0) & (s >= starts[of[e - 1]]) if len(e) else np.zeros(0, bool)
    both = np.unique(np.concatenate([a[good], s[fit]]) * (n + 1) + np.concatenate([b[good], e[fit]]))
    a, b = both // (n + 1), both % (n + 1)
    first = starts[of[a]] if len(a) else a
    with np.errstate(over="ignore"):
        own = [(x := spans(h, a, b, f)) ^ (x >> np.uint64(31)) for f in _FACTORS]
        own = [x * MIX[2] ^ (b - a).astype(np.uint64) for x in own]
    return of[a] if len(a) else a, a - first, b - first, own[0], own[1]


def _sliced(texts: list[str], min_words: int, cut_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """`runs` of slices of the texts; they number texts among all."""
    part = np.cumsum([len(x) for x in texts]) // SLICE
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for i, j in zip([0, *ends], ends):
        k, *rest = runs(texts[i:j], min_words, cut_words)
        yield k + i, *rest


def run_hashes(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, cut_words: int = CUT_WORDS) -> DataFrame:
    """(h): half a hash of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, h1, _ in _sliced([x or "" for x in b.column(0).to_pylist()], min_words, cut_words):
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64))], names=["h"])

    return bounded(docs.select(F.col(text).alias("text"))).mapInArrow(run, "h long")


def sentence_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, cut_words: int = CUT_WORDS, among: DataFrame | None = None) -> DataFrame:
    """(h1, h2, id, of, first, last): every run of every text; `of` is a hash of the text, last is exclusive; both count words.

    With `among`, a written table of halves of hashes h, only runs that have one of them, and a few others.
    """
    held = docs.sparkSession.sparkContext.broadcast(bloom(among)) if among is not None else None  # MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found in _sliced([x or "" for x in b.column(2).to_pylist()], min_words, cut_words):
                if held is not None:
                    good = held.value.has(found[3])
                    found = tuple(x[good] for x in found)
                k, first, last, h1, h2 = found
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), b.column(0).take(k), b.column(1).take(k), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["h1", "h2", "id", "of", "first", "last"])

    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("of"), F.col(text).alias("text"))
    return bounded(keyed).mapInArrow(run, f"h1 long, h2 long, id {kind}, of long, first int, last int")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, cut_words: int = CUT_WORDS) -> DataFrame:
    """(id, of, spans): for each document the runs that occurred before, as [first, last) pairs of words.

    First is the occurrence with the least id (a null one is the least), then hash of text, then place.
    Rows that agree in id and text are one document.
    """
    # few runs repeat: half a hash counts them, and only what may repeat is written, shuffled and ordered; texts are hashed twice for that
    counted = run_hashes(docs, text, min_words, cut_words).groupBy("h").agg(F.count("*").alias("n"))
    repeated = materialise(counted.where("n > 1").select("h"), "repeated")
    found = materialise(sentence_runs(docs, doc_id, text, min_words, cut_words, repeated), "found")
    place = F.struct("id", "of", "first")
    heads = found.groupBy("h1", "h2").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "head")
    heads = materialise(heads, "heads")  # joined by exchanges of their own, so that a hot run can be split
    later = found.join(heads, ["h1", "h2"]).where(~place.eqNullSafe(F.col("head")))
    return later.groupBy("id", "of").agg(F.collect_set(F.struct("first", "last")).alias("spans"))  # spans of one text


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: str | None = None, min_words: int = MIN_WORDS, cut_words: int = CUT_WORDS) -> DataFrame:
    """docs with repeated spans removed from the text; all rows and columns stay.

    A row whose text is repeated altogether keeps an empty text; a null text stays null, and one of
    fewer than min_words words stays as it is. Texts of any length count whole. With `count`, a column
    of that name, which is replaced if docs has it, tells how many words were removed. Rows that repeat
    in id and text stay and are treated alike; an empty table stays empty.
    """
    spans = repeated_spans(docs, doc_id, text, min_words, cut_words)
    a, b, c = (fresh(docs, n) for n in ("span_id", "span_of", "span_list"))
    spans = spans.select(F.col("id").alias(a), F.col("of").alias(b), F.col("spans").alias(c))
    joined = docs.join(spans, F.col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(b)), "left")
    out = [f for f in docs.schema.fields if f.name != count] + ([T.StructField(count, T.IntegerType())] if count else [])
    names = [f.name for f in docs.schema.fields if f.name != count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for x, s in zip(batch.column(text).to_pylist(), batch.column(c).to_pylist()):
                if s and x:
                    at = np.array([m.start() for m in _WORD.finditer(x)] + [len(x)])
                    gone = np.zeros(len(at), bool)
                    for p in s:
                        gone[p["first"] : p["last"]] = True
                    edge = np.flatnonzero(np.diff(gone, prepend=False))  # where a removed stretch begins, where it ends
                    keep = [0, *at[edge].tolist(), len(x)]
                    x = "".join([x[i:j] for i, j in zip(keep[::2], keep[1::2])])
                    removed.append(int(gone.sum()))
                else:
                    removed.append(0)
                texts.append(x)
            cols = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(removed, pa.int32())] if count else []), names=[f.name for f in out])

    return bounded(joined.select(*names, c)).mapInArrow(run, T.StructType(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, count="n_removed").select("doc_id", "n_removed", F.length("text").alias("n_chars_left"), "text")
