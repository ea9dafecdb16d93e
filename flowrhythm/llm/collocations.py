"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at marks and line ends, and pieces into chunks at triggers: a
window of three words whose hash is divisible by PERIOD begins a chunk, which goes on to
the end of the next such window, so that neighbours overlap by three words. What is
alike in two texts is thus cut alike, and the corpus becomes a dictionary of different
chunks with the number of times each is parsed. A phrase of at most four words lies whole
in the chunk in whose body, all but the overlap, it begins: counting the phrases that
begin in bodies, each weighted by its chunk's number, counts each occurrence once.

The dictionary is counted in three passes. Hashes of words and pairs are summed first. Then
those that may be frequent are again, and those of longer phrases all whose pairs may be,
which a Bloom filter of bounded size tells and which leaves out nothing that counts. These
sums keep a second hash and a place of their phrase, and the third pass spells out frequent phrases there and
nowhere else, so what is handed on follows the number of phrases, not of tasks. Where the
second hashes of a sum differ, different phrases share the first: these few are counted by
their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrhythm.llm.common import bounded, materialise
from flowrhythm.llm.filters import Filter, bloom
from flowrhythm.llm.words import MIX, hashed, scan

MIN_COUNT, COVER, SCALE, TOP, MAX_WORDS = 30, 80, 2_000_000, 2000, 4
#: Of so many windows one begins a chunk, on average.
PERIOD = 16
#: Phrases that a task gathers before it adds up equal ones; sums that it hands on at once.
HELD, HANDED = 1 << 19, 1 << 16
#: Rows that one task ranks, about, besides the best of each part.
RANKED = 200_000
HALF, LOW = np.uint64(32), np.uint64((1 << 32) - 1)
#: Bytes of texts that are parsed at once.
SLICE = 1 << 20
#: Lower case for A-Z, a line end for each mark and line end, a space for a tab; other bytes of UTF-8 stay.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def joined(h: np.ndarray, n: int, mix: int = 0) -> np.ndarray:
    """Hashes of the n words from each place on, for places that have as many after them."""
    with np.errstate(over="ignore"):
        out = h[: max(0, len(h) - n + 1)] * MIX[mix]
        for k in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * MIX[mix] + h[k : len(h) - n + 1 + k]
        return (out ^ (out >> np.uint64(32))) * MIX[2]


def chunks(texts: list[bytes], period: int = PERIOD, overlap: int = MAX_WORDS - 1) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of the chunks of all texts' pieces: its text's number, its words, each with a space after it, and how many are its body."""
    whole, place, h, begins, starts = scan([t.translate(_PLAIN) for t in texts])
    n = len(h)
    pieces = np.flatnonzero(begins)
    ends = np.append(pieces[1:], n)
    piece = np.cumsum(begins) - 1
    window = joined(h, overlap) % np.uint64(period) == 0
    begins[: len(window)] |= window & (np.arange(len(window)) + overlap <= ends[piece[: len(window)]] if n else False)
    at = np.flatnonzero(begins)
    after = np.append(at[1:], n)[: len(at)]
    end = ends[piece[at]] if n else at
    stop = np.where(after >= end, end, after + overlap)
    of = np.searchsorted(starts, at, "right") - 1
    whole = whole.tobytes()
    cut = [whole[i:j] for i, j in zip(place[at].tolist(), place[stop].tolist())]
    return of, cut, after - at


def _parsed(batch: pa.RecordBatch, period: int) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, body) of a batch of languages and texts, which are parsed in slices of SLICE bytes, about."""
    size = np.array([x.as_buffer().size if x.is_valid else 0 for x in batch.column(1)], np.int64)
    part = np.cumsum(size) // SLICE
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for i, j in zip([0, *ends], ends):
        of, chunk, body = chunks([x or b"" for x in batch.column(1).slice(i, j - i).to_pylist()], period)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + i)), pa.array(chunk, pa.binary()), pa.array(body.astype(np.int32))], names=["lang", "chunk", "body"])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", period: int = PERIOD) -> DataFrame:
    """(lang, chunk, body, n): the different chunks of each language and how often each is parsed; chunks are UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _parsed(b, period)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return bounded(rows).mapInArrow(run, "lang string, chunk binary, body int").groupBy("lang", "chunk", "body").agg(F.count("*").alias("n"))


class _Sums:
    """Sums of weights by hash, and by the upper half of a tag if there are tags, with one tag of each, in slices of HELD."""

    def __init__(self, *names: str) -> None:
        self.names = names
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *columns: np.ndarray) -> bool:
        """Hash, tag if there are any, weight. Whether there is enough to take."""
        self.parts.append(columns)
        self.n += len(columns[0])
        return self.n >= HELD

    def take(self) -> Iterator[pa.RecordBatch]:
        """The sums so far, HANDED at once."""
        if not self.n:
            return
        columns = [[*c] for c in zip(*self.parts)]
        self.parts, self.n = [], 0
        h = np.concatenate(columns.pop(0))
        order = np.argsort(h, kind="stable")
        h = h[order]
        tag = np.concatenate(columns.pop(0))[order] if len(columns) > 1 else None
        new = h[1:] != h[:-1]
        if tag is not None:
            new |= tag[1:] >> HALF != tag[:-1] >> HALF
        begins = np.flatnonzero(np.concatenate([[True], new]))
        out = [x[begins].view(np.int64) for x in (h, tag) if x is not None]
        del h, tag, new
        out.append(np.add.reduceat(np.concatenate(columns.pop())[order], begins).astype(np.int64, copy=False))
        del order
        for i in range(0, len(begins), HANDED):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + HANDED]) for x in out], names=list(self.names))


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of a batch of the dictionary, one after another, and where each begins and the last ends."""
    chunk = batch.column("chunk")
    if not len(chunk):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
    return np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _phrases(batch: pa.RecordBatch, sizes: tuple[int, ...], pairs: Filter | None, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, number of its first word, hash, tag: halves of a second hash and of its place's, weight) of the phrases that begin in bodies of a batch of the dictionary."""
    whole, chunk_at = _bytes(batch)
    place, h = hashed(whole)
    lens = np.diff(np.searchsorted(place, chunk_at))
    codes = batch.column("lang").dictionary_encode()
    salt = np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in codes.dictionary.to_pylist()], np.uint64)[codes.indices.to_numpy()]
    ends = np.cumsum(lens)
    of = np.repeat(np.arange(len(lens)), lens)
    number = np.arange(len(h)) - (ends - lens)[of]
    body = batch.column("body").to_numpy()
    begins, left = number < body[of], lens[of] - number
    weight = batch.column("n").to_numpy()[of]
    with np.errstate(over="ignore"):
        salted = {n: salt[of] * np.uint64(2 * n + 1) for n in sizes + ((2,) if pairs else ())}
        # a chunk is told by its language, words and body, a place by its chunk and number
        mixed = np.cumsum(h * ((number.astype(np.uint64) + np.uint64(1)) * MIX[0] | np.uint64(1)), dtype=np.uint64)
        chunk = np.diff(np.concatenate([[np.uint64(0)], mixed])[np.concatenate([[0], ends])]) + salt * MIX[1] + body.astype(np.uint64) * MIX[2]
        spot = ((chunk ^ (chunk >> np.uint64(29))) * MIX[1])[of] + number.astype(np.uint64) * MIX[0]
        spot = (spot ^ (spot >> np.uint64(32))) * MIX[2]
        spot >>= HALF
    kept = np.uint64((1 << bits) - 1)
    ok = None
    if pairs is not None:
        word = joined(h, 1) ^ salted[1] if 1 in sizes else h
        pair = (joined(h, 2) ^ salted[2][: max(0, len(h) - 1)]) & kept
        ok = np.zeros(len(h), bool)
        inside = np.flatnonzero(left[: len(pair)] >= 2)
        ok[inside] = pairs.has(pair[inside])
    for n in sizes:
        good = begins & (left >= n)
        if ok is not None and n == 1:
            good &= pairs.has(word & kept)
        if ok is not None:
            for k in range(n - 1):
                good[: len(good) - k] &= ok[k:]
        at = np.flatnonzero(good)
        if len(at):
            second = (joined(h, n, 1)[at] ^ salted[n][at]) >> HALF << HALF
            yield n, at, (joined(h, n)[at] ^ salted[n][at]) & kept, second | spot[at], weight[at]


def frequent(chunked: DataFrame, sizes: tuple[int, ...], least: int = MIN_COUNT, bits: int = 64) -> DataFrame:
    """(h): hashes of phrases of these numbers of words that occur at least so often, and a few that don't but share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums("h", "n")
        for b in batches:
            for _, _, h, _, weight in _phrases(b, sizes, None, bits):
                if sums.add(h, weight):
                    yield from sums.take()
        yield from sums.take()

    parts = chunked.select("lang", "chunk", "body", "n").mapInArrow(run, "h long, n long")
    return parts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def counted(chunked: DataFrame, sizes: tuple[int, ...], pairs: Filter, least: int = MIN_COUNT, bits: int = 64) -> DataFrame:
    """(h, tag, n, mixed): hashes of phrases of these numbers of words that occur at least so often, a tag and whether there are others, and how often."""
    held = chunked.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums("h", "tag", "n")
        for b in batches:
            for _, _, *columns in _phrases(b, sizes, held.value, bits):
                if sums.add(*columns):
                    yield from sums.take()
        yield from sums.take()

    parts = chunked.select("lang", "chunk", "body", "n").mapInArrow(run, "h long, tag long, n long")
    sums = parts.groupBy("h").agg(F.min("tag").alias("tag"), F.max("tag").alias("other"), F.sum("n").alias("n")).where(F.col("n") >= least)
    return sums.select("h", "tag", "n", (F.shiftright("tag", 32) != F.shiftright("other", 32)).alias("mixed"))


def spelled(chunked: DataFrame, keys: Filter, sizes: tuple[int, ...], by_place: bool, bits: int = 64) -> DataFrame:
    """(h, tag, lang, phrase, words, n): the phrases whose hash, or whose place, the filter has, a row for each time in the dictionary."""
    held = chunked.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, chunk_at = _bytes(b)
            place = np.concatenate([[0], np.flatnonzero(whole == 32) + 1])
            whole = whole.tobytes()
            for n, at, h, tag, weight in _phrases(b, sizes, None, bits):
                good = held.value.has(h ^ (tag & LOW) if by_place else h)
                at = at[good]
                if len(at):
                    phrase = [whole[i:j] for i, j in zip(place[at].tolist(), (place[at + n] - 1).tolist())]
                    lang = b.column("lang").take(pa.array(np.searchsorted(chunk_at, place[at], "right") - 1))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[good].view(np.int64)) for x in (h, tag)), lang, pa.array(phrase, pa.binary()), pa.array(np.full(len(at), n, np.int32)), pa.array(weight[good])], names=["h", "tag", "lang", "phrase", "words", "n"])

    return chunked.select("lang", "chunk", "body", "n").mapInArrow(run, "h long, tag long, lang string, phrase binary, words int, n long").withColumn("phrase", F.col("phrase").cast("string"))


def count_phrases(chunked: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, bits: int = 64) -> DataFrame:
    """(lang, phrase, words, a) of a written dictionary, written: phrases of 1 to max_words words that occur at least so often.

    bits of the first hash are taken; with few, phrases share it, which costs time and changes nothing.
    """
    sizes = tuple(range(1, max_words + 1))
    short = materialise(frequent(chunked, (1, 2), least, bits), "short")
    found = materialise(counted(chunked, sizes, bloom(short), least, bits), "frequent")
    own, mixed = found.where("not mixed"), found.where("mixed").select("h")
    place = F.col("h").bitwiseXOR(F.col("tag").bitwiseAND((1 << 32) - 1))
    at = spelled(chunked, bloom(own.select(place.alias("h"))), sizes, True, bits).drop("n")
    out = own.join(at, ["h", "tag"]).select("lang", "phrase", "words", F.col("n").alias("a")).distinct()
    if not mixed.isEmpty():
        every = spelled(chunked, bloom(mixed), sizes, False, bits).join(mixed.distinct(), "h", "left_semi")
        out = out.unionByName(every.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    return materialise(out, "phrases")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language: of parts dealt by hash first, so that no task ranks more than about RANKED rows and the best of all parts."""
    parts = max(1, math.ceil(scored.count() / RANKED))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if parts > 1:
        w = Window.partitionBy("lang", "part").orderBy(*order)
        scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("part")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, cover: int = COVER, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    Letters A-Z are lowered; marks and line ends part pieces, and spaces and tabs words. a counts all
    occurrences of a phrase, l and r those of the two parts of its worst cut, n all words of the
    language; the score is floor(2000000 a / (l + r)). Phrases that occur fewer than `least` times, or in
    whose place a longer one occurs at least `cover` times of a hundred, are left out. A null text
    counts as empty, a null language is `und`; texts of any length count whole and repeated rows each.
    Ties go to the more frequent, then to the lesser phrase by its bytes. Other columns play no part. An
    empty table, or one without frequent phrases, gives no rows.
    """
    chunked = materialise(dictionary(docs, text, lang), "dictionary")
    totals = chunked.groupBy("lang").agg(F.sum(F.col("body") * F.col("n")).alias("n"))
    known = count_phrases(chunked, least)
    word = F.split("phrase", " ")
    several = known.where("words > 1")
    # the longer phrases' counts for what they cover
    inside = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = several.where("words > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = several.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * cover)).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.expr(f"{SCALE} * cast(a as decimal(30,0)) div (cast(l as decimal(30,0)) + cast(r as decimal(30,0)))").cast("long")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = materialise(worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    best = _best(scored, top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents
), p AS (SELECT d, lang, unnest(p) AS p, unnest(range(len(p))) AS j FROM d
), w0 AS (SELECT d, lang, j, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM p
), w AS MATERIALIZED (SELECT lang, w FROM w0 WHERE len(w) > 0
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE len(w) >= k)
), f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}
), t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), s AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, CAST(k - m + 2 AS BIGINT))) AS i FROM f, (SELECT unnest(range(2, {MAX_WORDS})) AS m) WHERE k > m) GROUP BY ALL
), c AS (
  SELECT f.lang, f.phrase, f.w, f.a, unnest(range(1, f.k)) AS cut FROM f LEFT JOIN s ON f.lang = s.lang AND f.phrase = s.phrase
  WHERE f.k > 1 AND (s.longer IS NULL OR 100 * CAST(s.longer AS HUGEINT) < {COVER} * CAST(f.a AS HUGEINT))
), x AS (
  SELECT c.lang, c.phrase, c.cut, c.a, l.a AS l, r.a AS r, CAST((CAST({SCALE} AS HUGEINT) * c.a) // (l.a + r.a) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 :], ' ')
), y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM x
), z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y WHERE best = 1)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, CAST(t.n AS BIGINT) AS n, z.score FROM z JOIN t ON z.lang = t.lang WHERE z.rank <= {TOP}
"""
