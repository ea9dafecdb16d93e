"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its runs of five words, weighted by how often each occurs. Every shingle
sends a Poisson process of arrivals whose rate is its weight; an arrival comes at a
register chosen at random, and a register keeps the shingle that arrived first. Two
documents agree in a register with the probability Jaccard similarity of their
weights, which is the plain Jaccard similarity where no shingle repeats. A shingle's
process ends early, as soon as its next arrival is later than every register.

Equal lists of words are one class before anything else, so copies cost one sketch.
Registers are cut into bands; texts that share a band meet, in tasks of bounded size.
A task hands on, for each member, the pair of the closest sketches, so that pairs grow
with members and not with their square; those pairs are verified on the whole texts,
and verified links give components. Groups that still span components are then gone
through whole: members with a close sketch in another component come together with
their texts, part by part, and every pair that is still apart is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrhythm.llm.common import bounded, fresh, materialise
from flowrhythm.llm.components import components

#: Words of a shingle; the least similarity of near duplicates.
WORDS, THRESHOLD = 5, 0.8
#: Bands and registers of each. At the threshold a pair misses every band with probability (1 - 0.8^5)^28 < 2e-5.
BANDS, ROWS = 28, 5
#: Pairs whose sketches agree in a smaller share than this are dropped: five standard deviations below the threshold.
SKETCH_LEAST = 0.63
#: Members, and shingles, of a part of a band's group, about; a task compares two parts.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Bytes of texts that are sketched at once, characters of a word whose hash is kept at most.
SLICE, LONG = 1 << 20, 256
#: Rows of an id and a hash that may be broadcast, some 30 MB; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of a word; starts anew when it gets large, some 20 MB."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= LONG:
            self[word] = h
        return h


_WORDS = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """A hash for each run of words, as often as it occurs; a shorter text is one run; no words, none."""
    w = (text or "").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(h))):
            out = mix(out * _MIX[0] + h[k : k + n])
    return out


def weighted(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique(shingles(text, words), return_counts=True)
    return ids, n


def similarity(a: str | None, b: str | None, words: int = WORDS) -> float:
    """Probability Jaccard: the sum over shared shingles of 1 / sum over all of max(a_j / a_i, b_j / b_i)."""
    return alike(weighted(a, words), weighted(b, words))


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of shingles with their weights."""
    (x, u), (y, v) = a, b
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if u.max() == 1 and v.max() == 1:
        return len(i) / (len(x) + len(y) - len(i))
    # max(u_j / u_i, v_j / v_i) depends on where u_j / v_j lies against u_i / v_i: one sort by that ratio
    both = np.union1d(x, y)
    a_ = np.zeros(len(both))
    b_ = np.zeros(len(both))
    a_[np.searchsorted(both, x)], b_[np.searchsorted(both, y)] = u, v
    with np.errstate(divide="ignore"):
        order = np.argsort(a_ / b_, kind="stable")
        ratio = (a_ / b_)[order]
    over = np.concatenate([np.cumsum(a_[order][::-1])[::-1], [0.0]])  # those of at least this ratio count by a
    under = np.concatenate([[0.0], np.cumsum(b_[order])])
    at = np.searchsorted(ratio, u[i] / v[j], "left")
    return float((1 / (over[at] / u[i] + under[at] / v[j])).sum())


def sketches(owner: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Registers of n documents at once. owner: the document of each shingle. Round k takes every process's k-th arrival."""
    best = np.full(n * registers, np.inf)
    first = np.zeros(n * registers, np.uint64)
    state, rate, time = mix(ids), weight.astype(float), np.zeros(len(ids))
    while len(ids):
        state = mix(state)
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        at = owner * registers + (mix(state ^ _MIX[2]) % np.uint64(registers)).astype(np.int64)
        sooner = time < best[at]
        on, when, who = at[sooner], time[sooner], ids[sooner]
        order = np.lexsort((who, when, on))
        on, when, who = on[order], when[order], who[order]
        lead = np.concatenate([[True], on[1:] != on[:-1]]) if len(on) else np.zeros(0, bool)
        best[on[lead]], first[on[lead]] = when[lead], who[lead]
        latest = best.reshape(n, registers).max(1)
        go = time < latest[owner]
        owner, ids, state, rate, time = owner[go], ids[go], state[go], rate[go], time[go]
    return first.reshape(n, registers)


def _words_key(text: str) -> tuple[int, int]:
    """128 bits of the words of a text; texts that differ only in case and white space agree."""
    h = xxhash.xxh3_128_intdigest(" ".join(text.lower().split()).encode())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def sketch_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, of, k1, k2, size, sketch, bands) of docs (doc_id, of, text), in one pass over the texts.

    k1 and k2 are the key of the words, size counts different shingles, sketch holds eight bits of each
    register, bands a hash of each band. A text without words has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bands * rows
        for whole in batches:
            part = np.cumsum(pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy()) // SLICE
            ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows] if whole.num_rows else []
            for at, end in zip([0, *ends], ends):
                b = whole.slice(at, end - at)
                texts = b.column(2).to_pylist()
                each = [weighted(x, words) for x in texts]
                keep = [k for k, (i, _) in enumerate(each) if len(i)]
                keys: list[tuple[int | None, int | None]] = [(None, None)] * len(texts)
                small: list[bytes | None] = [None] * len(texts)
                banded: list[np.ndarray | None] = [None] * len(texts)
                if n := len(keep):
                    owner = np.repeat(np.arange(n), [len(each[k][0]) for k in keep])
                    s = sketches(owner, np.concatenate([each[k][0] for k in keep]), np.concatenate([each[k][1] for k in keep]), n, m)
                    with np.errstate(over="ignore"):
                        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
                        for r in range(rows):
                            h = mix(h * _MIX[0] + s[:, r::rows])
                    low = (s & np.uint64(255)).astype(np.uint8)
                    for j, k in enumerate(keep):
                        keys[k], small[k], banded[k] = _words_key(texts[k]), low[j].tobytes(), h[j].view(np.int64)
                k1, k2 = zip(*keys) if keys else ((), ())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([len(i) for i, _ in each], pa.int32()), pa.array(small, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["doc_id", "of", "k1", "k2", "size", "sketch", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs.select("doc_id", "of", "text")).mapInArrow(run, f"doc_id {kind}, of long, k1 long, k2 long, size int, sketch binary, bands array<long>")


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype=float)


#: A task compares the members of one band's group, or two blocks of them.
_TASK = ["band", "p", "q"]


def _array(column: pa.Array) -> np.ndarray:
    """A column's rows; bytes and lists, which are of one length each, as a matrix."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    if pa.types.is_string(column.type):
        return np.array([*column.to_pylist(), None], object)[:-1]
    return column.to_numpy(zero_copy_only=False)


def _tasks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int, int], list[np.ndarray]]]:
    """Key and columns of each task, from batches in which its rows follow one another."""
    held: list[list[np.ndarray]] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [_array(b.column(c)) for c in columns]
        keys = np.stack([b.column(k).to_numpy() for k in _TASK], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            own = tuple(keys[i].tolist())
            if held and own != key:
                yield key, [np.concatenate(c) for c in zip(*held)]
                held = []
            key = own
            held.append([c[i:j] for c in cols])
    if held:
        yield key, [np.concatenate(c) for c in zip(*held)]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with each task's in one partition, one after another, by id."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *_TASK).sortWithinPartitions(*_TASK, "id")


def _blocks(groups: DataFrame) -> DataFrame:
    """(band, p, q, part, id): the members of each band's group of two and more, in every task that needs them.

    A group is cut into parts by a hash of the id, so that a part holds about BLOCK members and
    BLOCK_SHINGLES shingles at most, and a task meets two parts, or one with itself.
    """
    members = groups.select(F.explode("bands").alias("band"), "id", "size")
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("s")).where("n > 1")
    parts = sizes.select("band", F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("s") / F.lit(BLOCK_SHINGLES))).cast("int").alias("parts"))
    placed = members.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.select("band", "part", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return placed.select("band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id")


def _closest(placed: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b): of each member in each of its tasks the one of closest sketch, and the closest of those before it.

    Only pairs whose sketches leave the threshold possible are taken, at most two for each member and task,
    and every member that has any such partner is in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, p, q), (part, ids, sketch) in _tasks(batches, ["part", "id", "sketch"]):
            n, enough = len(ids), int(np.ceil(least * sketch.shape[1]))
            best, whose = np.full(n, enough - 1), np.full(n, -1)
            pairs = []
            first = np.flatnonzero(part == p)
            for i in range(n) if p == q else np.flatnonzero(part == q):
                o = np.arange(i) if p == q else first
                if not len(o):
                    continue
                same = (sketch[o] == sketch[i]).sum(1)
                k = same.argmax()
                if same[k] >= enough:
                    pairs.append((i, o[k]))
                    if same[k] > best[i]:
                        best[i], whose[i] = same[k], o[k]
                up = same > best[o]
                best[o[up]], whose[o[up]] = same[up], i
            pairs += [(i, whose[i]) for i in np.flatnonzero(whose >= 0)]
            if pairs:
                x, y = (ids[np.array(c)] for c in zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = placed.join(groups.select("id", "sketch"), "id").select(*_TASK, "part", "id", "sketch")
    return _dealt(rows).mapInArrow(run, "a long, b long").distinct()


def _texts_of(ids: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of these groups, written out; the documents are only scanned if the ids are few enough to broadcast."""
    wanted = materialise(groups.join(ids.distinct(), "id", "left_semi").select("id", F.col("head.doc_id").alias("hd"), F.col("head.of").alias("ho")), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    own = docs.select(F.col("doc_id").alias("d"), F.col("of").alias("o"), "text")
    return materialise(own.join(wanted, F.col("d").eqNullSafe(F.col("hd")) & (F.col("o") == F.col("ho"))).select("id", "text").dropDuplicates(["id"]), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose whole texts reach the threshold."""
    whole = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    return whole.where(_similarity("s", "t") >= F.lit(threshold)).select("a", "b")


class _Exact:
    """Exact similarities of one text to many of a task."""

    def __init__(self, texts: np.ndarray) -> None:
        self.each = [weighted(t) for t in texts]
        self.at = np.concatenate([[0], np.cumsum([len(i) for i, _ in self.each])])
        self.code = np.unique(np.concatenate([i for i, _ in self.each]), return_inverse=True)[1]
        self.share = np.concatenate([n / n.sum() for _, n in self.each])
        self.plain = np.array([n.max() == 1 for _, n in self.each])
        self.mine = np.zeros(int(self.code.max()) + 1)

    def alike(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Those of the others that reach the threshold with text i.

        Texts without repeated shingles are counted out. For others the sum of the lesser shares of
        shared shingles bounds the similarity from above, and what it leaves is computed.
        """
        own = slice(self.at[i], self.at[i + 1])
        self.mine[self.code[own]] = self.share[own]
        n = np.diff(self.at)[others]
        ends = np.cumsum(n)
        rows = np.arange(ends[-1]) + np.repeat(self.at[others] - ends + n, n)
        mine, starts = self.mine[self.code[rows]], ends - n
        shared = np.add.reduceat((mine > 0).astype(np.int64), starts)
        bound = np.add.reduceat(np.minimum(mine, self.share[rows]), starts)
        self.mine[self.code[own]] = 0
        plain = self.plain[others] & self.plain[i]
        good = plain & (shared / (n + len(self.each[i][0]) - shared) >= threshold)
        for k in np.flatnonzero(~plain & (bound >= threshold - 1e-9)):
            good[k] = alike(self.each[i], self.each[others[k]]) >= threshold
        return others[good]


def _met(i: int, p: int, q: int, part: np.ndarray) -> np.ndarray:
    """The rows that row i meets in its task, each pair once."""
    if p == q:
        return np.arange(i)
    return np.flatnonzero(part == p) if part[i] == q else np.zeros(0, int)


def _remaining(placed: DataFrame, roots: DataFrame, groups: DataFrame, texts: DataFrame, least: float, threshold: float) -> DataFrame:
    """Links (a, b) that connect all similar members of different components in any band's group.

    A task first marks the members that have a partner in another component with a close sketch, in the
    first band that both share. With their texts it then compares all pairs that are still apart.
    """
    at = placed.join(roots.withColumnRenamed("node", "id"), "id", "left").select(*_TASK, "part", "id", F.coalesce("root", "id").alias("root"))
    at = materialise(at, "rooted")
    spans = at.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("band")
    apart = at.join(spans, "band").join(groups.select("id", "sketch", "bands"), "id").select(*_TASK, "part", "id", "root", "sketch", "bands")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, p, q), (part, ids, root, sketch, bands) in _tasks(batches, ["part", "id", "root", "sketch", "bands"]):
            enough, own = int(np.ceil(least * sketch.shape[1])), np.zeros(len(ids), bool)
            earlier = bands[:, : np.flatnonzero(bands[0] == band)[0]]
            for i in range(len(ids)):
                o = _met(i, p, q, part)
                o = o[root[o] != root[i]]
                o = o[(sketch[o] == sketch[i]).sum(1) >= enough]
                o = o[~(earlier[o] == earlier[i]).any(1)]
                own[o] = True
                own[i] |= len(o) > 0
            if own.any():
                k = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), band)), *(pa.array(np.full(len(k), x), pa.int32()) for x in (p, q)), pa.array(part[k]), pa.array(ids[k]), pa.array(root[k])], names=[*_TASK, "part", "id", "root"])

    task = "band long, p int, q int, part int, id long, root long"
    near = materialise(_dealt(apart).mapInArrow(close, task), "near")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, p, q), (part, ids, root, text) in _tasks(batches, ["part", "id", "root", "text"]):
            exact, top, out = _Exact(text), root.copy(), []
            for i in range(len(ids)):
                o = _met(i, p, q, part)
                o = o[top[o] != top[i]]
                for j in exact.alike(i, o, threshold) if len(o) else ():
                    if top[j] != top[i]:
                        top[top == top[j]] = top[i]
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return _dealt(near.join(texts, "id").select(*_TASK, "part", "id", "root", "text")).mapInArrow(verify, "a long, b long").distinct()


def links(groups: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between groups of equal words (id, head, size, sketch, bands), enough to connect every class, and their components.

    The closest pairs are verified first and connect most of what belongs together; then all pairs of
    a band's group that are still apart and whose sketches are close are compared on their texts.
    """
    least = threshold + SKETCH_LEAST - THRESHOLD
    placed = materialise(_blocks(groups), "placed")
    pairs = materialise(_closest(placed, groups, least), "pairs")
    texts = _texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), groups, docs)
    found = materialise(_verified(pairs, texts, threshold), "links")
    more = materialise(_remaining(placed, components(found), groups, texts, least, threshold), "more")
    found = found.unionByName(more).distinct()
    return found, components(found)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, of, class_id, class_of, n_links): a row for each distinct pair of id and text, `of` being a hash of the text.

    class_id is the least id in the class (a null one is the least); n_links counts the verified links
    kept at the text's group of equal words. Texts of equal words are of one class; a text without
    words, null included, is a class of its own. A text of fewer than five words is one shingle. Long
    texts count whole. Of equal ids the least hash of text names the class. Repeated rows give one row,
    an empty table none; other columns of docs play no part.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("of"), F.col(text).alias("text"))
    rows = materialise(sketch_table(docs), "sketches")
    groups = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "of")).alias("head"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    groups = materialise(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    found, roots = links(groups, docs, threshold)
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    of_group = groups.select("k1", "k2", "head", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").join(ends.withColumnRenamed("node", "id"), "id", "left")
    of_group = of_group.select("k1", "k2", "head", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("n_links"))
    least = of_group.groupBy("root").agg(F.min("head").alias("least"))
    of_group = materialise(of_group.join(materialise(least, "least"), "root").select("k1", "k2", "least", "n_links"), "classes")
    keys = rows.select("doc_id", "of", "k1", "k2").distinct()
    named = keys.where("k1 is not null").join(of_group, ["k1", "k2"]).select("doc_id", "of", F.col("least.doc_id").alias("class_id"), F.col("least.of").alias("class_of"), "n_links")
    alone = keys.where("k1 is null").select("doc_id", "of", F.col("doc_id").alias("class_id"), F.col("of").alias("class_of"), F.lit(0).cast("long").alias("n_links"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that name their class: one document of each stays, with its columns, and so does any repetition of that row."""
    found = classes(docs, doc_id, text, threshold).where(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("of") == F.col("class_of"))))
    a, b = fresh(docs, "gone_id"), fresh(docs, "gone_of")
    gone = materialise(found.select(F.col("doc_id").alias(a), F.col("of").alias(b)), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(b)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
