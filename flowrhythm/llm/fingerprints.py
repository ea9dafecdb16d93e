"""Document fingerprints from prefix polynomial hashes.

A text's code points are the digits of a polynomial; arrays of its prefixes, modulo
two primes, give the hash of any span in constant time, so two spans are compared
without reading them and the longest common extension is found by binary search.

A fingerprint keeps the hash of the whole text, and of its prefixes and suffixes on
a grid. The stride of the grid is a power of two, so the coarser of two grids is part
of the finer, and the binary search for the longest common prefix and suffix works
on the fingerprints alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.llm.common import bounded

#: Primes below 2^31 and the bases of the polynomials: fixed values.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Points of the grid at most, for prefixes and for suffixes.
GRID = 64
#: A row without an id is ordered below all others.
NO_ID = -(1 << 63)


class _Powers:
    """Powers of the bases and of their inverses, as far as a text has needed them."""

    def __init__(self) -> None:
        self.n = 0
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def need(self, n: int) -> None:
        if n <= self.n and self.up:
            return
        self.n = max(1024, 1 << n.bit_length())
        self.up = [_geometric(b, self.n + 1, p) for b, p in zip(BASES, PRIMES)]
        self.down = [_geometric(pow(b, -1, p), self.n + 1, p) for b, p in zip(BASES, PRIMES)]


def _geometric(base: int, n: int, p: int) -> np.ndarray:
    """1, base, base^2, ... modulo p, by doubling."""
    out = np.ones(n, np.int64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * pow(base, done, p) % p
        done += step
    return out


POWERS = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class PrefixHashes:
    """Prefix arrays of one text. prefix[m][i] is the hash of its first i code points modulo PRIMES[m]."""

    def __init__(self, text: str = "", prefix: list[np.ndarray] | None = None) -> None:
        if prefix is None:
            prefix = [np.zeros(1, np.int64) for _ in PRIMES]
            self.prefix = PrefixHashes("", prefix).then(code_points(text)).prefix
        else:
            self.prefix = prefix
        self.n = len(self.prefix[0]) - 1

    def then(self, more: np.ndarray, keep: int | None = None) -> PrefixHashes:
        """The hashes of this text's first `keep` code points (all by default) and then `more`; only `more` is hashed."""
        keep = self.n if keep is None else keep
        POWERS.need(keep + len(more))
        out = []
        for p, up, own in zip(PRIMES, POWERS.up, self.prefix):
            tail = np.cumsum((more + 1) * up[keep : keep + len(more)] % p)
            out.append(np.concatenate([own[: keep + 1], (tail + own[keep]) % p]))
        return PrefixHashes(prefix=out)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of code points i to j (exclusive), as if they stood at the beginning."""
        POWERS.need(self.n)
        return tuple(int((x[j] - x[i]) % p * d[i] % p) for p, d, x in zip(PRIMES, POWERS.down, self.prefix))

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        """n, stride, whole hash, hashes of prefixes and of suffixes at multiples of the stride."""
        n = self.n
        stride = 1
        while n > GRID * stride:
            stride *= 2
        at = np.arange(stride, n + 1, stride)
        POWERS.need(n)
        short = lambda x, y: "".join(f"{v:08x}" for v in (x ^ y << 1).tolist())
        a, b = ((x[n] - x[n - at]) % p * d[n - at] % p for p, d, x in zip(PRIMES, POWERS.down, self.prefix))
        return f"{n}:{stride}:{int(self.prefix[0][n]) << 31 | int(self.prefix[1][n]):016x}:{short(self.prefix[0][at], self.prefix[1][at])}:{short(a, b)}"


def likeness(one: str, two: str) -> float:
    """Share of the longer text that the common prefix and suffix cover, on the coarser grid; 1 only for equal texts."""
    (n, s, whole, *a), (m, t, hole, *b) = one.split(":"), two.split(":")
    n, m, s, t = int(n), int(m), int(s), int(t)
    if n == m and whole == hole:
        return 1.0
    step, shared = max(s, t), 0
    for x, y in zip(a, b):
        low, high = 0, min(n, m) // step
        while low < high:
            mid = (low + high + 1) // 2
            i, j = (mid * step // s - 1) * 8, (mid * step // t - 1) * 8
            low, high = (mid, high) if x[i : i + 8] == y[j : j + 8] else (low, mid - 1)
        shared += low * step
    return min(shared, max(n, m) - 1, min(n, m)) / max(n, m)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row. A null text counts as empty; equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [PrefixHashes(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.n for x in h], pa.int64()), pa.array([x.fingerprint() for x in h], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return bounded(docs.select(doc_id, text)).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_chars long, fingerprint string")


def _ranges(docs: DataFrame, key: Column, parts: int) -> tuple[list[int], list[int]]:
    """Upper ends of ranges of about equally many rows, and into how many each is cut further.

    A key that is found more than once among the ends holds a range of its own, cut as often as it was found.
    """
    at = [i / parts for i in range(1, parts)]
    found = Counter((docs.select(F.percentile_approx(key, F.array(*map(F.lit, at)), 20_000)).first()[0] if at else []) or [])
    hot = {k for k, n in found.items() if n > 1}
    ends = sorted({*found, *(k - 1 for k in hot if k > NO_ID)})
    return ends, [found[k] if k in hot else 1 for k in ends] + [1]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (range, key, mark, seam, doc_id, text), partitioned by range and sorted down the ids.

    Ranges are of about equal size. To each range one more row is added (seam true): the row that
    follows its last one, so a task sees the next document of each of its own. What follows the last
    row of all is the first. Rows of one id are ordered by a hash of their text (mark), which also cuts
    an id of very many rows into ranges; only rows that agree in id and text stay together. Those without
    an id, or whose id is no integer, come last.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).try_cast("long"), F.lit(NO_ID))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends, cuts = (np.array(x, np.int64) for x in _ranges(docs, key, parts))
    base = np.cumsum(cuts) - cuts

    @F.pandas_udf("int")
    def range_of(k: pd.Series, m: pd.Series) -> pd.Series:
        r = np.searchsorted(ends, k.to_numpy(np.int64), "left")
        return pd.Series((base[r] + ((m.to_numpy(np.int64) >> 32) * cuts[r] >> 31)).astype(np.int32))

    mark = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1)
    rows = docs.select(key.alias("key"), mark.alias("mark"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("range", range_of("key", "mark"))
    tops = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max(F.struct("key", "mark")).alias("top")).collect()}  # a row for each range
    own = rows.select("range", "key", "mark", F.lit(False).alias("seam"), "doc_id", "text")
    if tops:
        order = sorted(tops)
        below = [(*tops[order[i - 1]], r) for i, r in enumerate(order)]  # below the lowest: the first of all
        seams = spark.createDataFrame(below, "key long, mark long, range int")
        wanted = sorted({k for k, _, _ in below})
        found = rows.drop("range").where(key.isin(wanted) if len(wanted) <= 1000 else F.lit(True)).join(F.broadcast(seams), ["key", "mark"])
        own = own.unionByName(found.groupBy("range", "key", "mark").agg(F.min_by(F.struct("doc_id", "text"), F.coalesce("text", F.lit(""))).alias("x")).select("range", "key", "mark", F.lit(True).alias("seam"), "x.doc_id", "x.text"))
    return own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "seam", F.col("key").desc(), F.col("mark").desc(), F.coalesce("text", F.lit("")))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against its next one, down the ids, and against an edit of itself.

    The edit replaces the last third of the code points (rounded down) by as many from the beginning of
    the next document, or all that it has. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text counts as empty, and its edit is empty; a
    row alone is its own next one. Repeated rows stay, and each is followed by its repetition. Long texts
    count whole; other columns play no part; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for seam, i, x in zip(b.column("seam").to_pylist(), b.column("doc_id"), b.column("text")):
                x = x.as_py() or ""
                own = PrefixHashes(x)
                print_ = own.fingerprint()
                if last is not None:
                    j, y, theirs, said = last
                    k = theirs.n // 3
                    head = x[:k]
                    edit = theirs.then(code_points(head), theirs.n - k).fingerprint()
                    out.append((j, theirs.n, hashlib.sha256((y[: theirs.n - k] + head).encode()).hexdigest(), said, edit, likeness(said, edit), likeness(said, print_)))
                last = None if seam else (i.as_py(), x, own, print_)
            cols = [*zip(*out)] or [()] * 7
            kinds = (b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return bounded(with_next(docs, doc_id, text)).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
