"""Packing of tokenized documents into fixed-length sequences by bin completion.

Which pieces share a sequence depends on their lengths alone, and there are at most
`capacity` different lengths. So Spark counts the pieces of each length, the search
runs over that histogram, whose size doesn't depend on the corpus, and Spark deals
the plan out again: the r-th piece of a length goes to the r-th place that the plan
holds for this length.

The search fills one sequence after another around the largest piece left. It
tries a few good fillings of the rest of the sequence first, then all to which no
piece left could be added, the least wasteful first, each as often as possible and
then less often, and gives up a branch once its waste, with the waste that what is left
can't do without, exceeds what the best solution so far allows. Best fit decreasing
gives the first of these solutions.
"""

from __future__ import annotations

import array
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrhythm.llm.common import bounded, materialise
from flowrhythm.llm.tokens import CACHE, encoder, read_source

CAPACITY, END = 4096, 1
#: Nodes of the search, and good fillings that a node tries before all others.
NODES, WIDTH = 12_000, 4
#: Chunks that a worker's encoder keeps in the query, whose workers do nothing else.
CHUNKS = 1 << 19


@dataclass
class Fill:
    """One way to fill a sequence, and how many sequences are filled so."""

    items: tuple[int, ...]
    times: int


def _take(count: dict[int, int], items: tuple[int, ...]) -> int:
    """How often the items can be taken from what is left."""
    return min(count[x] // items.count(x) for x in set(items))


class _Left:
    """Lengths still to place: counts, and the sorted lengths that have any."""

    def __init__(self, count: dict[int, int]) -> None:
        self.count = {k: v for k, v in count.items() if v > 0}
        self.sizes = sorted(self.count)

    def add(self, items: tuple[int, ...], times: int) -> None:
        for x in items:
            old = self.count.get(x, 0)
            if new := old + times:
                self.count[x] = new
                if not old:
                    insort(self.sizes, x)
            else:
                del self.count[x], self.sizes[bisect_left(self.sizes, x)]

    def below(self, room: int, used: dict[int, int]) -> int:
        """The largest length that fits and isn't used up, or 0."""
        i = bisect_right(self.sizes, room)
        while i:
            x = self.sizes[i - 1]
            if self.count[x] > used.get(x, 0):
                return x
            i -= 1
        return 0


def _greedy(left: _Left, room: int, used: dict[int, int]) -> tuple[int, ...]:
    """Best fit: the largest that fits, again and again."""
    out = []
    while room and (x := left.below(room, used)):
        out.append(x)
        used[x] = used.get(x, 0) + 1
        room -= x
    return tuple(out)


def completions(left: _Left, largest: int, capacity: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """A few good fillings around the largest piece, the least waste first, then the fewest items.

    Each begins with one of the larger lengths that fit and goes on by best fit, with the last place
    also looked up exactly among pairs. A filling is dropped if another has as many items, each at
    least as large.
    """
    room = capacity - largest
    used = {largest: 1}
    found = {_greedy(left, room, dict(used))}
    i = bisect_right(left.sizes, room)
    for first in reversed(left.sizes[max(0, i - 2 * width) : i]):
        if left.count[first] <= used.get(first, 0):
            continue
        mine = dict(used)
        mine[first] = mine.get(first, 0) + 1
        rest = _greedy(left, room - first, dict(mine))
        found.add((first, *rest))
        # the best pair in the room that is left: for each larger one the largest partner
        space = room - first
        j = bisect_right(left.sizes, space)
        for a in reversed(left.sizes[max(0, j - 3 * width) : j]):
            if left.count[a] > mine.get(a, 0):
                mine[a] = mine.get(a, 0) + 1
                b = left.below(space - a, mine)
                mine[a] -= 1
                found.add((first, a, b) if b else (first, a))
                if a + b == space:
                    break
    ranked = sorted({tuple(sorted(x, reverse=True)) for x in found}, key=lambda x: (-sum(x), len(x), [-y for y in x]))
    kept: list[tuple[int, ...]] = []
    for x in ranked:
        if not any(len(y) == len(x) and all(p >= q for p, q in zip(y, x)) for y in kept):
            kept.append(x)
        if len(kept) == width:
            break
    return [(largest, *x) for x in kept]


def best_fit(count: dict[int, int], capacity: int) -> list[Fill]:
    """Best fit decreasing over a histogram: the incumbent the search starts from."""
    left, out = _Left(dict(count)), []
    while left.sizes:
        x = left.sizes[-1]
        items = (x, *_greedy(left, capacity - x, {x: 1}))
        times = _take(left.count, items)
        left.add(items, -times)
        out.append(Fill(items, times))
    return out


def fillings(left: _Left, largest: int, capacity: int, spare: int) -> Iterator[tuple[int, ...] | None]:
    """All fillings around the largest piece that waste at most `spare` and take no further piece, the least waste first.

    None stands for a filling passed over because a piece could be added.
    """
    room = capacity - largest
    sizes = [x for x in reversed(left.sizes) if x <= room and left.count[x] > (x == largest)]
    most = [min(left.count[x] - (x == largest), room // x) for x in sizes]
    reach, mask = [1], (1 << room + 1) - 1  # sums of the sizes from each on, as bits
    for x, m in zip(reversed(sizes), reversed(most)):
        sums = reach[-1]
        for _ in range(m):
            sums |= reach[-1] | (sums << x & mask)
        reach.append(sums)
    reach.reverse()
    for waste in range(min(spare, room) + 1):
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room - waste, ())]
        while stack:
            k, r, items = stack.pop()
            if not r:
                used = {largest: 1}
                for x in items:
                    used[x] = used.get(x, 0) + 1
                yield None if left.below(waste, used) else (largest, *items)
                continue
            while k < len(sizes) and sizes[k] > r:
                k += 1
            if k < len(sizes) and reach[k] >> r & 1:
                for n in range(min(most[k], r // sizes[k]) + 1):
                    if reach[k + 1] >> (r - n * sizes[k]) & 1:
                        stack.append((k + 1, r - n * sizes[k], items + (sizes[k],) * n))


def branches(left: _Left, capacity: int, width: int, spare: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """What a node tries: (filling, times), good fillings first, then all, then all with fewer repetitions; None as in fillings."""
    largest = left.sizes[-1]

    def most(items: tuple[int, ...]) -> int:
        waste = capacity - sum(items)
        return min(_take(left.count, items), spare // waste if waste else capacity * sum(left.count.values()))

    tried, again = set(), False
    for items in completions(left, largest, capacity, width):
        tried.add(items)
        if times := most(items):
            again |= times > 1
            yield items, times
    for items in fillings(left, largest, capacity, spare):
        if items is None or items not in tried:
            times = most(items) if items else 0
            again |= times > 1
            yield items and (items, times)
    for items in fillings(left, largest, capacity, spare) if again else ():
        if items is None:
            yield None
        else:
            for times in range(most(items) - 1, 0, -1):
                yield items, times


def least_waste(left: _Left, capacity: int) -> int:
    """Waste of any packing of what is left, at least.

    A sequence with a piece in it can't be filled beyond the largest sum of pieces that its room takes. Pieces
    of more than half the capacity never share one, so theirs add up; of the others, the worst one counts.
    """
    room = capacity - left.sizes[0]
    sums, mask = 1, (1 << room + 1) - 1  # reachable sums, as bits
    for x in left.sizes:
        n, k = min(left.count[x], room // x), 1
        while n > 0:
            sums |= sums << min(k, n) * x & mask
            n, k = n - k, 2 * k
    worst = apart = 0
    for x in left.sizes:
        r = capacity - x
        waste = r + 1 - (sums & (1 << r + 1) - 1).bit_length()
        worst = max(worst, waste)
        if 2 * x > capacity:
            apart += waste * left.count[x]
    return max(worst, apart)


def least_sequences(count: dict[int, int], capacity: int) -> int:
    """A lower bound on the number of sequences.

    For each k up to half the capacity: pieces above capacity - k stand alone, other large ones lie apart, and
    the rest of at least k goes into their room and new sequences.
    """
    sizes = np.array(sorted(count), np.int64)
    n = np.array([count[x] for x in sizes.tolist()], np.int64)
    bound = -(-int((sizes * n).sum()) // capacity)
    for k in {0, *(x for x in sizes.tolist() if 2 * x <= capacity)}:
        alone, large = sizes > capacity - k, 2 * sizes > capacity
        apart, rest = large & ~alone, ~large & (sizes >= k)
        over = int((sizes * n)[rest | apart].sum()) - capacity * int(n[apart].sum())
        bound = max(bound, int(n[large].sum()) + max(0, -(-over // capacity)))
    return bound


def pack(count: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> tuple[list[Fill], int]:
    """Fillings that place every length, and the lower bound on their number.

    A filling is repeated as long as the counts allow, so the work depends on the number of lengths.
    The search ends at the bound or when nothing is left to try, which prove the best, or after so many nodes.
    Nodes test their least waste from the first step back on: the first way down seldom needs it.
    """
    if any(not 0 < k <= capacity for k in count):
        raise ValueError("lengths must be between 1 and the capacity")
    total = sum(k * v for k, v in count.items())
    bound = least_sequences(count, capacity)
    best = best_fit(count, capacity)
    fewest = sum(f.times for f in best)
    left, path, wasted, seen, back = _Left(dict(count)), [], [0], 0, False
    todo: list[Iterator[tuple[tuple[int, ...], int] | None]] = []
    while fewest > bound and seen <= nodes:
        allowed = (fewest - 1) * capacity - total  # waste of any better solution at most
        if not left.sizes:
            used = sum(f.times for f in path)
            if used < fewest:
                best, fewest = list(path), used
                continue
            todo.append(iter(()))
        elif len(todo) == len(path):
            seen += 1
            spare = allowed - wasted[-1]
            todo.append(iter(()) if back and least_waste(left, capacity) > spare else branches(left, capacity, width, spare))
        while todo and (step := next(todo[-1], ())) == ():  # back up
            todo.pop()
            back = True
            if path:
                f = path.pop()
                wasted.pop()
                left.add(f.items, f.times)
        if not todo:
            break
        if step is None:  # a filling passed over costs as much as a node
            seen += 1
            continue
        items, times = step
        waste = wasted[-1] + times * (capacity - sum(items))
        if waste <= allowed:
            left.add(items, -times)
            path.append(Fill(items, times))
            wasted.append(waste)
        else:
            seen += 1
    return best, bound


def places(fills: list[Fill]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of places, how many a sequence holds, first sequence, first offset; by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for f in fills:
        offset = 0
        for x in sorted(set(f.items), reverse=True):
            k = f.items.count(x)
            rows.setdefault(x, []).append((taken.get(x, 0), k, sequence, offset))
            taken[x] = taken.get(x, 0) + k * f.times
            offset += k * x
        sequence += f.times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def pieces(docs: DataFrame, source: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", most: int = CACHE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, task, rank): rank counts the pieces of a length in its task."""
    held = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task, seen = encoder(held.value, most=most), TaskContext.get().partitionId(), {}
        stop = array.array("I", [end]).tobytes()
        for b in batches:
            rows, of = [], []
            for k, ids in enumerate(t.encode_all(b.column(1).to_pylist())):
                ids += stop
                for p, i in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[i : i + 4 * capacity]
                    n = len(own) // 4
                    seen[n] = (rank := seen.get(n, -1) + 1)
                    rows.append((p, i // 4, n, zlib.crc32(own), task, rank))
                    of.append(k)
            cols = [*zip(*rows)] or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return bounded(docs.select(doc_id, text)).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack_documents(docs: DataFrame, source: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", most: int = CACHE) -> DataFrame:
    """A place for every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then the end id; only those longer than the capacity are cut. A null text
    counts as empty and is the end id alone. Rows that repeat are packed as often as they occur. A worker's encoder
    keeps at most `most` chunks.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, source, capacity, end, doc_id, text, most), "pieces")
    each = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to the capacity
    fills, _ = pack(histogram, capacity)
    plan = spark.sparkContext.broadcast(places(fills))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[own[0]])
                first, each_of, at, shift = plan.value[n]
                k = np.searchsorted(first, rank[own], "right") - 1
                r = rank[own] - first[k]
                sequence[own], offset[own] = at[k] + r // each_of[k], shift[k] + r % each_of[k] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return cut.join(before, ["task", "length"]).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_source(public_tokenizers.path("word_bpe_49k.json")), most=CHUNKS)
