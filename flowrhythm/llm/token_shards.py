"""Token ids in training order: a keyed Feistel permutation, and shards of fixed stride.

Documents become token ids, and the stream of ids of each task is cut into sequences
of fixed length. Sequences are numbered, and a Feistel network keyed by a seed maps
numbers to slots; numbers that fall outside the range walk on along their cycle until
they are inside, so the map is a permutation of the sequences whatever their number,
and its inverse finds a slot's sequence without a table. Sequences are then ranged by
slot, and each range writes one shard: records of equal size in the order of training,
so a reader that stopped at a slot goes on at slot * stride.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrhythm.llm.common import bounded, materialise, shared_dir
from flowrhythm.llm.tokens import Spec, encoder, read_source

#: Ids of a sequence, bytes of an id, bytes of a shard at most, rounds of the network.
LENGTH, WIDTH, SHARD_BYTES, ROUNDS = 2048, 2, 64 << 20, 4
#: Chunks that a worker's encoder keeps.
CHUNKS = 1 << 19


class Feistel:
    """A permutation of range(n), given by a key."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS) -> None:
        self.n = n
        self.half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, k), left
            else:
                left, right = right, left ^ self._mix(right, k)
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64).astype(np.uint64)
        out = self._once(x, back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def sequences(docs: DataFrame, source: str, length: int = LENGTH, end: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(task, place, first_doc, n_docs, n_ids, ids): the ids of a task's documents, each closed by the end id, cut to length.

    ids are little-endian unsigned 16-bit and packed by zstandard; only a task's last sequence may be
    shorter. n_docs counts the documents that begin in a sequence, first_doc is the one it begins in.
    """
    spec = Spec(source)
    end = max(spec.special.values(), default=0) if end is None else end
    if max(spec.tokens) >= 1 << 16:
        raise ValueError("ids must fit in 16 bits")
    held = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pack, task = encoder(held.value, most=CHUNKS), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        step, rest, place, kind, close = length * WIDTH, bytearray(), 0, None, np.uint16(end).tobytes()
        starts: list[int] = []  # where in rest a document begins
        ids: list = []  # and its id; the first may have begun before

        def rows(final: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal rest, place, starts, ids
            out, at = [], 0
            while len(rest) - at >= step or final and at < len(rest):
                own = bytes(rest[at : at + step])
                i, j = bisect_left(starts, at), bisect_left(starts, at + step)
                out.append((task, place, ids[bisect_right(starts, at) - 1], j - i, len(own) // WIDTH, pack.compress(own)))
                at, place = at + step, place + 1
            k = max(0, bisect_right(starts, at) - 1)
            rest, starts, ids = rest[at:], [x - at for x in starts[k:]], ids[k:]
            if out:
                cols = [*zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), kind, pa.int32(), pa.int32(), pa.binary()))], names=["task", "place", "first_doc", "n_docs", "n_ids", "ids"])

        for b in batches:
            kind = b.column(0).type
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                starts.append(len(rest))
                ids.append(i)
                rest += np.frombuffer(t.encode(x.as_py()), np.uint32).astype(np.uint16).tobytes() + close
                if len(rest) >= 64 * step:
                    yield from rows()
        if kind is not None:
            yield from rows(final=True)

    kind = docs.schema[doc_id].dataType.simpleString()
    return bounded(docs.select(doc_id, text)).mapInArrow(run, f"task int, place long, first_doc {kind}, n_docs int, n_ids int, ids binary")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _put(path: str, parts: Iterator[bytes]) -> None:
    """A file, whole or not at all: written beside its place and then moved there, so a repeated task changes nothing."""
    store, at = _store(path)
    aside = f"{at}.{uuid.uuid4().hex}"
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(aside) as f:
        for p in parts:
            f.write(p)
    store.move(aside, at)


def materialise_order(docs: DataFrame, source: str, folder: str, key: int = 42, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards below folder, and then return a row for each sequence.

    Columns: slot, shard, row (in the shard), first_doc, n_docs, n_ids, ids_crc32 (of the ids without
    padding). Files: shard-NNNNN.bin, records of length ids of 16 bits, padded by the end id, and
    order.json, once all shards are there, with what a reader needs. A null text counts as empty, and an
    empty one is its end id. Long texts go on through as many sequences as they take; repeated rows count
    each; other columns play no part. An empty table gives no shard. A task that runs again writes its
    shards again, whole.
    """
    spark = docs.sparkSession
    end = max(Spec(source).special.values(), default=0)
    rows = materialise(sequences(docs, source, length, end, doc_id, text), "sequences")
    tasks = rows.groupBy("task").agg(F.count("*").alias("n"))
    total = tasks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stride = length * WIDTH
    per = max(1, min(shard_bytes // stride, math.ceil(total / max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    shards = math.ceil(total / per)
    order = Feistel(total, key)
    # a row for each task: numbers begin after those of the tasks before
    bases = tasks.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("task", "base")

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = order.slots(b.column("place").to_numpy() + b.column("base").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((s // per).astype(np.int32)), pa.array(s), *(b.column(c) for c in names)], names=["shard", "slot", *names])

    names = ["first_doc", "n_docs", "n_ids", "ids"]
    kind = docs.schema[doc_id].dataType.simpleString()
    placed = rows.join(F.broadcast(bases), "task").mapInArrow(slot, f"shard int, slot long, first_doc {kind}, n_docs int, n_ids int, ids binary")
    ranged = placed.repartitionByRange(max(1, shards), "shard").sortWithinPartitions("shard", "slot")  # whole shards, neighbours together

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pad = zstandard.ZstdDecompressor(), np.array([end], np.uint16).tobytes()
        at, parts = None, []
        for b in batches:
            sums = []
            for s, n, x in zip(b.column("shard").to_pylist(), b.column("n_ids").to_pylist(), b.column("ids")):
                if s != at and parts:
                    _put(f"{folder}/shard-{at:05d}.bin", iter(parts))
                    parts = []
                at = s
                own = unpack.decompress(x.as_py(), max_output_size=stride)
                sums.append(zlib.crc32(own))
                parts.append(own + pad * (length - n))
            rank = (b.column("slot").to_numpy() % per).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("shard"), pa.array(rank), b.column("first_doc"), b.column("n_docs"), b.column("n_ids"), pa.array(sums, pa.int64())], names=["slot", "shard", "row", "first_doc", "n_docs", "n_ids", "ids_crc32"])
        if parts:
            _put(f"{folder}/shard-{at:05d}.bin", iter(parts))

    out = materialise(ranged.mapInArrow(write, f"slot long, shard int, row long, first_doc {kind}, n_docs int, n_ids int, ids_crc32 long"), "order")
    _put(f"{folder}/order.json", iter([json.dumps({"sequences": total, "length": length, "width": WIDTH, "per_shard": per, "shards": shards, "key": key, "end": end}).encode()]))
    return out


def read_order(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots start to stop, read sequentially; a reader goes on wherever it stopped."""
    store, at = _store(folder)
    with store.open_input_stream(f"{at}/order.json") as f:
        said = json.loads(f.read())
    stride = said["length"] * said["width"]
    stop = said["sequences"] if stop is None else min(stop, said["sequences"])
    while start < stop:
        shard, row = divmod(start, said["per_shard"])
        with store.open_input_file(f"{at}/shard-{shard:05d}.bin") as f:
            f.seek(row * stride)
            for _ in range(min(stop - start, said["per_shard"] - row)):
                yield np.frombuffer(f.read(stride), np.uint16)
                start += 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return materialise_order(docs, read_source(public_tokenizers.path("word_bpe_49k.json")), f"{shared_dir(spark)}/shards")
