"""Quality by compression: two zstandard dictionaries, one score.

A dictionary is built from text marked good and another from text marked bad. A
text is cut into blocks, each block is compressed with either dictionary, and the
difference of the compressed sizes per byte of text says whose habits the text
shares. A logistic curve, fitted on labelled rows, turns the difference into a
probability.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrhythm.llm.common import bounded, fresh, materialise

#: Half the labelled rows per class that a model is fitted on, and blocks of each, from anywhere in it, that build a dictionary.
SAMPLE_ROWS, SAMPLE_BLOCKS = 1500, 4
#: Bytes of a dictionary, bytes of a block, level of compression.
DICT_BYTES, BLOCK_BYTES, LEVEL = 65536, 512, 3
#: A score of at least this counts as good.
THRESHOLD = 0.7


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float = 1.0
    bias: float = 0.0
    block: int = BLOCK_BYTES
    level: int = LEVEL

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    @property
    def learned(self) -> bool:
        return bool(self.good and self.bad)

    def difference(self, text: str | None) -> float:
        """Size with the bad dictionary less size with the good one, per byte; 0 for no text."""
        if self._pair is None:
            self._pair = [_compressor(d, self.level) for d in (self.bad, self.good)]
        raw = (text or "").encode()
        if not raw:
            return 0.0
        bad, good = self._pair
        total = 0
        for i in range(0, len(raw), self.block):
            block = raw[i : i + self.block]
            total += len(bad.compress(block)) - len(good.compress(block))
        return total / len(raw)

    def score(self, text: str | None) -> float:
        x = self.slope * self.difference(text) + self.bias
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; without enough text for one, the text itself, or nothing."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias by Newton's method, classes weighted as they are, with a light ridge."""
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> CompressionModel:
    """A model from at most 2 * sample_rows labelled rows for each class, in the order of a hash of their key.

    labels must hold only what may be learned from. The keys are chosen from the labels alone, so only
    the chosen texts are read, whole, in Spark's tasks; blocks of one half of them come to the driver and
    build the dictionaries, and numbers of the other half, unseen by these, fit the curve. A key with
    both labels, a null key and a row without text teach nothing; of rows with equal keys the text of the
    least hash does. With no label at all every score is 0.5; with one class, its share.
    """
    clear = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).where("y = z").select(F.col(key).alias("k"), "y")
    chosen = []
    for y in (0, 1):
        chosen += [(r.k, y) for r in clear.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(2 * sample_rows).collect()]
    if not chosen:
        return CompressionModel(b"", b"", 0.0, 0.0)
    keys = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("k", labels.schema[key].dataType), T.StructField("y", T.IntegerType())]))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0).join(F.broadcast(keys), "k")  # 4 * sample_rows keys at most
    sample = rows.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("y", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(2)).cast("int").alias("half"), "t")
    sample = materialise(sample, "sample")
    counts = {y: n for y, n in sample.groupBy("y").agg(F.count("*")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return CompressionModel(b"", b"", 0.0, 0.0 if not (n0 or n1) else math.log((n1 + 0.5) / (n0 + 0.5)))
    sides: list[list[bytes]] = [[], []]
    for _, y, block in sorted(map(tuple, sample.where("half = 0").mapInArrow(_some_blocks, "h long, y int, block binary").collect())):
        sides[y].append(block)
    model = CompressionModel(good=_dictionary(sides[1], DICT_BYTES), bad=_dictionary(sides[0], DICT_BYTES))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([held.value.difference(t.as_py()) for t in b.column(2)], pa.float64())], names=["y", "half", "x"])

    points = sorted(map(tuple, sample.mapInArrow(differences, "y int, half int, x double").collect()))  # a number for each row of the sample
    each = [[p for p in points if p[0] == y] for y in (0, 1)]
    used = [p for own in each for p in ([q for q in own if q[1]] or own)]
    model.slope, model.bias = _logistic(np.array([x for *_, x in used]), np.array([y for y, *_ in used], float))
    return model


def _some_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, y, block): of each text at most SAMPLE_BLOCKS of its blocks, in the order of a hash h of place and text."""
    for b in batches:
        out = []
        for y, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            raw = t.encode()
            seed = zlib.crc32(raw)
            places = sorted((xxhash.xxh3_64_intdigest(i.to_bytes(8, "little"), seed) >> 1, i) for i in range(0, len(raw), BLOCK_BYTES))
            out += [(h, y, raw[i : i + BLOCK_BYTES]) for h, i in places[:SAMPLE_BLOCKS]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out)] or [()] * 3, (pa.int64(), pa.int32(), pa.binary()))], names=["h", "y", "block"])


def score(docs: DataFrame, model: CompressionModel, text: str = "text", output: str = "score") -> DataFrame:
    """All rows and columns of docs, and the probability that a text is good.

    A null text counts as empty, and an empty one gets the score of no difference. A column that has
    the name of the output is replaced. Any row is scored by itself, so repeated rows agree.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES
    docs = docs.drop(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            s = pa.array([m.score(t.as_py()) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, output])

    return bounded(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())]))


def reject_low_quality(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns they had.

    A model that has not learned both classes rejects nothing. Null and empty texts have the score of no
    difference; repeated rows go or stay together; an empty table stays empty.
    """
    if not model.learned:
        return docs
    name = fresh(docs, "quality_score")
    return score(docs, model, output=name).where(F.col(name) >= threshold).drop(name)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the rows that no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that one may learn from."""
    return labels.where(~held_out())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, training_labels(labels))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
