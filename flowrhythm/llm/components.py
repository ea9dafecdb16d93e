"""Connected components of a link table, as DataFrame jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrhythm.llm.common import materialise

#: Links that one task joins up in memory, some 100 MB.
CHUNK = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the least node of what they connect."""
    top: dict[int, int] = {}

    def of(x: int) -> int:
        while (y := top.setdefault(x, x)) != x:
            top[x] = x = top[y]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = of(x), of(y)
            top[max(x, y)] = min(x, y)
    stars = [(r, x) for x in list(top) if (r := of(x)) != x]
    if stars:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], names=["a", "b"])


def _fold(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour instead (the node itself counts)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the least of them. Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b"))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, root): the least node of the component, for every node with a link. Nodes are long integers.

    Links are first joined up in tasks of at most `chunk` links each. If there are more, rounds follow,
    each of which folds towards the least neighbour and then builds stars, written to the shared
    folder, until nothing changes: about as many as the logarithm of the longest path. A hub's links
    are regrouped by joins, which may be split, and never gathered in one row.
    """
    now = materialise(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b"), "links")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    parts = max(1, math.ceil(now.count() / chunk))
    now = materialise(now.repartition(parts).mapInArrow(_joined, "a long, b long"), "joined")
    before = None
    for _ in range(rounds if parts > 1 else 0):
        now = materialise(_star(_fold(now).distinct()).distinct(), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
