"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id. In a shard they form a ball tree;
a ball with center c and radius r holds no vector whose product with q exceeds
q.c + |q| r. A query opens balls in the order of this bound and stops at the first
that can't beat its current k-th score. Each query is answered in its own shard
first, and the k-th score found there is shared with all other shards, which then
prune from their first ball on.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrhythm.llm.common import materialise

#: Vectors of a shard and of a leaf, queries of a block, on average or at most.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 128, 8192
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
SCALE = 256.0
#: Components beyond this have no squares that a double holds; the largest double; the least and the largest long.
WILD, HUGE, LEAST, MOST = 1e150, float(np.finfo(float).max), -(1 << 63), (1 << 63) - 1


def scaled(v: np.ndarray) -> np.ndarray:
    """Components times SCALE, rounded down; those that a double can't hold are cut to the largest one."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * v), -HUGE, HUGE)


def whole(v: np.ndarray) -> list[int]:
    """Components times SCALE, rounded down, without error."""
    return [int(x) * int(SCALE) if abs(x) >= EXACT else math.floor(SCALE * x) for x in v.tolist()]


class BallTree:
    """Balls over the scaled rows of v; leaves hold LEAF_ROWS rows, or more that are all alike.

    Rows with a component beyond WILD, whose distances can't be told, are in a leaf of their own.
    """

    def __init__(self, v: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.v, self.x = v, scaled(v)
        with np.errstate(over="ignore", invalid="ignore"):
            self._build(self.x, leaf_rows)

    def _build(self, x: np.ndarray, leaf_rows: int) -> None:
        wild = np.abs(x).max(1, initial=0) > WILD
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(np.arange(len(x)), -1, 0)] if len(x) else []
        while todo:
            rows, parent, side = todo.pop()
            own = x[rows]
            c = own.mean(0)
            far = np.sqrt(((own - c) ** 2).sum(1))
            k = len(self.center)
            self.center.append(c)
            self.radius.append(float(far.max()))
            self.children.append(None)
            self.rows.append(rows)
            if parent >= 0:
                pair = list(self.children[parent] or (k, k))
                pair[side] = k
                self.children[parent] = (pair[0], pair[1])
            if wild[rows].any():
                if not wild[rows].all():
                    self.rows[k] = None
                    todo += [(rows[~wild[rows]], k, 0), (rows[wild[rows]], k, 1)]
            elif len(rows) > leaf_rows and self.radius[k] > 0:
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                near = own @ (b - a) > (b @ b - a @ a) / 2
                if near.all() or not near.any():  # rounding only: the halves by place
                    near = np.arange(len(rows)) >= len(rows) // 2
                self.rows[k] = None
                todo += [(rows[~near], k, 0), (rows[near], k, 1)]
        self.centers = np.array(self.center) if self.center else np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
        self.radii = np.array(self.radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of each query with each ball, with room for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((q**2).sum(1))[:, None]
            reach = norm * (self.radii + np.sqrt((self.centers**2).sum(1)))[None, :]
            out = q @ self.centers.T + norm * self.radii[None, :] + 1e-9 * reach + 1e-6
        return np.maximum(np.where(np.isnan(out), np.inf, out), LEAST)

    def products(self, rows: np.ndarray, q: np.ndarray, raw: np.ndarray) -> list[int] | np.ndarray:
        """Exact integer inner products of these rows with a query, q being its scaled form; beyond the range of a long they are cut to it."""
        x = self.x[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            plain = np.abs(x).max(initial=0) * np.abs(q).sum() < EXACT
        if plain:
            return (x @ q).astype(np.int64)
        own = whole(raw)
        return [max(LEAST, min(MOST, sum(a * b for a, b in zip(whole(row), own)))) for row in self.v[rows]]


def not_above(score: int) -> float:
    """The largest double that is not above a score."""
    near = float(score)
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


def search(tree: BallTree, ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each query its (score, id) of at least its floor, the best k; its own id is left out."""
    out = []
    q = scaled(v)
    bound = tree.bounds(q) if len(tree.radii) else np.zeros((len(q), 0))
    for n, (vector, own) in enumerate(zip(q, q_ids)):
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst of the best k is on top
        kth = floor[n]
        balls = [(-bound[n, 0], 0)] if bound.shape[1] else []
        while balls:
            top, ball = heapq.heappop(balls)
            if -top < kth:
                break
            if (pair := tree.children[ball]) is not None:
                for c in pair:
                    if bound[n, c] >= kth:
                        heapq.heappush(balls, (-bound[n, c], c))
                continue
            rows = tree.rows[ball]
            scores = tree.products(rows, vector, v[n])
            if isinstance(scores, np.ndarray):
                keep = np.flatnonzero(scores >= kth)
                found = zip(scores[keep].tolist(), ids[rows[keep]].tolist())
            else:
                found = ((s, int(i)) for s, i in zip(scores, ids[rows]) if s >= kth)
            for s, i in found:
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                kth = max(kth, best[0][0])
        out.append([(s, -i) for s, i in best])
    return out


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles. Null or non-finite ones, or a null id, leave a row out."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.stack(column.to_numpy()).astype(float) if len(column) and len(column.iloc[0]) else np.zeros((len(column), 0))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k best of all other rows.

    Ties go to the smaller id. Rows are compared with those of as many components. A row with a null id
    or vector, or with a null or non-finite component, takes no part. Scores beyond the range of a long
    are its ends, and ties there. Other columns play no part; an empty table gives no rows. Rows of equal id are told apart
    by nothing, so a query leaves out every row of its own id, and is asked once for each of its rows.
    """
    rows = materialise(usable(vectors, vec_id, vector).withColumn("dim", F.size("v")), "vectors")
    total, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, math.ceil(total / shard_rows)), max(1, math.ceil(asked / block_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    if shards > 1:  # first, each query in its own shard

        def own(pdf: pd.DataFrame) -> pd.DataFrame:
            x, ids = _matrix(pdf["v"]), pdf["vec_id"].to_numpy()
            at = np.flatnonzero(ids % every == 0)
            found = search(BallTree(x), ids, x[at], ids[at], k, np.full(len(at), -np.inf))
            return pd.DataFrame({"vec_id": ids[at], "v": pdf["v"].to_numpy()[at], "dim": pdf["dim"].to_numpy()[at], "kth": [not_above(min(b)[0]) if len(b) == k else -np.inf for b in found]})

        queries = rows.groupBy("dim", "shard").applyInPandas(own, "vec_id long, v array<double>, dim int, kth double")
    else:
        queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim", F.lit(float("-inf")).alias("kth"))
    # a stated query set against all rows, in blocks: each meets each shard once
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    candidates = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            ids = q["vec_id"].to_numpy()
            found = search(BallTree(_matrix(x["v"])), x["vec_id"].to_numpy(), _matrix(q["v"]), ids, k, q["kth"].to_numpy())
            out = [(int(n), i, s) for n, best in zip(ids, found) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ("dim", "shard", "block")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each shard at most
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
